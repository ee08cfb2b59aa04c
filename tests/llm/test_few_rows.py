from gleaner.operators.joins import joined


def test_few_rows_are_joined_without_telling_keys_apart(spark):
    rows = spark.range(2000).selectExpr("id % 3 a", "id b")
    told = spark.createDataFrame([(0, "x", 667), (1, "y", 667)], "a bigint, m string, n bigint")
    one, two = joined(rows, told, ["a"], 2000), joined(rows, told, ["a"], 2000, 2000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.columns == two.columns
    assert "Union" not in two._jdf.queryExecution().optimizedPlan().toString()
