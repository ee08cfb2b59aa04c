import pytest
from oracle import expected, rows

from gleaner import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert (sorted(df.columns), rows(df.columns, df.collect())) == expected(catalog.ORACLE_SQL[name], sf_dir)
