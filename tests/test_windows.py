import random
from collections import defaultdict
from decimal import Decimal

import pytest

from gleaner.operators import budget, windows


@pytest.mark.parametrize("block", [1, 3, 2000])
def test_admitted_folds_a_group_in_blocks(spark, block):
    rng = random.Random(5)
    items = [(g, rng.randrange(40), rng.choice([0.0, 0.1, 0.7, 3.3, 9.0, 11.0])) for g in ("a", "b", None) for _ in range(40)]
    items += [("c", 1, 9.5), ("c", 2, -3.0), ("c", 3, 3.0), ("c", 4, 8.0), ("c", None, 0.5), ("c", 5, None)]
    want, used = [], defaultdict(Decimal)
    for g, k, c in sorted((x for x in items if x[2] is not None), key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[2])):
        if used[g] + Decimal(str(c)) <= 10:
            used[g] += Decimal(str(c))
            want.append((g, k, c))
    df = spark.createDataFrame(items, "g string, k bigint, c double").repartition(3)
    out = budget.admitted(df, "g", "k", "c", 10.0, block)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_numbered_cuts_groups_and_counts_on(spark):
    rows = [(g, k) for g in ("a", None) for k in random.Random(6).sample(range(10**6), 700)] + [("b", 3), ("b", None), ("b", 1)]
    got = windows.numbered(spark.createDataFrame(rows, "g string, k bigint").repartition(3), "g", "k", "page", cuts=9).collect()
    want = {(g, k): n for of in ("a", None, "b") for n, (g, k) in enumerate(sorted((r for r in rows if r[0] == of), key=lambda r: -1 if r[1] is None else r[1]), 1)}
    assert {(r["g"], r["k"]): r["page"] for r in got} == want and len(got) == len(rows)


def test_admitted_lets_a_million_items_in_and_equals_a_loop_on_random_costs(spark):
    rows = spark.range(1_000_000).selectExpr("0 g", "id k", "0.2D c")
    assert budget.admitted(rows, "g", "k", "c", 200_000.0).count() == 1_000_000
    costs = spark.range(60_000).selectExpr("id % 2 g", "id k", "round(rand(3) * if(id % 7 = 0, 40, 1), 3) c")
    df = spark.createDataFrame(costs.collect(), costs.schema)
    want, used = set(), defaultdict(Decimal)
    for g, k, c in sorted(map(tuple, df.collect()), key=lambda x: x[1]):
        if used[g] + Decimal(str(c)) <= 9000:
            used[g] += Decimal(str(c))
            want.add(k)
    assert {r["k"] for r in budget.admitted(df, "g", "k", "c", 9000.0, block=2500).collect()} == want and len(want) > 5000


def test_admitted_takes_equal_items_one_by_one_and_leaves_out_what_is_no_cost(spark):
    rows = spark.createDataFrame([("a", 1, 3.0)] * 5 + [("a", 2, 1.0), ("a", 3, float("nan")), ("a", 4, float("inf")), ("a", 5, -float("inf")), ("b", 1, 1e300), ("b", 2, 0.0)], "g string, k bigint, c double")
    assert sorted(map(tuple, budget.admitted(rows, "g", "k", "c", 10.0).collect())) == [("a", 1, 3.0)] * 3 + [("a", 2, 1.0), ("b", 2, 0.0)]
    assert sorted(map(tuple, budget.admitted(rows, "g", "k", "c", -1.0).collect())) == []
    assert budget.admitted(rows.where("false"), "g", "k", "c", 10.0).count() == 0


@pytest.mark.parametrize("block", [1, 4, 100_000])
def test_admitted_adds_doubles_in_order_where_sums_are_not_exact(spark, block):
    rng = random.Random(7)
    items = [(g, k, rng.choice([0.1, 0.2, 0.7, 3.3, 0.0])) for g in ("a", "b", None) for k in range(8)] + [("c", k, 0.1) for k in range(3)] + [("d", 1, 0.1)] * 4 + [("e", 1, 0.2), ("e", 2, -0.3), ("e", 3, 0.4)]
    want, used = [], defaultdict(float)
    for g, k, c in sorted(items, key=lambda x: (str(x[0]), x[1])):
        if used[g] + c <= 0.3:
            used[g] += c
            want.append((g, k, c))
    assert [x for x in want if x[0] == "c"] == [("c", 0, 0.1), ("c", 1, 0.1)]  # 0.1 + 0.1 + 0.1 is over 0.3
    df = spark.createDataFrame(items, "g string, k bigint, c double").repartition(3)
    assert sorted(map(tuple, budget.admitted(df, "g", "k", "c", 0.3, block, exact=False).collect()), key=repr) == sorted(want, key=repr)
