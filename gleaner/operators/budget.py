"""An ordered budget over any number of items: what does not fit takes nothing, and later, smaller items may fit.

Items are sorted into ranges of bounded size, once. A round sums the ranges of what still fits each group's room, in order:
all ranges before the first that overflows are let in whole, and that one alone is folded item by item in a task. The room
only shrinks (but where costs are negative), so what no longer fits is left out before the next round. Each round is
written, so plans do not nest, and takes one more range of each group at least; most items go in the first.

Sums of doubles hang on their order. Where they are asked for (``exact=False``), no range is let in by its sum: each
round folds the next range of each group in which anything still fits, item by item.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.staging import written
from gleaner.workers import with_package

#: Sums are exact in any order: costs count to nine places. Times a number of copies they still fit a decimal.
COST, COPIES, SUM = "decimal(24,9)", "decimal(13,0)", "decimal(38,9)"
#: Costs from this size on take no part.
GREATEST = 1e15


def _copies(cap: Decimal, used: Decimal, c: Decimal, n: int) -> tuple[int, Decimal]:
    """How many of n equal items fit, and what is used after them."""
    room = cap - used
    fit = 0 if c > room else n if c <= 0 else int(min(Decimal(n), room // c))  # once one of negative cost fits, its copies do
    return fit, used + c * fit


def _copies_added(cap: float, used: float, c: float, n: int) -> tuple[int, float]:
    """The same with doubles, added one by one."""
    for fit in range(n):
        if not used + c <= cap:
            return fit, used
        if used + c == used:
            break
        used += c
    return n, used


def _fold(cap: Decimal | float, kinds: dict[str, pa.DataType]):
    """Folds the items of one range of one group, from what was used before it; the last row tells what is used after."""
    copies = _copies if isinstance(cap, Decimal) else _copies_added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        if not len(t):
            return
        items = sorted(zip(t["k"].to_pylist(), t["c"].to_pylist(), t["n"].to_pylist()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        used, out = t["start"][0].as_py(), []
        for k, c, n in items:
            fit, used = copies(cap, used, c, n)
            if fit:
                out.append((k, c, fit))
        rows = [(k, c, n, None) for k, c, n in out] + [(None, None, 0, used)]
        names = ("k", "c", "n", "used")
        group = {"g": pa.array([t["g"][0].as_py()] * len(rows), kinds["g"]), "r": pa.array([t["r"][0].as_py()] * len(rows), pa.int32()), "falls": pa.array([t["falls"][0].as_py()] * len(rows), pa.bool_())}
        yield pa.RecordBatch.from_arrays([*group.values(), *(pa.array(c, kinds[name]) for name, c in zip(names, zip(*rows)))], names=[*group, *names])

    return run


def _added(placed: DataFrame, cap: float, kind: str, kinds: dict[str, pa.DataType]) -> list[DataFrame]:
    """What is let in when doubles are added one by one: in each round, the next range of each group with something that fits."""
    state = placed.groupBy("g").agg((F.min("c") < 0).alias("falls")).select(F.col("g").alias("h"), "falls", F.lit(0.0).alias("used"), F.lit(-1).alias("done"))
    state, folded = written(state, "budget_state"), []
    while not state.isEmpty():
        left = placed.join(state, F.col("g").eqNullSafe(F.col("h"))).where((F.col("r") > F.col("done")) & (F.col("falls") | (F.col("used") + F.col("c") <= cap)))
        at = left.groupBy(F.col("g").alias("i")).agg(F.min("r").alias("s"))
        todo = left.join(at, F.col("g").eqNullSafe(F.col("i")) & (F.col("r") == F.col("s"))).select("g", "r", "falls", "k", "c", "n", F.col("used").alias("start"))
        done = written(with_package(todo).groupBy("g", "r").applyInArrow(_fold(cap, kinds), f"g {kind}, r int, falls boolean, k bigint, c double, n bigint, used double"), "budget_fold")
        folded.append(done.where("used is null").select("g", "k", "c", "n"))
        state = done.where("used is not null").select(F.col("g").alias("h"), "falls", "used", F.col("r").alias("done"))
    return folded


def admitted(items: DataFrame, group: str, key: str, cost: str, cap: float, block: int = 100_000, exact: bool = True) -> DataFrame:
    """group, key and cost of what an ordered fold by key (then cost) lets in: an item that does not fit takes nothing.

    What is used is summed exactly, of costs to nine places; without ``exact`` costs are doubles, added in order as a loop would.

    Cases: items without a cost, with one that is no number, or of GREATEST and more in size take no part; null groups are
    one group; null keys come first; equal items count each; costs of zero fit whatever is used; an empty table gives an
    empty result. ``block`` bounds the different items that one task folds.
    """
    spark = items.sparkSession
    limit, c = Decimal(str(min(max(cap, -1e28), 1e28))), F.col(cost).cast("double")
    priced = F.when(F.abs(c) < GREATEST, c.cast(COST) if exact else c)  # not for NaN, which is greater than any number
    rows = items.select(F.col(group).alias("g"), F.col(key).cast("bigint").alias("k"), priced.alias("c")).where("c is not null").groupBy("g", "k", "c").agg(F.count("*").alias("n"))
    free = (F.col("c") == 0) & F.lit(cap >= 0)
    rows = written(rows, "budget_items")
    paid = rows.where(~free)
    ranges = max(1, -(-paid.count() // block))
    # without a key in the deal: ranges are told by their places
    placed = written(paid.repartitionByRange(ranges, "g", "k", "c").withColumn("r", F.spark_partition_id()), "budget_ranges")
    kinds = {"g": items.select(group).limit(0).toArrow().schema.field(0).type, "k": pa.int64(), "c": pa.decimal128(24, 9), "n": pa.int64(), "used": pa.decimal128(38, 9)}
    kind = items.schema[group].dataType.simpleString()
    if not exact:
        folds = _added(placed, float(cap), kind, kinds | {"c": pa.float64(), "used": pa.float64()})
        return _each(reduce(DataFrame.unionByName, folds, rows.where(free)), group, key, cost)
    zero = F.lit(0).cast(SUM)
    state = written(placed.groupBy("g").agg((F.min("c") < 0).alias("falls")).select(F.col("g").alias("h"), "falls", zero.alias("used"), F.lit(-1).alias("done")), "budget_state")
    falling = not state.where("falls").isEmpty()
    total = (F.col("c").cast(COST) * F.col("n").cast(COPIES)).cast(SUM)
    schema = f"g {kind}, r int, falls boolean, k bigint, c {COST}, n bigint, used {SUM}"
    marks, folded = [], []
    while not state.isEmpty():
        left = placed.join(state, F.col("g").eqNullSafe(F.col("h"))).where((F.col("r") > F.col("done")) & (F.col("falls") | (F.col("c") <= F.lit(limit).cast(SUM) - F.col("used"))))
        left = left.withColumn("t", total)
        if falling:  # within a range, sums may pass the cap and fall again
            before = F.coalesce(F.sum("t").over(Window.partitionBy("g", "r").orderBy("k", "c").rowsBetween(Window.unboundedPreceding, -1)), zero)
            left = left.withColumn("peak", (before + F.when(F.col("c") < 0, F.col("c").cast(SUM)).otherwise(F.col("t"))).cast(SUM))
        else:
            left = left.withColumn("peak", F.col("t"))
        summed = left.groupBy("g", "r").agg(F.sum("t").cast(SUM).alias("t"), (F.max if falling else F.sum)("peak").cast(SUM).alias("peak"), F.first("used").alias("used"))
        order = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        summed = summed.withColumn("start", (F.col("used") + F.coalesce(F.sum("t").over(order), zero)).cast(SUM))
        summed = summed.withColumn("over", F.col("start") + F.col("peak") > F.lit(limit).cast(SUM))
        first = F.min(F.when(F.col("over"), F.col("r"))).over(Window.partitionBy("g"))
        summed = written(summed.withColumn("first", first).where(F.col("first").isNull() | (F.col("r") <= F.col("first"))).select(F.col("g").alias("h"), F.col("r").alias("s"), "used", "start", F.coalesce(F.col("r") == F.col("first"), F.lit(False)).alias("fold")), "budget_round")
        marks.append(summed.where("not fold"))
        at = summed.where("fold").select("h", "s", "start")
        todo = left.drop("h", "used", "done", "t", "peak").join(at, F.col("g").eqNullSafe(F.col("h")) & (F.col("r") == F.col("s"))).select("g", "r", "falls", "k", "c", "n", "start")
        done = written(with_package(todo).groupBy("g", "r").applyInArrow(_fold(limit, kinds), schema), "budget_fold")
        folded.append(done.where("used is null").select("g", "k", "c", "n"))
        state = done.where("used is not null").select(F.col("g").alias("h"), "falls", "used", F.col("r").alias("done"))
    out = rows.where(free)
    if marks:
        whole = reduce(DataFrame.unionByName, marks)
        falls = placed.groupBy("g").agg((F.min("c") < 0).alias("falls")).select(F.col("g").alias("f"), "falls")
        fits = F.col("c") <= F.lit(limit).cast(SUM) - F.col("used")
        taken = placed.join(whole, F.col("g").eqNullSafe(F.col("h")) & (F.col("r") == F.col("s"))).join(falls, F.col("g").eqNullSafe(F.col("f"))).where(F.col("falls") | fits)
        out = reduce(DataFrame.unionByName, [out, taken.select("g", "k", "c", "n"), *folded])
    return _each(out, group, key, cost)


def _each(out: DataFrame, group: str, key: str, cost: str) -> DataFrame:
    """Equal items again as rows, never as one array."""
    runs = out.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 10_000))).alias("run"))
    each = runs.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(10_000).cast("bigint"), F.col("n") - F.col("run") * 10_000))))
    return each.select(F.col("g").alias(group), F.col("k").alias(key), F.col("c").cast("double").alias(cost))
