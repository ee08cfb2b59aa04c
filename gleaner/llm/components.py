"""Connected components of a table of links, by alternating steps over whole neighbourhoods.

A large step links every neighbour above a node to the least node of its neighbourhood, a small step every one
below it; both together reach stars around each component's least node in a few rounds. Each round aggregates
partially and joins, hot nodes apart from the others (``joined``), so that a node with very many links fills no task;
it is written to the shared folder, and the table of the round before it is deleted.

Cases: an empty table has no nodes; repeated links count once; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.llm.common import discard, joined, written

#: Rows of two numbers that a single task holds with ease (16 MB).
FEW = 1_000_000


def _step(links: DataFrame, both: bool, total: int) -> DataFrame:
    """links: a > b. Large (both): of all neighbours; small: of those below."""
    near = links.union(links.select("b", "a")) if both else links
    least = near.groupBy(F.col("a")).agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    told = joined(near, least, ["a"], total, FEW)
    if both:
        out = told.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = told.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links written, and their number and a sum of hashes, which the write itself counts."""
    seen = Observation()
    out = written(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
    return out, (seen.get["n"], seen.get["h"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the least node that it is linked to, of each node that has links (a bigint, b bigint).

    Rows with a null, and links of a node to itself, count for nothing. ``rounds`` guards against a fault only:
    if the stars still change by then, an error is raised.
    """
    links, now = _kept(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        before, last = now, links
        large = _step(links, True, 2 * before[0])
        links, now = _kept(_step(large, False, before[0]))
        discard(last)
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
    raise RuntimeError(f"components still change after {rounds} rounds")
