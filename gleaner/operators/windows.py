"""Row and page windows: neighbours, islands, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(rows: DataFrame, key: str, at: str, line: str, hit: str, width: int = 2) -> DataFrame:
    """key, at and the lines around each hit, joined, with their places."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(-width, width)
    around = F.collect_list(F.concat(F.lit("["), F.col(at).cast("string"), F.lit("] "), F.col(line))).over(w)
    return rows.withColumn("snippet", F.array_join(around, "\n")).where(hit).select(key, at, "snippet")


def islands(hits: DataFrame, key: str, at: str, rows: str, width: int = 2) -> DataFrame:
    """key, begin, end (half open) and number of hits of each run of windows that touch.

    Windows [at - width, at + width] are clamped to the ``rows`` that the key has; repeated hits count once.
    """
    spans = hits.select(key, at, F.greatest(F.lit(0), F.col(at) - width).alias("begin"), F.least(F.col(rows), F.col(at) + width + 1).alias("end")).distinct()
    order = Window.partitionBy(key).orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("begin") <= reach, 0).otherwise(1))
    spans = spans.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(key, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n_hits")).drop("island")


def page_scores(pages: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """The pages with size and hits of the keywords in place of the text."""
    low = F.lower(F.col(text))
    count = sum(((F.length(low) - F.length(F.replace(low, F.lit(k.lower())))) / len(k) for k in keywords), F.lit(0.0)).cast("bigint")
    return pages.withColumns({"size": F.length(text), "hits": count}).drop(text)


def page_window(scored: DataFrame, doc: str, page: str, top: int = 10, around: int = 1, budget: int = 4000) -> DataFrame:
    """doc, page and size of the pages to read: the best by ``page_scores`` and those beside them, up to a budget of characters.

    The page that crosses the budget is the last.
    """
    best = Window.partitionBy(doc).orderBy(F.desc("hits"), page)
    chosen = scored.where("hits > 0").withColumn("n", F.row_number().over(best)).where(F.col("n") <= top)
    near = chosen.select(doc, F.explode(F.sequence(F.col(page) - around, F.col(page) + around)).alias(page)).distinct()
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    read = scored.join(near, [doc, page]).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return read.where(F.col("before") < budget).select(doc, page, "size", "hits")


def sample_budget(lines: DataFrame, key: str, at: str, line: str, rows: int = 20, chars: int = 1000) -> DataFrame:
    """The first lines of each key, a header and ``rows`` more, as long as they fit ``chars`` with their line ends."""
    run = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(F.length(line) + 1).over(run)).where((F.col(at) <= rows) & (F.col("used") <= chars))


def numbered(rows: DataFrame, group: str, at: str, name: str, cuts: int = 200) -> DataFrame:
    """The rows with their place from one within the group, by ``at``; equal ones in any order.

    A group is cut at its approximate quantiles, numbered within each cut, and moved on by the counts of the cuts before.
    """
    borders = rows.groupBy(group).agg(F.percentile_approx(at, [k / cuts for k in range(1, cuts)], 10 * cuts).alias("_borders")).withColumnRenamed(group, "_of")
    cut = F.coalesce(F.size(F.filter("_borders", lambda b: b < F.col(at))), F.lit(0))
    placed = rows.join(borders, F.col(group).eqNullSafe(F.col("_of")), "left").withColumn("_cut", F.when(F.col(at).isNull(), -1).otherwise(cut)).drop("_of", "_borders")
    before = Window.partitionBy(group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cut
    counts = placed.groupBy(group, "_cut").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select(F.col(group).alias("_of"), F.col("_cut").alias("_part"), "_before")
    told = placed.withColumn(name, F.row_number().over(Window.partitionBy(group, "_cut").orderBy(at)))
    told = told.join(counts, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_cut") == F.col("_part")))
    return told.withColumn(name, F.col(name) + F.col("_before")).drop("_cut", "_of", "_part", "_before")
