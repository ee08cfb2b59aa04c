"""Tiers: what each makes of its files. The preview tier needs no model; the others take one as a callable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import routing
from gleaner.functions import text as T
from gleaner.operators.answering import summary_markdown
from gleaner.sources.files import head_text


def _title(path: Column) -> Column:
    return T.title(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", ""))


def previewed(files: DataFrame, previews: DataFrame) -> DataFrame:
    """path and markdown of large files (path, size, content): the head of a text, or header and first rows of a table.

    previews: path, n_rows and text of tables.
    """
    name, size = F.element_at(F.split("path", "/"), -1), F.col("size").cast("string")
    is_table = F.lower("path").endswith(".csv")
    told = files.join(previews.select("path", "n_rows", F.col("text").alias("_t")), "path", "left")
    rows = F.concat(F.coalesce("n_rows", F.lit(0)).cast("string"), F.lit(" rows"))
    body = F.when(is_table, F.coalesce("_t", F.lit(""))).otherwise(head_text(F.col("content")))
    body = F.when(F.trim(body, F.lit(" \t\r\n")) != "", body).otherwise(F.concat(F.lit("(could not preview; file is "), size, F.lit(" bytes — use ripgrep at query time)")))
    bytes_ = F.concat(size, F.lit(" bytes"))
    title = F.concat(_title(F.col("path")), F.when(is_table, F.concat(F.lit(" — CSV, "), rows)).otherwise(F.concat(F.lit(" — "), F.floor(F.col("size") / 1024).cast("string"), F.lit(" KB preview"))))
    keywords = F.when(is_table, F.array(name, F.lit("csv"), F.lit("large"))).otherwise(F.array(name, F.lit("large"), F.lit("preview-only")))
    identifiers = F.when(is_table, F.array(name, rows, bytes_)).otherwise(F.array(name, bytes_))
    none = F.array().cast("array<string>")
    return told.select("path", summary_markdown(F.col("path"), title, body, F.when(is_table, "csv").otherwise("text-large"), keywords, none, identifiers).alias("markdown"))


def table_markdown(summaries: DataFrame, rows: DataFrame) -> DataFrame:
    """path and markdown: the summaries (path, markdown) of tables with what their rows (path, row_idx, headers) tell."""
    stats = rows.where("headers is not null").groupBy("path").agg(F.count("*").alias("n"), F.first("headers").alias("headers"))
    block = routing.table_stats(F.col("n"), F.coalesce("headers", F.array().cast("array<string>")))
    return summaries.join(stats, "path", "left").select("path", F.concat("markdown", F.coalesce(block, F.lit(""))).alias("markdown"))


def once_a_content(files: DataFrame, expensive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an expensive step makes of files (path, content_hash, ...), run once for each content and told to all its files.

    expensive: from the first file of each content to content_hash and any columns.
    """
    first = files.groupBy("content_hash").agg(F.min("path").alias("path"))
    made = expensive(files.join(first, ["content_hash", "path"], "left_semi"))
    return files.select("path", "content_hash").join(made, "content_hash")
