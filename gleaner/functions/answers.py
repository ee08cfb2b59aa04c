"""Column expressions over models' replies and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repaired(raw: Column, schema: str) -> Column:
    """The object in a reply: the reply itself, else what its code fence holds, else its outermost braces; else null."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    is_object = lambda x: x.rlike(r"(?s)^\s*\{") & F.try_parse_json(x).isNotNull()
    return F.coalesce(*(F.when(is_object(x), F.from_json(x, schema)) for x in (raw, fenced, braces)))


def after_thinking(reply: Column, marker: str) -> Column:
    """What follows the last marker of a reply, or all of it."""
    return F.trim(F.substring_index(reply, marker, -1), F.lit(" \t\r\n"))


def citations(answer: Column, n_sources: Column) -> dict[str, Column]:
    """cited: numbers in `[N]` that name a source, each once in order; orphans: those that name none."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))
    names = lambda n: (n >= 1) & (n <= n_sources)
    return {"cited": F.filter(found, names), "orphans": F.filter(found, lambda n: ~names(n))}


def category_codes(text: Column) -> Column:
    """Codes of two or three capitals before a bracket, else within brackets; each once, in order."""
    before = F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,3})\s*\("), F.lit(1))
    within = F.regexp_extract_all(text, F.lit(r"\(([A-Z]{2,3})\)"), F.lit(1))
    return F.array_distinct(F.when(F.size(before) > 0, before).otherwise(within))


def embedding_text(title: Column, summary: Column, *lists: Column) -> Column:
    """Title, summary and lists (parts between commas), between spaces; what is null or empty leaves no trace."""
    full = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", full(title), full(summary), *(full(F.array_join(x, ", ")) for x in lists))


def sections(lines: DataFrame, key: str, at: str, line: str, header: str) -> DataFrame:
    """key, section (from 0, before the first header), head and n_lines of texts cut at lines that match ``header``."""
    run = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col(line).rlike(header)
    marked = lines.withColumn("_head", F.when(is_head, F.col(line))).withColumn("section", F.count(F.when(is_head, 1)).over(run))
    return marked.groupBy(key, "section").agg(F.max("_head").alias("head"), F.count("*").alias("n_lines"))


def best_per_key(rows: DataFrame, key: str, score: str, place: str) -> DataFrame:
    """The best score of each key and its place, the earliest among equals."""
    return rows.groupBy(key).agg(F.max(score).alias(score), F.max_by(place, F.struct(F.col(score), -F.col(place))).alias(place))
