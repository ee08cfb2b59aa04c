"""Rows of tables as text for a prompt: quoted lines, windows around hits, samples. No file is held whole by a task.

Rows: path, row_idx (from 0), headers (array) and fields (map of header to value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators import windows

# The mark of a row that was hit, and what parts the windows of a table.
MARK, BETWEEN = "   (this row matched the question)", "\n\n---\n\n"


def quoted(value: Column, alone: Column) -> Column:
    """A cell of a CSV line: in quotes, quotes doubled, where it holds a comma, a quote or a line end, or is empty and alone."""
    in_quotes = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike(r'[,"\r\n]') | (alone & (value == "")), in_quotes).otherwise(value)


def csv_line(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: quoted(F.coalesce(v, F.lit("")), F.size(values) == 1)), ",")


def cells(headers: Column, fields: Column) -> Column:
    return F.transform(headers, lambda h: F.coalesce(F.try_element_at(fields, h), F.lit("")))


def labelled_row(headers: Column, fields: Column) -> Column:
    """A row as `header: value | header: value`, without empty fields: what searches read."""
    shown = F.transform(F.filter(headers, lambda h: F.coalesce(F.try_element_at(fields, h), F.lit("")) != ""), lambda h: F.concat(h, F.lit(": "), fields[h]))
    return F.array_join(shown, " | ")


def window_blocks(rows: DataFrame, hits: DataFrame, width: int = 2) -> DataFrame:
    """path and block: the hit rows (path, row_idx) of each table and those around them, as lines under the header.

    Windows that touch are one; each has the header on top. Repeated hits count once; a hit beyond the table shows what
    of its window the table has, and a table with none has no block.
    """
    size = rows.groupBy("path").agg((F.max("row_idx") + 1).alias("_n"))
    once = hits.select("path", F.col("row_idx").cast("bigint").alias("row_idx")).where("row_idx is not null").distinct()
    spans = windows.islands(once.join(size, "path"), "path", "row_idx", "_n", width).where("begin < end")
    wanted = spans.select("path", "begin", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("row_idx"))
    near = rows.join(wanted, ["path", "row_idx"]).join(once.withColumn("_hit", F.lit(True)), ["path", "row_idx"], "left")
    line = F.concat(csv_line(cells(F.col("headers"), F.col("fields"))), F.when(F.col("_hit"), MARK).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))), lambda x: x["line"])
    parts = near.groupBy("path", "begin").agg(F.concat(csv_line(F.first("headers")), F.lit("\n"), F.array_join(lines, "\n")).alias("part"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("begin", "part"))), lambda x: x["part"])
    return parts.groupBy("path").agg(F.array_join(whole, BETWEEN).alias("block"))


def sample_blocks(rows: DataFrame, most: int = 5) -> DataFrame:
    """path and block: the header and the first rows of each table that has any."""
    first = rows.where(F.col("row_idx") < most)
    line = csv_line(cells(F.col("headers"), F.col("fields")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))), lambda x: x["line"])
    return first.groupBy("path").agg(F.concat(csv_line(F.first("headers")), F.lit("\n"), F.array_join(lines, "\n")).alias("block"))


def expanded_hits(rows: DataFrame, hits: DataFrame, width: int = 2) -> DataFrame:
    """path, row_idx and snippet of each hit that its table has: the rows around it, numbered, the hit marked."""
    wanted = hits.select("path", F.col("row_idx").cast("bigint").alias("_hit")).distinct().withColumn("row_idx", F.explode(F.sequence(F.col("_hit") - width, F.col("_hit") + width)))
    near = rows.join(wanted, ["path", "row_idx"])
    mark = F.when(F.col("row_idx") == F.col("_hit"), " (match)] ").otherwise("] ")
    line = F.concat(F.lit("[row "), F.col("row_idx").cast("string"), mark, labelled_row(F.col("headers"), F.col("fields")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))), lambda x: x["line"])
    found = near.groupBy("path", F.col("_hit").alias("row_idx")).agg(F.array_join(lines, "\n").alias("snippet"), F.bool_or(F.col("row_idx") == F.col("_hit")).alias("_has"))
    return found.where("_has").drop("_has")


def preview(rows: DataFrame, most: int) -> DataFrame:
    """path, row_idx, line and truncated (as many rows as asked for, or more) of each table's first rows."""
    more = F.max("row_idx").over(Window.partitionBy("path")) + 1 >= most
    line = csv_line(cells(F.col("headers"), F.col("fields")))
    return rows.select("path", "row_idx", line.alias("line")).where(F.col("row_idx") < most).withColumn("truncated", more)
