"""CSV files of any size, read by many tasks: quoted line ends are told across splits, and rows numbered by counts.

Spark's text source splits a file into blocks at line feeds. What a line does to the reader's state (inside a quoted field or not)
is a map of two states; a task composes those of its block, and the blocks' maps, composed in the order of the file, tell
in which state each block begins. Lines that begin and end outside are rows of their own and stay where they are; only lines
of quoted fields that hold line ends are brought together.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.joins import joined
from gleaner.staging import written
from gleaner.workers import with_package

ROWS = "path string, row_idx bigint, headers array<string>, fields map<string,string>, error string"
_ROW_KINDS = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string())


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether the reader is inside a quoted field at the line's end, as it was at its begin.

    A quote opens a field only as its first sign, and a second one closes it unless doubled; others are signs like any.
    """
    if b'"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if not inside:
            if at < n and line[at] == 34:
                at += 1
            else:  # to the next field; a lone carriage return ends a row, and so a field
                ends = [k for k in (line.find(b",", at), line.find(b"\r", at)) if k >= 0]
                if not ends:
                    return False
                at = min(ends) + 1
                continue
        while True:
            close = line.find(b'"', at)
            if close < 0:
                return True
            if line[close + 1 : close + 2] != b'"':
                break
            at = close + 2
        at, inside = close + 1, False
        ends = [k for k in (line.find(b",", at), line.find(b"\r", at)) if k >= 0]
        if not ends:
            return False
        at = min(ends) + 1


def marked(lines: DataFrame) -> DataFrame:
    """Adds, for a block that begins outside (0) or inside (1): whether the line begins inside (s), ends inside (a), and which of the
    block's row starts it belongs to (c, from 1; 0: to one of a block before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, count = None, [False, True], [0, 0]
        for batch in batches:
            out: list[tuple] = []
            for path, block, line in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("line").to_pylist()):
                if (path, block) != own:
                    own, state, count = (path, block), [False, True], [0, 0]
                before = state
                count = [c + (not s) for c, s in zip(count, before)]
                state = [inside_after(line, s) for s in before]
                out.append((*before, *state, *count))
            kinds = (pa.bool_(),) * 4 + (pa.int64(),) * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "s0", "s1", "a0", "a1", "c0", "c1"])

    return with_package(lines).mapInArrow(run, "path string, block bigint, at bigint, line binary, s0 boolean, s1 boolean, a0 boolean, a1 boolean, c0 bigint, c1 bigint")


def begun(blocks: DataFrame) -> DataFrame:
    """path, block, began (inside), and the block and number of the row start that its first lines may belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by("block")
        inside, owner, out = False, (0, 0), []
        for r in t.to_pylist():
            out.append((r["path"], r["block"], inside, *owner))
            starts = r["n1"] if inside else r["n0"]
            owner = (r["block"], starts) if starts else owner
            inside = r["a1"] if inside else r["a0"]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["path", "block", "began", "of_block", "of_start"])

    return with_package(blocks).groupBy("path").applyInArrow(run, "path string, block bigint, began boolean, of_block bigint, of_start bigint")


def parsed(pieces: DataFrame, latin: DataFrame | None) -> DataFrame:
    """path, block, start, j, fields and error of the rows of each piece of text; ``latin``: paths that are not UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit((1 << 31) - 1)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                text = (r["data"] or b"").decode("latin-1") if r["latin"] else (r["data"] or b"").decode("utf-8", "ignore")
                place, j = (r["path"], r["block"], r["start"]), 0
                try:
                    for fields in csv.reader(io.StringIO(text, newline="")):
                        if fields:
                            out.append((*place, j, fields, None))
                            j += 1
                except csv.Error as e:
                    out.append((*place, j, None, str(e)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["path", "block", "start", "j", "fields", "error"])

    told = pieces.join(latin.withColumn("latin", F.lit(True)), "path", "left") if latin is not None else pieces.withColumn("latin", F.lit(False))
    return with_package(told.select("path", "block", "start", "data", F.coalesce("latin", F.lit(False)).alias("latin"))).mapInArrow(run, "path string, block bigint, start bigint, j bigint, fields array<string>, error string")


def large_csv_rows(spark: SparkSession, root: str, latin: bool = False, glob: str = "*.csv") -> DataFrame:
    """The rows of ``files.csv_rows``, of files of any size and read by as many tasks as a file has blocks.

    A row that cannot be read has an error, and those after it are read on. A byte order mark is left out. Null and empty
    files have no rows; a header alone has none; further cases are those of ``files.csv_rows``.
    """
    source = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(root)
    lines = source.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    told = written(marked(lines), "csv_lines")
    last = lambda c: F.max_by(c, "at").alias(c)
    blocks = told.groupBy("path", "block").agg(last("a0"), last("a1"), F.max("c0").alias("n0"), F.max("c1").alias("n1"))
    both = told.join(begun(blocks), ["path", "block"])  # a block is of bounded size
    pick = lambda c: F.when(F.col("began"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    both = both.select("path", "block", "at", "line", pick("s").alias("inside"), pick("a").alias("open"), pick("c").alias("start"), "of_block", "of_start")
    alone = both.where("not inside and not open").select("path", "block", "start", F.col("line").alias("data"))
    shared = both.where("inside or open").withColumns({"block": F.when(F.col("start") == 0, F.col("of_block")).otherwise(F.col("block")), "start": F.when(F.col("start") == 0, F.col("of_start")).otherwise(F.col("start"))})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("line").cast("string").alias("line")))), lambda x: x["line"]), "\n")
    together = shared.groupBy("path", "block", "start").agg(text.cast("binary").alias("data"))
    broken = told.where(~F.is_valid_utf8(F.col("line").cast("string"))).select("path").distinct() if latin else None
    rows = written(parsed(alone.unionByName(together), broken), "csv_rows")
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("path", "block").orderBy("start", "j"))
    numbered = rows.withColumn("k", within).join(counts.withColumn("before", before).drop("n"), ["path", "block"]).withColumn("row_idx", F.col("before") + F.col("k") - 2)
    numbered = written(numbered.select("path", "row_idx", "fields", "error"), "csv_numbered")
    sizes = numbered.groupBy("path").agg(F.count("*").alias("n"))
    headers = numbered.where("row_idx = -1").select("path", F.coalesce("fields", F.array().cast("array<string>")).alias("headers")).join(sizes, "path")
    found = joined(numbered.where("row_idx >= 0"), headers, ["path"], numbered.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                values = r["fields"] or []
                named = dict(zip(r["headers"], [*values, *[""] * (len(r["headers"]) - len(values))]))
                out.append((r["path"], r["row_idx"], None if r["error"] else r["headers"], None if r["error"] else list(named.items()), r["error"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, _ROW_KINDS)], names=[c.split()[0] for c in ROWS.split(", ")])

    return with_package(found.select("path", "row_idx", "headers", "fields", "error")).mapInArrow(run, ROWS)
