"""Readers of a file corpus: discovery, texts, CSV rows, notebooks, configs, JSON documents, summaries in Markdown."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.router import DOT_FILES, kind_of
from gleaner.sources.peeks import lossy
from gleaner.workers import with_package


# Kinds of data files that are left out unless asked for.
DATA = (".json", ".csv", ".dat")


def qualified(spark: SparkSession, root: str) -> str:
    """The root as Spark names it in paths of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _skipped(spark: SparkSession, root: str) -> DataFrame:
    """Files that Spark does not list, as a name on their way begins with a dot or an underscore; the driver lists them."""
    path, rows = spark._jvm.org.apache.hadoop.fs.Path(root), []
    found, top = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), qualified(spark, root).rstrip("/")
    while found.hasNext():
        status = found.next()
        name = status.getPath().toString()
        if any(p.startswith((".", "_")) for p in name[len(top) :].split("/")):
            rows.append((name, status.getLen(), status.getModificationTime() / 1000))
    return spark.createDataFrame(rows, "path string, size bigint, mtime double").withColumn("mtime", F.timestamp_seconds("mtime"))


def discover(spark: SparkSession, root: str, excluded: tuple[str, ...] = ("node_modules", "__pycache__"), hidden: bool = False, data: bool = True, unlisted: bool = False) -> DataFrame:
    """path, size, mtime, ext and parent of the files below root, or of the root if it is a file; no content is read.

    Hidden and excluded folders below the root are left out, whatever lies above it; hidden files too, but for known
    ones that are text; ``hidden`` keeps both. Without ``data``, JSON, CSV and DAT files are left out. Spark's own listing
    skips names with a dot or an underscore in front; ``unlisted`` adds them, listed by the driver.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    if unlisted:
        found = found.unionByName(_skipped(spark, root))
    top = qualified(spark, root).rstrip("/")
    below = F.when(F.col("path") == top, F.array().cast("array<string>")).otherwise(F.split(F.substring("path", len(top) + 2, 1 << 20), "/"))
    parts, name = F.split("path", "/"), F.element_at(F.split("path", "/"), -1)
    folders = F.slice(below, F.lit(1), F.greatest(F.size(below) - 1, F.lit(0)))
    pruned = F.exists(folders, lambda p: (p.startswith(".") & F.lit(not hidden)) | p.isin(*excluded))
    unseen = (F.size(below) > 0) & name.startswith(".") & ~name.isin(*DOT_FILES) & F.lit(not hidden)
    out = found.where(~pruned & ~unseen).select("path", "size", "mtime", F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)).alias("ext"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("parent"))
    return out if data else out.where(~F.col("ext").isin(*DATA))


def of_kinds(found: DataFrame, *exts: str) -> DataFrame:
    """The files with one of the extensions."""
    return found.where(F.col("ext").isin(*exts))


def contents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size and content of the files below a folder whose name matches."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return found.select("path", F.col("length").alias("size"), "content")


ROWS = "path string, row_idx bigint, headers array<string>, fields map<string,string>, error string"


def csv_rows(spark: SparkSession, root: str, latin: bool = False) -> DataFrame:
    """path, row_idx (from 0, in the order of the file), headers, fields (header to value) and error of CSV files.

    Quoted line ends stay within a row; bytes that are no UTF-8 are left out, or, with ``latin``, make the file one of
    Latin-1; missing fields are empty. A file is read by one task, since only its whole gives the rows their numbers; one
    that cannot be read to its end has a last row with the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit((1 << 31) - 1)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data, part, i = content.as_py() or b"", [], -1
                try:
                    text = data.decode("utf-8", "strict" if latin else "ignore")
                except UnicodeDecodeError:
                    text = data.decode("latin-1")
                found = csv.DictReader(io.StringIO(text, newline=""))
                try:
                    for i, row in enumerate(found):
                        part.append((path, i, found.fieldnames, [(k, v or "") for k, v in row.items() if k is not None], None))
                        if len(part) == 10_000:
                            yield batch_of(part)
                            part = []
                except csv.Error as e:
                    part.append((path, i + 1, None, None, str(e)))
                if part:
                    yield batch_of(part)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "row_idx", "headers", "fields", "error"])

    return contents(spark, root, "*.csv").select("path", "content").mapInArrow(run, ROWS)


def csv_preview(rows: DataFrame, most: int = 100) -> DataFrame:
    """path, n_rows and text of each table: its header and first rows, cells between commas."""
    line = F.when(F.col("row_idx") < most, F.struct("row_idx", F.array_join(F.transform("headers", lambda h: F.coalesce(F.try_element_at("fields", h), F.lit(""))), ",").alias("t")))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"])
    return rows.where("headers is not null").groupBy("path").agg(F.count("*").alias("n_rows"), F.concat_ws("\n", F.array_join(F.first("headers"), ","), F.array_join(lines, "\n")).alias("text"))


def head_text(content: Column, size: int = 2048) -> Column:
    """The first bytes of a file as text, without what is no UTF-8."""
    return lossy(F.substring(content, 1, size))


def texts(files: DataFrame) -> DataFrame:
    """path and text of text, code and config files (path, content), whole."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = kind_of(F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)), name)
    return files.where(kind.isin("text", "code", "config", "dotfile")).select("path", lossy(F.col("content")).alias("text"))


def html_texts(files: DataFrame) -> DataFrame:
    """path, text and error of web pages (path, content); one without text is an error."""
    text = T.plain_html(lossy(F.col("content")))
    return files.select("path", F.when(text != "", text).alias("text"), F.when(F.coalesce(text, F.lit("")) == "", "no text in this page").alias("error"))


def configs(files: DataFrame) -> DataFrame:
    """dir, accuracy, visual, budget_gb and include_dotfiles of folders' YAML configs (path, content); bad files wish nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    said = yaml.safe_load((content.as_py() or b"").decode("utf-8", "replace"))
                except yaml.YAMLError:
                    said = None
                said = said if isinstance(said, dict) else {}
                gb = said.get("t4_budget_gb_override")
                word = lambda n: str(said[n]) if said.get(n) is not None else None  # noqa: E731, B023
                rows.append((path.rpartition("/")[0], word("accuracy"), word("colpali"), float(gb) if isinstance(gb, (int, float)) else None, bool(said.get("include_dotfiles", False))))
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["dir", "accuracy", "visual", "budget_gb", "include_dotfiles"])

    return with_package(files.select("path", "content")).mapInArrow(run, "dir string, accuracy string, visual string, budget_gb double, include_dotfiles boolean")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of JSON documents that are lists, or one entry each; an entry that does not fit the schema is left out."""
    whole = spark.read.option("wholetext", True).text(path)
    entries = whole.select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).alias("_e"))
    read = F.from_json("_e", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return entries.select(read.alias("_r")).where("_r is not null and _r._corrupt is null").select("_r.*").drop("_corrupt")


def json_entries(spark: SparkSession, path: str, schema: str, key: str = "path") -> DataFrame:
    """The entries of a JSON document that maps keys to objects, as rows with the key; unknown fields are left out."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{schema}>>")).alias(key, "_e")).select(key, "_e.*")


def notebook_text(content: Column) -> Column:
    """The cells of a notebook under `# Cell N (type)` headings; their source is a text or a list of lines."""
    cells = F.from_json(content, "cells array<struct<cell_type string, source string>>")["cells"]
    lines = F.transform(cells, lambda c: F.coalesce(F.array_join(F.from_json(c["source"], "array<string>"), ""), c["source"]))
    heads = F.transform(cells, lambda c, i: F.concat(F.lit("# Cell "), (i + 1).cast("string"), F.lit(" ("), c["cell_type"], F.lit(")\n")))
    return F.array_join(F.zip_with(heads, lines, lambda h, t: F.concat(h, t)), "\n\n")


def summary(content: Column) -> dict[str, Column]:
    """The fields of a summary: its body begins after the first line with `# ` and ends at a line that begins with `**`.

    Body lines are stripped and joined by blanks; further lines with `# ` are left out. A list that is empty or a dash has
    no members.
    """
    lines = F.split(F.trim(content, F.lit(" \t\r\n")), "\n")
    head = F.array_position(F.transform(lines, lambda x: x.startswith("# ")), True).cast("int")
    after = F.when(head > 0, F.slice(lines, head + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    end = F.array_position(F.transform(after, lambda x: x.startswith("**")), True).cast("int")
    body = F.when(end > 0, F.slice(after, F.lit(1), end - 1)).otherwise(after)
    kept = F.filter(F.transform(F.filter(body, lambda x: ~x.startswith("# ")), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")
    bold = lambda name: F.trim(F.regexp_extract(content, rf"\*\*{name}:\*\*[ \t]*([^\n]*)", 1), F.lit(" \t\r"))
    parts = lambda name: F.filter(F.transform(F.split(bold(name), ","), lambda x: F.trim(x)), lambda x: x != "")
    listed = lambda name: F.when(bold(name).isin("", "—"), F.array().cast("array<string>")).otherwise(parts(name))
    first = F.get(lines, F.lit(0))
    return {
        "source": F.when(first.startswith("Source:"), F.trim(F.substring(first, 8, 1 << 20))).otherwise(""), "title": F.when(head > 0, F.trim(F.substring(F.element_at(lines, head), 3, 1 << 20))).otherwise(""),
        "summary": F.array_join(kept, " "), "content_type": bold("Content type"), "keywords": listed("Keywords"), "entities": listed("Key entities"), "identifiers": listed("Identifiers"),
    }


def parse_summaries(df: DataFrame, content: str = "value") -> DataFrame:
    return df.select(*(c.alias(n) for n, c in summary(F.col(content)).items()))
