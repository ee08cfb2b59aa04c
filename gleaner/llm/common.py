"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from gleaner.operators.joins import joined  # noqa: F401  shared by the operators
from gleaner.staging import GROUP, discard, discarded, scratch, shared_dir, written  # noqa: F401
from gleaner.workers import with_package  # noqa: F401

#: ASCII white space: the word separator of every contract here, and what ``bytes.split()`` splits on.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int) -> DataFrame:
    """doc_id, label and text of a bounded sample of distinct labelled rows, whole texts.

    Rows are taken in the order of hashes of their ids, ``max_rows`` at most; a text that would take the sample over
    ``max_bytes``, or is over a twentieth of it by itself, is left out, and those after it are asked on. Labels other
    than 0 and 1 count for nothing; of several for one id the greatest counts.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows bounds both sides that are sent to every task
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("_h", F.xxhash64("text"))
    sizes = rows.groupBy("doc_id", "_h").agg(F.max(F.octet_length("text")).alias("_size")).orderBy(F.xxhash64("doc_id"), "doc_id", "_h").limit(max_rows)
    room, taken = max_bytes, []
    for r in sizes.collect():  # max_rows ids and sizes
        if r["_size"] <= min(room, max_bytes // 20):
            taken.append((r["doc_id"], r["_h"]))
            room -= r["_size"]
    taken = docs.sparkSession.createDataFrame(taken, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _h bigint")
    return rows.join(F.broadcast(taken), ["doc_id", "_h"]).groupBy("doc_id", "_h").agg(F.max("label").alias("label"), F.first("text").alias("text")).select("doc_id", "label", "text")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it, whatever the case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def extended(schema: StructType, name: str, kind: DataType) -> StructType:
    """The schema with one more column, in a copy."""
    return StructType([*schema.fields, StructField(name, kind)])


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each (one text is never cut), nulls as they are."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def remainder(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def words_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All words of the texts, in order, and how many each text has; nulls have none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    total = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    ends = np.cumsum(pc.list_value_length(split).to_numpy())
    return flat.filter(full), np.diff(np.append(0, total[ends])).astype(np.int64)
