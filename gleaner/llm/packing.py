"""Best-fit packing planned over the histogram of lengths.

Best-fit decreasing never looks at a document, only at its length, so the plan is made over (length, count)
pairs: at most ``capacity`` of them, whatever the corpus. Documents then take planned slots by a join on their
rank within their length.

Cases: a null text counts as empty (a piece of one token, the end mark); an empty table gives an empty result;
repeated rows are packed as often as they occur; further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import text_chunks, with_package, written
from gleaner.llm.pieces import Encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Ranks that share a key of the join between pieces and slots; also the pieces that are ranked together.
BLOCK = 4096

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first, which takes what is over."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and the CRC-32 of the little-endian unsigned 32-bit ids of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", 8_000_000):
            doc_ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, ids in zip(doc_ids, encoder(vocabulary)([t or "" for t in batch.column("text").to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n])) for k, (at, n) in enumerate(cut(len(ids), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return with_package(docs.select("doc_id", "text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, number, first sequence, number for each sequence, offset).

    Sequences that are filled alike stay one group: a run of sequence numbers with the same room left.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    room: list[int] = []  # sorted
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, number)
    made = 0

    def leave(left: int, first: int, number: int) -> None:
        if left and number:
            if left not in groups:
                insort(room, left)
                groups[left] = []
            groups[left].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            k = bisect_left(room, length)
            if k < len(room):
                left = room[k]
                first, number = groups[left].pop()
                if not groups[left]:
                    del groups[left], room[k]
            else:
                left, first, number = capacity, made, -(-rest // (capacity // length))
                made += number
            each = left // length
            full = min(number, rest // each)
            if full:
                out.append((length, rank, full * each, first, each, capacity - left))
                leave(left - each * length, first, full)
                rank, rest, first, number = rank + full * each, rest - full * each, first + full, number - full
            if number and rest:  # fewer are left than one sequence would take
                out.append((length, rank, rest, first, rest, capacity - left))
                leave(left - rest * length, first, 1)
                rest, first, number = 0, first + 1, number - 1
            leave(left, first, number)
    return out


def ranked(found: DataFrame, total: int) -> DataFrame:
    """Adds rank, from 0, within each length.

    A length may hold a third of all rows, so rows are ranked within hashed parts of a length, and the parts'
    sizes, summed in order, give where each begins.
    """
    parts = max(1, -(-total // BLOCK))
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(parts)))
    sizes = found.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begins"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    return found.withColumn("n", F.row_number().over(within)).join(begins, ["length", "part"]).withColumn("rank", F.col("begins") + F.col("n") - 1).drop("part", "n", "begins")


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Gives each piece (with a length up to ``capacity``) its sequence and its place there.

    Goes through the driver: the histogram, of at most ``capacity`` rows, and the plan made from it.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    slots = spark.createDataFrame(plan(counts, capacity), "length bigint, first_rank bigint, number bigint, first_sequence bigint, each bigint, begin bigint")
    block = lambda c: F.floor(c / BLOCK)
    slots = slots.withColumn("block", F.explode(F.sequence(block(F.col("first_rank")), block(F.col("first_rank") + F.col("number") - 1))))
    rows = ranked(found, sum(counts.values())).withColumn("block", block(F.col("rank")))
    placed = rows.join(slots, ["length", "block"]).where("rank >= first_rank and rank < first_rank + number")
    nth = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("begin") + nth % F.col("each") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs whole documents, each followed by ``end_id``, into as few sequences as best-fit finds.

    The pieces are written once, so that the histogram, the ranks and the result agree on them.
    """
    return pack(written(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
