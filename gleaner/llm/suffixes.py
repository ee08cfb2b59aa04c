"""Suffix-array dedup: bytes under a string of LENGTH that an earlier document holds too, by prefix doubling.

Only equality of ranks is asked for here, so a rank is a name: a position's name for 2s bytes is made of its name
for s bytes and that of the position s further on. Within a text names double from 1 byte to 16, and overlapping
pairs reach 24, 32 and 50. Spark sorts positions by name at growing lengths, and those that no second document
shares leave:

1. 24 bytes. Of the 27 such names in a string of 50 bytes the least is its anchor, which the string alone decides,
   so equal strings have equal anchors. Consecutive strings with one anchor are a row, their stretch; rows
   are sorted by anchor, then stretch (the pair of names of its first and last 50 bytes), then document. A row
   whose stretch an earlier document holds is covered whole. Anchors of one document alone are dropped.
2. 50 bytes. Where an anchor has several stretches, each of their strings is sorted in the same way.

A hot string does no harm: rows are dealt over tasks by ranges of name, and of document within a name that would
fill several tasks; such names are judged by aggregation and join, which Spark splits.
Names are of 64 bits and compared in pairs.

Cases: a null text counts as empty; rows with a null id are kept whole and cover nothing; rows of one id never
cover each other, whatever their texts; very long texts are read in overlapping parts; an empty table gives an empty
result; further columns are not read (``remove`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import discarded, joined, scratch, text_chunks, unused, with_package, written

#: Bytes of an anchor and of a string; a string holds LENGTH - GRAM + 1 anchors' places.
GRAM, LENGTH = 24, 50
#: Low bits of a key that hold a position within the texts read at once; longer texts are read in overlapping parts.
PLACE = 18
PART = (1 << PLACE) - 1024
#: Bytes of texts read at once: few enough for a processor's cache.
READ = 120_000
#: Borders that a name takes before it is cut between tasks.
CUT = 3

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    x = first * _A
    x += second
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def names(data: np.ndarray) -> np.ndarray:
    """Names of the 16 bytes from each position on, as far as the data go."""
    at, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < 16:
        at = paired(at[:-size], at[size:])
        size *= 2
    return at


def long_names(short: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the 50 bytes from each of the positions on."""
    return paired(paired(short[at], short[at + 16]), paired(short[at + 18], short[at + 34]))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, first and last start of strings with one anchor, the anchor's name, the stretch's name.

    data: texts one after another, ``ends`` their ends; a string never crosses an end.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < LENGTH:
        return none
    sixteen = names(data)
    short = paired(sixteen[: 16 - GRAM], sixteen[GRAM - 16 :])
    place = np.uint64((1 << PLACE) - 1)
    key = (short & ~place) | np.arange(len(short), dtype=np.uint64)
    width, least = LENGTH - GRAM + 1, 1
    while 2 * least <= width:
        key = np.minimum(key[:-least], key[least:])
        least *= 2
    key = np.minimum(key[: len(key) - (width - least)], key[width - least :])
    anchor = (key & place).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    count = np.maximum(sizes - LENGTH + 1, 0)
    fits = np.repeat(np.arange(len(ends)), count)
    if not len(fits):
        return none
    starts = np.arange(len(fits)) - np.repeat(np.cumsum(count) - count, count) + begins[fits]
    own = anchor[starts]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (fits[1:] != fits[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    lo, hi, a, which = starts[first], starts[last], own[first], fits[first]
    stretch = paired(paired(long_names(sixteen, lo), long_names(sixteen, hi)), ((hi - lo) * 64 + (a - lo)).astype(np.uint64))
    return which, lo - begins[which], hi - begins[which], short[a].view(np.int64), stretch.view(np.int64)


#: A row: an anchor's or string's name, the stretch's, the document, and the first start and how many follow it.
ROW = np.dtype([("gram", "<i8"), ("stretch", "<i8"), ("doc", "<i8"), ("lo", "<i8"), ("mark", "<i4"), ("more", "<i4")])
KINDS = {"<i8": "bigint", "<i4": "int"}
#: What a row can be found to be.
OPEN, COVERED, UNKNOWN = 0, 1, 2

Blocks = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """A row for each anchor of batches with doc_id, mark and text."""
    for batch in text_chunks(batches, "text"):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        docs, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
        parts = [(k, at, t[at : at + PART]) for k, t in enumerate(texts) for at in range(0, max(1, len(t) - LENGTH + 1), PART - LENGTH + 1)]
        out, first = [], 0
        while first < len(parts):
            last, total = first, 0
            while last < len(parts) and (last == first or total + len(parts[last][2]) <= READ):
                total += len(parts[last][2])
                last += 1
            owner, cut, data = zip(*parts[first:last])
            which, lo, hi, gram, stretch = anchors(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(p) for p in data]))
            found = np.empty(len(which), ROW)
            owner = np.array(owner)[which]
            found["gram"], found["stretch"], found["doc"], found["mark"] = gram, stretch, docs[owner], marks[owner]
            found["lo"], found["more"] = lo + np.array(cut)[which], hi - lo
            out.append(found)
            first = last
        if out:
            yield np.concatenate(out)


def string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """A row for each string of batches with doc_id, mark, text and the stretches asked for."""
    for batch in text_chunks(batches, "text"):
        out = []
        asked_lo, asked_more = (batch.column("at").flatten().field(c).to_numpy() for c in ("lo", "more"))
        ends = np.cumsum(pc.list_value_length(batch.column("at")).to_numpy())
        for k, (doc, mark, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text")))):
            data = np.frombuffer((text or "").encode(), np.uint8)
            own = slice(ends[k - 1] if k else 0, ends[k])
            # how many stretches begin, less those that have ended
            depth = np.bincount(asked_lo[own], minlength=len(data) + 1) - np.bincount(asked_lo[own] + asked_more[own] + 1, minlength=len(data) + 1)
            asked = np.flatnonzero(np.cumsum(depth) > 0)
            for begin in range(0, len(data), PART - LENGTH):
                starts = asked[np.searchsorted(asked, begin) : np.searchsorted(asked, begin + PART - LENGTH)] - begin
                if len(starts):
                    short = names(data[begin : begin + PART])
                    found = np.zeros(len(starts), ROW)
                    found["gram"], found["stretch"] = long_names(short, starts).view(np.int64), paired(short[starts + 34], short[starts]).view(np.int64)
                    found["doc"], found["mark"], found["lo"] = doc, mark, begin + starts
                    out.append(found)
        if out:
            yield np.concatenate(out)


def packed(found: np.ndarray) -> bytes:
    """The rows' bytes, plane after plane, of names and of differences between rows, which leaves much to compress."""
    out = []
    for name in ROW.names:
        x = found[name] if name in ("gram", "stretch") else np.diff(found[name], prepend=found[name].dtype.type(0))
        out.append(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(found), -1).T))
    return b"".join(x.tobytes() for x in out)


def unpacked(block: bytes) -> np.ndarray:
    found, at = np.empty(len(block) // ROW.itemsize, ROW), 0
    for name in ROW.names:
        kind = ROW[name]
        planes = np.frombuffer(block, np.uint8, kind.itemsize * len(found), at).reshape(kind.itemsize, -1)
        x = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
        found[name] = x if name in ("gram", "stretch") else np.cumsum(x, dtype=kind)
        at += planes.size
    return found


def mark_of(text: str) -> Column:
    return (F.crc32(F.coalesce(text, F.lit("")).cast("binary")) - F.lit(1 << 31)).cast("int")


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and a checksum that tells texts of one id apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", mark_of("text").alias("mark"))


def borders(sample: DataFrame, blocks: Blocks, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and documents at which the ranges of ``number`` tasks begin. Only the tasks' balance hangs on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(found[c][::7].copy()) for c in ("gram", "doc")], names=["gram", "doc"])

    got = with_package(sample).mapInArrow(run, "gram bigint, doc bigint").toArrow()
    gram, doc = got["gram"].to_numpy(), got["doc"].to_numpy()
    order = np.lexsort((doc, gram))
    at = order[np.linspace(0, len(order), number, endpoint=False)[1:].astype(int)] if len(order) else order
    gram, doc = gram[at], doc[at]
    # a name is cut only where it fills tasks by itself
    _, which, times = np.unique(gram, return_inverse=True, return_counts=True)
    doc[times[which] < CUT] = -(1 << 63)
    return gram, doc


def task_of(gram: np.ndarray, doc: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which range each row lies in."""
    if not len(at[0]):
        return np.zeros(len(gram), np.int32)
    out = np.searchsorted(at[0], gram, side="right")
    # a name at a border: documents decide
    for name in np.unique(at[0][np.maximum(out - 1, 0)][at[0][np.maximum(out - 1, 0)] == gram]):
        lo, hi, own = *(int(np.searchsorted(at[0], name, side=x)) for x in ("left", "right")), np.flatnonzero(gram == name)
        out[own] = lo + np.searchsorted(at[1][lo:hi], doc[own], side="right")
    return out.astype(np.int32)


def judged(found: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A task's rows in order with what they are found to be; cut: names that other tasks hold as well.

    Rows that are neither covered nor, at an anchor with several stretches, open are left out.
    """
    found = found[np.lexsort((found["doc"], found["stretch"], found["gram"]))]
    gram, stretch, doc = found["gram"], found["stretch"], found["doc"]
    new = np.append(True, gram[1:] != gram[:-1])
    begin = np.flatnonzero(np.append(True, new[1:] | (stretch[1:] != stretch[:-1])))
    first, size = doc[begin], np.diff(np.append(begin, len(gram)))
    group = np.flatnonzero(new[begin])
    several = np.minimum.reduceat(first, group) != np.maximum.reduceat(first, group)
    several = np.repeat(np.repeat(several, np.diff(np.append(group, len(begin)))), size)
    covered = doc > np.repeat(first, size)
    known = ~np.isin(gram, cut)
    keep = covered | several | ~known
    return found[keep], np.where(known, covered, UNKNOWN).astype(np.int8)[keep]


def by_name(source: DataFrame, sample: DataFrame, blocks: Blocks, number: int) -> DataFrame:
    """Rows with state: COVERED, OPEN or UNKNOWN (names that the borders of tasks cut); the rest are dropped.

    Rows are sorted over the cluster by name, in ``number`` ranges. sample: a part of the source, for the borders.
    Rows travel in blocks, one for each task that has them.
    """
    at = borders(sample, blocks, number)
    cut = np.unique(at[0][at[1] != -(1 << 63)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in filter(len, blocks(batches)):
            task = task_of(found["gram"], found["doc"], at)
            order = np.argsort(task, kind="stable")
            found, task = found[order], task[order]
            begin = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(task[begin]), pa.array([packed(x) for x in np.split(found, begin[1:])], pa.binary())], names=["task", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.concatenate([np.empty(0, ROW), *(unpacked(x.as_py()) for batch in batches for x in batch.column("block"))])
        if len(found):
            kept, state = judged(found, cut)
            for i in range(0, len(kept), 100_000):
                part = kept[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([*(pa.array(part[c].copy()) for c in ROW.names), pa.array(state[i : i + 100_000])], names=[*ROW.names, "state"])

    schema = ", ".join(f"{n} {KINDS[ROW[n].str]}" for n in ROW.names)
    return with_package(source).mapInArrow(deal, "task int, block binary").repartitionById(number, F.col("task")).mapInArrow(run, f"{schema}, state tinyint")


def settled(found: DataFrame) -> DataFrame:
    """The written rows of ``by_name`` with every state known.

    Names in doubt are those that borders cut, so fewer than tasks. Of each stretch of theirs the first document is
    found by aggregation; stretches that very many rows have are sent to every task (``joined``).
    """
    unknown = found.where(F.col("state") == UNKNOWN)
    firsts = unknown.groupBy("gram", "stretch").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    grams = firsts.groupBy("gram").agg(F.min("first").alias("least"), F.max("first").alias("most"))
    told = joined(unknown, firsts, ["gram", "stretch"], unknown.count()).join(F.broadcast(grams), "gram").where("first < doc or least < most")
    return found.where(F.col("state") != UNKNOWN).union(told.withColumn("state", (F.col("first") < F.col("doc")).cast("tinyint")).select(found.columns))


def with_stretches(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents with the starts, and how many follow each, of their rows."""
    asked = rows.groupBy(F.col("doc").alias("doc_id"), "mark").agg(F.collect_list(F.struct("lo", "more")).alias("at"))
    return docs.join(asked, ["doc_id", "mark"]).select("doc_id", "mark", "text", "at")


def spans(docs: DataFrame, sampled: int = 2000, task_bytes: int = 24_000_000) -> DataFrame:
    """doc, mark, lo, to: stretches of bytes to remove; they may overlap.

    sampled: documents that the ranges' borders are taken from. task_bytes: of rows that a task sorts, about.
    """
    spark = docs.sparkSession
    texts = marked(docs).where("doc_id is not null")
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) * 3 // task_bytes)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(1_000_000)) < min(1_000_000, sampled * 1_000_000 // max(1, n))
    with scratch() as made:
        found = settled(written(by_name(texts, texts.where(part("doc_id")), anchor_rows, number), "anchors"))
        is_open = found.where(F.col("state") == OPEN)
        single = by_name(with_stretches(texts, is_open), with_stretches(texts.where(part("doc_id")), is_open.where(part("doc"))), string_rows, number)
        covered = found.union(settled(written(single, "strings"))).where(F.col("state") == COVERED)
        out = written(covered.select("doc", "mark", "lo", (F.col("lo") + F.col("more") + LENGTH).alias("to")), "spans")
    return discarded(made, out)


def runs(lo: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs that the stretches cover."""
    order = np.argsort(lo, kind="stable")
    lo, to = lo[order], np.maximum.accumulate(to[order])
    new = np.append(True, lo[1:] > to[:-1])
    return lo[new], to[np.append(np.flatnonzero(new)[1:] - 1, len(to) - 1)]


def removed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a further column, and its name: array<struct<lo, to>>, the stretches of bytes to remove."""
    spans_, own, doc, mark = unused(docs.columns, "_spans", "_own", "_doc", "_mark")
    by = spans(docs).groupBy("doc", "mark").agg(F.collect_list(F.struct("lo", "to")).alias(spans_)).withColumnsRenamed({"doc": doc, "mark": mark})
    left = docs.withColumn(own, mark_of("text"))
    return left.join(by, (F.col("doc_id").cast("bigint") == F.col(doc)) & (F.col(own) == F.col(mark)), "left").drop(doc, mark, own), spans_


def _kept(batch: pa.RecordBatch, column: str = "_spans") -> Iterator[tuple[bytes, list[bytes]]]:
    """Each text's bytes, and what is left of them, in pieces."""
    found = batch.column(column)
    lo, to = (found.flatten().field(c).to_numpy() for c in ("lo", "to"))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy())
    for k, text in enumerate(batch.column("text")):
        data, own = (text.as_py() or "").encode(), slice(ends[k - 1] if k else 0, ends[k])
        if own.start == own.stop:
            yield data, [data]
        else:
            begin, end = runs(lo[own], to[own])
            yield data, [data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)])]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes kept, of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            out = []
            for data, pieces in _kept(batch):
                left = b"".join(pieces)
                out.append((len(data), len(data) - len(left), len(pieces) - 1, hashlib.sha256(left).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_package(removed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))[0]).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """The documents with the bytes removed from their texts; characters that a removal cuts go as a whole.

    Null texts stay null; the other columns stay as they are, whatever their names.
    """
    names_, schema = docs.columns, docs.schema
    found, spans_ = removed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            left = [b"".join(pieces).decode("utf-8", "ignore") for _, pieces in _kept(batch, spans_)]
            texts = [x if valid else None for x, valid in zip(left, batch.column("text").is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names_], names=names_)

    return with_package(found).mapInArrow(run, schema)
