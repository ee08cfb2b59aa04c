"""Vector code compression: product codes with codebooks from rounds of exact integer means.

A vector becomes integers floor(scale * x) and is cut into equal parts; each part is told by the nearest entry of its
position's codebook. Nearest entries are found coarse to fine: with S the sum over a segment of L components and
R = sqrt(L * sum of squares - S²), a squared distance is at least the square of the difference of the S (the means) plus that of
the R (the residual norms), over L. Bounds over the whole part, its halves, and so on drop the entries that cannot be nearest;
those left get exact integer distances. Bounds are lessened by more than rounding can add to them.

Cases: vectors that are null or hold a null or a non-finite component are dropped; a null id is kept, and comes last in
the order of ids; repeated ids are rows of their own, in the order of their vectors; fewer vectors than entries give a
smaller codebook; vectors of unequal length, or of one that the parts do not divide, are filled up with zeros
to the longest that occurs, rounded up; components of any finite size are exact whole numbers, and an error beyond a
long counts as the greatest long; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import joined, with_package, written

#: Rows of a task that are compared with a codebook at once.
ROWS = 2048
LONGEST = (1 << 63) - 1
#: Entries of the least bounds at the finest level that are measured before the others are held against them.
TRIED = 8
#: What bounds are lessened by, of the squared lengths: far more than rounding errors of doubles.
SLACK = 1e-9
#: Sums are carried in signed digits of this many bits, so that sums of sums stay far within a long.
DIGIT = 30


def whole(values: np.ndarray) -> np.ndarray:
    """Integers as int64 where every product of the bounds and distances fits, else of any size."""
    most = float(np.abs(values).max()) if values.size else 0.0
    if most * values.shape[1] < 2**22:
        return values.astype(np.int64)
    return np.array([[int(v) for v in row] for row in values.tolist()], object).reshape(values.shape)


def segments(width: int) -> list[list[tuple[int, int]]]:
    """Levels of segments of one part, coarse to fine: the whole part, its halves, and so on down to two components."""
    levels, n = [], 1
    while n == 1 or 2 * n <= width:
        levels.append([(width * k // n, width * (k + 1) // n) for k in range(n)])
        n *= 2
    return levels


class Side:
    """Rows of one part with the means and residual norms of their segments at each level.

    A level is a table of points, S / sqrt(L) and R / sqrt(L) of each segment, over ``unit``, with their squared lengths;
    the squared distance of two points is at most that of their rows.
    """

    def __init__(self, rows: np.ndarray, unit: float = 1.0):
        self.rows, self.unit, self.levels = rows, unit, []
        for level in segments(rows.shape[1]):
            columns = []
            for begin, end in level:
                x, length = rows[:, begin:end], end - begin
                total = x.sum(axis=1)
                rest = length * (x * x).sum(axis=1) - total * total
                norm = np.array([isqrt(int(v)) / unit for v in rest]) if rows.dtype == object else np.sqrt(rest.astype(np.float64)) / unit
                mean = np.array([v / int(unit) for v in total.tolist()]) if rows.dtype == object else total / unit
                columns += [mean / length**0.5, norm / length**0.5]
            points = np.stack(columns, axis=1).astype(np.float64)
            self.levels.append((points, (points * points).sum(axis=1)))


def bound(a: Side, b: Side, level: int) -> np.ndarray:
    """Less than the squared distances of all pairs by what rounding can make of them, over the square of the unit."""
    (x, xx), (y, yy) = a.levels[level], b.levels[level]
    both = xx[:, None] + yy[None, :]
    out = x @ y.T
    out *= -2
    out += both
    both *= SLACK
    out -= both
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def nearest(rows: Side, book: Side) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each row's nearest entry (ties to the lower one), and how many distances it took.

    At each level the entry of the least bound is measured (at the finest, some of the least), which may lower what is to
    beat, and entries whose bound is above that are out; all that are left in the end are measured.
    """
    n, width = rows.rows.shape
    if not width or not len(book.rows):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    beat, out, took, last = np.full(n, np.inf), None, 0, len(rows.levels) - 1
    for level in range(last + 1):
        low = bound(rows, book, level)
        if out is not None:
            low[out] = np.inf
        tried = min(TRIED, len(book.rows)) if level == last else 1
        first = np.argpartition(low, tried - 1, axis=1)[:, :tried] if tried > 1 else low.argmin(axis=1)[:, None]
        far = distances(rows.rows[:, None, :], book.rows[first])
        took += far.size
        far = far.min(axis=1)
        far = np.array([v / int(rows.unit) ** 2 for v in far.tolist()]) if far.dtype == object else far.astype(np.float64)
        beat = np.minimum(beat, far * (1 + SLACK))
        out = low > beat[:, None]
    row, entry = np.nonzero(~out)
    exact = distances(rows.rows[row], book.rows[entry])
    order = np.lexsort((entry, exact, row)) if exact.dtype != object else np.array(sorted(range(len(exact)), key=lambda i: (row[i], exact[i], entry[i])), np.int64)
    order = order[np.searchsorted(row[order], np.arange(n))]  # the first of each row: the measured entries that were least are among those left
    return entry[order], exact[order], took + len(exact)


@dataclass(frozen=True)
class Codebooks:
    """For each part, its entries; all of one width."""

    parts: tuple[np.ndarray, ...]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for book in self.parts for entry in book for v in entry).encode()).hexdigest()


def quantised(vectors: DataFrame, key: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """id, label and v: scale * x of each component, still to be floored, of the vectors that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double") * scale)
    fine = F.col(vector).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return vectors.where(fine).select(F.col(key).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), x.alias("v"))


def unit_of(*tables: np.ndarray) -> float:
    """A power of two so great that the squares of all numbers over it are small floats; 1 for tables of int64."""
    if all(t.dtype != object for t in tables):
        return 1.0
    most = max((max(abs(int(v)) for v in t.ravel()) for t in tables if t.size), default=0)
    return float(2 ** max(0, most.bit_length() - 20))


def tables(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """Place and integers of runs of the batch's rows, filled up to ``dims`` components."""
    column = batch.column("v")
    for at in range(0, batch.num_rows, ROWS):
        part = column.slice(at, ROWS)
        flat, sizes = np.floor(part.flatten().to_numpy(zero_copy_only=False)), part.value_lengths().to_numpy()
        out = np.zeros((len(part), dims))
        out[np.arange(dims)[None, :] < sizes[:, None]] = flat
        yield at, whole(out)


def cut(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    width = rows.shape[1] // parts
    return [rows[:, p * width : (p + 1) * width] for p in range(parts)]


class Sides:
    """The codebooks' sides, made once for all rows of whole numbers that fit int64."""

    def __init__(self, books: Codebooks):
        self.books, self.made = books.parts, [None if book.dtype == object else Side(book) for book in books.parts]

    def nearest(self, part: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        unit = unit_of(rows, self.books[part])
        made = self.made[part]
        return nearest(Side(rows, unit), made if made and unit == 1.0 else Side(self.books[part], unit))


def digits(value: int) -> list[int]:
    """The number as digits of DIGIT bits, the least first, all of its sign."""
    sign, value, out = (-1, -value, []) if value < 0 else (1, value, [])
    while value or not out:
        out.append(sign * (value & ((1 << DIGIT) - 1)))
        value >>= DIGIT
    return out


def improved(rows: DataFrame, books: Codebooks, dims: int) -> Codebooks:
    """Each entry replaced by the floor of the mean of the parts that it is nearest to; entries without any stay.

    A task adds up its own parts for each entry, so that what is shuffled and collected hangs on the codebooks, not the rows.
    """
    sent, parts = rows.sparkSession.sparkContext.broadcast(books), len(books.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(sent.value)
        sums = [np.zeros(book.shape, object) for book in sent.value.parts]
        count = [np.zeros(len(book), np.int64) for book in sent.value.parts]
        for batch in batches:
            for _, table in tables(batch, dims):
                for p, own in enumerate(cut(table, parts)):
                    found = sides.nearest(p, own)[0]
                    count[p] += np.bincount(found, minlength=len(count[p]))
                    order = np.argsort(found, kind="stable")
                    used, starts = np.unique(found[order], return_index=True)
                    sums[p][used] += np.add.reduceat(own[order], starts, axis=0).astype(object)
        out = []
        for p in range(parts):
            for e in np.flatnonzero(count[p]):
                each = [digits(int(v)) for v in sums[p][e]]
                for place in range(max(map(len, each), default=1)):
                    out.append((p, int(e), place, int(count[p][e]) if place == 0 else 0, [d[place] if place < len(d) else 0 for d in each]))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "entry", "place", "n", "sums"])

    width = dims // parts
    told = with_package(rows.select("v")).mapInArrow(run, "part int, entry int, place int, n bigint, sums array<bigint>")
    found = told.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).cast("array<bigint>").alias("sums")).collect()
    made = [book.astype(object) for book in books.parts]
    totals: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in found:
        n, so_far = totals.get((r["part"], r["entry"]), (0, [0] * width))
        totals[r["part"], r["entry"]] = (n + r["n"], [a + (b << DIGIT * r["place"]) for a, b in zip(so_far, r["sums"])])
    for (p, e), (n, total) in totals.items():
        made[p][e] = [v // n for v in total]
    return Codebooks(tuple(whole(book) for book in made))


def assigned(rows: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    """id, label, code (two hex digits for each part) and error of each row."""
    sent, parts = rows.sparkSession.sparkContext.broadcast(books), len(books.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(sent.value)
        for batch in batches:
            codes, errors = [], []
            for _, table in tables(batch, dims):
                numbers, error = [], 0
                for p, own in enumerate(cut(table, parts)):
                    found, far, _ = sides.nearest(p, own)
                    numbers.append(found)
                    error = error + far.astype(object)
                codes += [bytes(row).hex() for row in np.stack(numbers, axis=1).astype(np.uint8)]
                errors += [min(int(e), LONGEST) for e in error]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return with_package(rows).mapInArrow(run, f"id {kind['id']}, label {kind['label']}, code string, error bigint")


def train(rows: DataFrame, dims: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks that begin as the parts of the rows of the smallest ids, after ``rounds`` rounds."""
    got = rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).toArrow()  # a bounded number of rows
    first = np.concatenate([table.astype(object) for batch in got.to_batches() for _, table in tables(batch, dims)] or [np.zeros((0, dims), object)])
    books = Codebooks(tuple(whole(np.array(part)) for part in cut(first, parts)))
    for _ in range(rounds):
        books = improved(rows, books, dims)
    return books


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """key, code, error, label_error (summed over equal labels, nulls together) and codebooks_sha256 of each vector that takes part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 256 entries at most")
    rows = written(quantised(vectors, key, vector, label, scale), "vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    dims = -(-longest // parts) * parts
    books = train(rows, dims, parts, entries, rounds)
    named = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    found = written(assigned(rows, books, dims).withColumn("_named", named), "codes")
    most = F.lit(LONGEST).cast("decimal(38,0)")
    sums = found.groupBy("_named").agg(F.count("*").alias("n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("bigint").alias("label_error"))
    out = joined(found, sums, ["_named"], found.count())
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
