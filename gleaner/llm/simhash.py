"""SimHash near-dedup: fingerprints, and an exact tiled comparison of them with numpy.

Nodes are distinct fingerprints (in ``keep_first``, sets). A tile is given by population counts: of a fingerprint's
four quarters, or, with a large radius, of the whole. Fingerprints within the radius differ by no more in the sum of
those counts' differences, so tile pairs beyond the radius are skipped; others are compared bit by bit with
exclusive-or and bit counts. Tiles are cut to a bounded number of fingerprints. A tile pair gives stars, a link from
each node to the least of its component there, which have the same components as all links.

``keep_first`` takes fingerprints of the sets of shingles, without repeats, and also holds texts against each other:
of 128 bits, 32 may differ, which 99.9 % of texts of similarity 0.80 to 0.82 keep to. Texts with equal sets are one,
those with equal fingerprints need not be. The components of these candidates are groups, and all pairs of a group
are compared by their sets of word shingles; only such links count.

Cases: a null text has no words; texts without words have fingerprint zero and are linked like any other; texts of
any length are read whole; rows with a null id have a fingerprint and a component (the least id in it, or null if it
has none); repeated rows and ids stay rows of their own in ``components_of``; an empty table gives an empty result;
further columns are not read (``keep_first`` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from gleaner.llm.common import GROUP, discarded, extended, joined, scratch, text_chunks, with_package, written
from gleaner.llm.components import FEW, components

#: Fingerprints in a tile.
TILE = 4096
#: Fingerprints of one tile that are compared with all of another at once.
STRIP = 256
#: Texts, and bytes of text (one text is never cut), of a group that are held against another chunk at once.
CHUNK, VOLUME = 1024, 4_000_000
#: Shingles of a table of texts by shingles.
WIDTH = 4096


def shingle_hashes(text: bytes, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, repeats included, A-Z lower-cased; of all words if they are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-size] + 1)
    return np.fromiter([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())], np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """Bits that over half of the shingles' hashes have, as signed 64-bit words; from the second on, of the hashes mixed again."""
    out = []
    for _ in range(words):
        total = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65_536):
            part = hashes[at : at + 65_536].astype("<u8")
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0]))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
    return out


def set_node(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set of shingles' hashes."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.astype("<u8").tobytes())).view(np.int64))


def fingerprints(docs: DataFrame, keep: bool = False, size: int = 3, words: int = 1, sets: bool = False) -> DataFrame:
    """doc_id, _fp, the words of the fingerprint, and _node, a long that stands for it; with ``keep``, the other columns too.

    With ``sets``, repeats of a shingle count once, and _node stands for the set of shingles.
    """
    rows = docs if keep else docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = extended((rows if keep else rows.select("doc_id")).schema, "_fp", ArrayType(LongType(), False))
    names = schema.fieldNames()[:-1]
    schema = extended(schema, "_node", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            found, nodes = [], []
            for t in batch.column("text"):
                hashes = shingle_hashes((t.as_py() or "").encode(), size)
                hashes = np.unique(hashes) if sets else hashes
                found.append(fingerprint(hashes, words))
                nodes.append(set_node(hashes) if sets else None)
            fps = pa.array(found, pa.list_(pa.field("element", pa.int64(), False)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), fps, pa.array(nodes, pa.int64())], names=[*names, "_fp", "_node"])

    out = with_package(rows).mapInArrow(run, schema)
    return out if sets else out.withColumn("_node", F.col("_fp")[0] if words == 1 else F.xxhash64("_fp"))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links a - b but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        u, v = root[x], root[y]
        apart = u != v
        if not apart.any():
            break
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root != (up := root[root])).any():
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def near(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) with the components of all pairs at most ``radius`` bits apart, one of each side (nodes, words)."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(left[0]), STRIP):
        apart = np.bitwise_count(left[1][at : at + STRIP, None, 0] ^ right[1][None, :, 0])
        for w in range(1, left[1].shape[1]):
            apart += np.bitwise_count(left[1][at : at + STRIP, None, w] ^ right[1][None, :, w])
        x, y = np.nonzero(apart <= radius)
        a, b = left[0][at + x], right[0][y]
        other = a != b
        out.append(stars(a[other], b[other]))
    return stars(*map(np.concatenate, zip(*out)))


def steps(radius: int, parts: int) -> list[int]:
    """Differences of tile numbers (ten bits for each part's count) within the radius, one of each two that mirror."""
    found = [()]
    for _ in range(parts):
        found = [(*f, d) for f in found for d in range(-radius, radius + 1) if sum(map(abs, f)) + abs(d) <= radius]
    return [sum(d << (10 * i) for i, d in enumerate(reversed(f))) for f in found if f >= (0,) * parts]


def links(distinct: DataFrame, radius: int = 3, words: int = 1, tile: int = TILE) -> DataFrame:
    """Links (a, b) with the components of all pairs of distinct fingerprints (_node, _fp) at most ``radius`` bits apart.

    Tile numbers are paired first: rows are sent to pairs of tiles that both exist.
    """
    if words == 1 and radius <= 4:
        parts = [F.bit_count(F.shiftrightunsigned(F.col("_fp")[0], 16 * i).bitwiseAND(0xFFFF)) for i in range(4)]
    else:
        parts = [sum((F.bit_count(F.col("_fp")[w]) for w in range(1, words)), F.bit_count(F.col("_fp")[0]))]
    number = sum((p.cast("bigint") * (1 << 10 * i) for i, p in enumerate(parts[1:], 1)), parts[0].cast("bigint"))
    placed = distinct.select("_node", "_fp", number.alias("tile"))
    sizes = placed.groupBy("tile").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"))
    cut = placed.join(sizes, "tile").withColumn("cut", F.pmod(F.xxhash64("_node"), F.col("cuts")).cast("int"))
    tiles = written(cut.groupBy("tile", "cut").agg(F.collect_list(F.struct("_node", "_fp")).alias("rows")), "tiles")
    numbers = tiles.select("tile", "cut")
    asked = numbers.withColumn("other", F.explode(F.array(*(F.col("tile") + F.lit(d) for d in steps(radius, len(parts))))))
    met = asked.join(numbers.select(F.col("tile").alias("other"), F.col("cut").alias("other_cut")), "other").where("tile != other or cut <= other_cut")
    right = tiles.select(F.col("tile").alias("other"), F.col("cut").alias("other_cut"), F.col("rows").alias("other_rows"))
    pairs = met.join(tiles, ["tile", "cut"]).join(right, ["other", "other_cut"]).select("rows", "other_rows")

    def side(x: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        return x.field("_node").to_numpy(), x.field("_fp").flatten().to_numpy().view(np.uint64).reshape(-1, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("rows"), batch.column("other_rows")):
                a, b = near(side(x.values), side(y.values), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return with_package(pairs).mapInArrow(run, "a bigint, b bigint")


def alike(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) with the components of all pairs whose sets are at least so similar, one of each side, or both of ``left``.

    A side: nodes, the sizes of their sets, the members of all sets, and the place of the node that each belongs to.
    """
    a, b = left, right or left
    known, times = np.unique(a[2], return_counts=True)
    shared = known[times > 1] if right is None else np.intersect1d(known, b[2])
    common = np.zeros((len(a[0]), len(b[0])), np.float32)

    def placed(side: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, side[2]), max(0, len(shared) - 1))
        held = np.flatnonzero(shared[at] == side[2]) if len(shared) else np.zeros(0, np.int64)
        held = held[np.argsort(at[held], kind="stable")]
        return at[held], side[3][held]

    def part(side: tuple[np.ndarray, np.ndarray], n: int, low: int, high: int) -> np.ndarray:
        x, y = np.searchsorted(side[0], [low, high])
        out = np.zeros((n, high - low), np.float32)
        out[side[1][x:y], side[0][x:y] - low] = 1
        return out

    p = placed(a)
    q = p if right is None else placed(b)
    for low in range(0, len(shared), WIDTH):
        high = min(low + WIDTH, len(shared))
        one = part(p, len(a[0]), low, high)
        common += one @ (one if right is None else part(q, len(b[0]), low, high)).T
    common = common.astype(np.float64)
    held = common >= similarity * np.maximum(1, a[1][:, None] + b[1][None, :] - common)
    x, y = np.nonzero(np.triu(held, 1) if right is None else held)
    return stars(a[0][x], b[0][y])


def verified(members: DataFrame, similarity: float, size: int, chunk: int = CHUNK, volume: int = VOLUME) -> DataFrame:
    """Links (a, b) with the components of all pairs within a group whose sets of word shingles are at least so similar.

    members: root (of the group), node and text. All pairs of a group are held against each other, in chunks of a
    bounded number and volume of texts; each pair of chunks is a task's row.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / chunk, F.sum(F.octet_length("text")) / volume, F.lit(1))).cast("int").alias("cuts"), F.count("*").alias("n"))
    cut = joined(members, sizes, ["root"], members.count()).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    # dealt by chunk, or else Spark would deal chunks as the join did, a whole group to one task
    chunks = written(cut.repartition("root", "cut").groupBy("root", "cuts", "cut").agg(F.collect_list(F.struct("node", "text")).alias("rows")), "chunks", GROUP)
    many, last = chunks.where("cuts > 1"), F.col("cuts") - 1
    low = many.where(F.col("cut") < last).select("root", F.col("cut").alias("low"), F.explode(F.sequence(F.col("cut") + 1, last)).alias("high"), "rows")
    high = many.where("cut > 0").select("root", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("low"), F.col("cut").alias("high"), F.col("rows").alias("other_rows"))
    alone = chunks.select("rows", F.lit(None).cast(chunks.schema["rows"].dataType).alias("other_rows"))
    pairs = alone.union(low.join(high, ["root", "low", "high"]).select("rows", "other_rows"))

    def side(x: pa.StructArray) -> tuple[np.ndarray, ...]:
        sets = [np.unique(shingle_hashes((t.as_py() or "").encode(), size)) for t in x.field("text")]
        many = np.fromiter(map(len, sets), np.int64, len(sets))
        return x.field("node").to_numpy(), many, np.concatenate(sets), np.repeat(np.arange(len(sets)), many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("rows"), batch.column("other_rows")):
                a, b = alike(side(x.values), side(y.values) if y.is_valid else None, similarity)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return with_package(pairs).mapInArrow(run, "a bigint, b bigint")


def with_components(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """_node, component_id, the least doc_id reachable, and n of each distinct fingerprint (_node, least, n)."""
    rooted = written(distinct.join(roots, F.col("_node") == F.col("node"), "left").select("_node", "least", F.col("n").alias("times"), F.coalesce("root", "_node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return joined(rooted, least, ["root"], rooted.count(), FEW).select("_node", "component_id", F.col("times").alias("n"))


def distinct_of(found: DataFrame) -> DataFrame:
    return written(found.groupBy("_node", "_fp").agg(F.min(F.col("doc_id").cast("bigint")).alias("least"), F.count("*").alias("n")), "fingerprints")


def components_of(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of each document."""
    found = written(fingerprints(docs), "documents_fp")
    distinct = distinct_of(found)
    classes = with_components(distinct, components(links(distinct, radius)))
    told = joined(found, written(classes, "classes"), ["_node"], found.count())
    return told.select("doc_id", F.lower(F.lpad(F.hex("_node"), 16, "0")).alias("fingerprint"), "component_id")


def _firsts(rows: DataFrame, size: int, similarity: float, radius: int) -> DataFrame:
    """The rows of each group's least id, written, with _node and _component."""
    found = written(fingerprints(rows, keep=True, size=size, words=2, sets=True).withColumn("_id", F.col("doc_id").cast("bigint")), "documents_fp", GROUP)
    distinct = written(found.groupBy("_node", "_fp").agg(F.min("_id").alias("least"), F.count("*").alias("n")), "fingerprints")
    # the components of candidate links tell groups only: no pair of one group is left out when texts are compared
    groups = components(links(distinct, radius, words=2))
    # one text of each set of shingles stands for it
    asked = distinct.join(groups, F.col("_node") == F.col("node")).select("root", "node", F.col("least").alias("_least"))
    members = found.join(asked, (F.col("_node") == F.col("node")) & F.col("_id").eqNullSafe(F.col("_least"))).groupBy("root", "node").agg(F.min("text").alias("text"))
    classes = with_components(distinct, components(verified(written(members, "members", GROUP), similarity, size)))
    of = classes.select(F.col("_node").alias("_of"), F.col("component_id").alias("_component"))
    return written(found.join(of, (F.col("_node") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_component"))).drop("_fp", "_of"), "firsts", GROUP)


def keep_first(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 32) -> DataFrame:
    """One document of each group of near-duplicates, with its columns: that of the least id; of equal ids one stays.

    Documents with a null id stay only if their group has no other; then one of them does. Texts move once, by id and
    set of shingles, and only those of the least ids; copies do not move. The columns' names may be any.
    """
    names = docs.columns
    back = [f"c{k}" for k in range(len(names))]
    key = next(k for k, n in enumerate(names) if n.lower() == "doc_id")
    text = next(k for k, n in enumerate(names) if n.lower() == "text")
    with scratch() as made:
        first = _firsts(docs.toDF(*back).withColumnsRenamed({back[key]: "doc_id", back[text]: "text"}), size, similarity, radius)
    first = discarded(made, first)
    back[key], back[text] = "doc_id", "text"
    # rows that share the least id, or groups without ids: the least set, then the least text of them stays
    mark = F.struct("_node", F.xxhash64("text"))
    least = first.groupBy("_component").agg(F.min(mark).alias("_mark"), F.count("*").alias("_times"))
    tied = written(least.where("_times > 1").select(F.col("_component").alias("_tied"), "_mark"), "tied")
    if tied.isEmpty():
        return first.select(back).toDF(*names)
    told = first.join(tied, F.col("_component").eqNullSafe(F.col("_tied")), "left")
    alone = told.where("_mark is null")
    one = told.where(F.col("_mark").eqNullSafe(mark)).dropDuplicates(["_component"])
    return alone.select(back).union(one.select(back)).toDF(*names)
