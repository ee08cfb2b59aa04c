"""Exact top-k inner products with Fagin's threshold algorithm.

Candidates are cut into blocks of bounded size. Each block holds, for each dimension, its rows in the order of
that component. A batch of queries reads the lists in step from both ends, twice as deep each time; rows met for
the first time are scored exactly, by one matrix product for the batch. A query stops when the sum of its
components times the list values at the present depth, which no unmet row can exceed, falls below its kth best
score so far, or when the lists have shown every row. Queries meet every block (a stated query set against all
rows, in blocks), and the best k of all blocks are the result.

Vectors are quantised to floor(scale * x). Ties go to the smaller id. Sums are exact: in single or double precision
or in 64-bit integers where these hold every possible sum, else in whole numbers of any size.

Cases: null vectors, those that hold a null or a non-finite component, and those whose component times the scale is
not finite take no part, nor do rows with a null id; vectors of unequal length have no inner product, so that a query
meets the candidates of its own length; fewer than k candidates give all of them; repeated ids stay separate rows, and
a query does not meet rows of its own id; an empty table gives an empty result; further columns are not read; a score
beyond a long counts as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import with_package, written

#: Candidates in a block, and queries that a task holds at once: candidates are sent once to each group of queries.
BLOCK = 16_384
QUERIES = 32_768
#: Queries that read a block's lists together.
BATCH = 128
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id and v: scale * x of each component, still to be floored, of the vectors that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double") * scale)
    fine = F.col(vector).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.col(key).isNotNull()
    return vectors.where(fine).select(F.col(key).cast("bigint").alias("id"), x.alias("v"))


def exact(*tables: np.ndarray) -> list[np.ndarray]:
    """The floored rows of both tables in the fastest type in which each of their inner products is exact."""
    tables = tuple(map(np.floor, tables))
    most = [float(np.abs(t).max()) if t.size else 0.0 for t in tables]
    bound = most[0] * most[1] * tables[0].shape[1]
    kind = np.float32 if max(bound, *most) < 2**24 else np.float64 if max(bound, *most) < 2**53 else np.int64 if max(bound, *most) < 2**62 else object
    if kind is object:
        return [np.array([[int(x) for x in row] for row in t.tolist()], object).reshape(t.shape) for t in tables]
    return [t.astype(kind) for t in tables]


class Block:
    """Candidates with, for each dimension, their places in the order of that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that places order as ids do
        self.ids, self.rows = ids[order], rows[order]
        columns = np.ascontiguousarray(self.rows.T)
        self.lists = np.argsort(columns, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(columns, self.lists, axis=1)

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Places and scores of each query's best k rows but its own, and how deep its lists were read."""
        n, dims = self.rows.shape
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        out = [(np.zeros(0, np.int64), np.zeros(0, self.rows.dtype), 0)] * len(queries)
        unmet, todo, before, depth = np.ones(n, bool), np.arange(len(queries)), 0, min(n, max(k + 1, n // (16 * max(1, dims))))
        while len(todo):
            shown = np.zeros(n, bool)
            shown[self.lists[:, before:depth]] = True
            shown[self.lists[:, n - depth : n - before]] = True
            if not dims:  # no lists: every row is met
                shown[:] = True
            new = np.flatnonzero(shown & unmet)
            unmet[new] = False
            score = queries[todo] @ self.rows[new].T
            for s, q in zip(score, todo):
                out[q] = (*self.first(s, new, own[q], out[q], k), depth)
            if not unmet.any():
                break
            # no row beyond the depth has more in a dimension than the list there, from the end of the component's sign
            most = up[todo] @ self.values[:, n - depth - 1] + down[todo] @ self.values[:, depth]
            todo = np.array([q for q, bound in zip(todo, most) if len(out[q][0]) < k or bound >= out[q][1][-1]], np.int64)
            before, depth = depth, min(2 * depth, n - 1)
        return out

    def first(self, score: np.ndarray, new: np.ndarray, own: int, so_far: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best of the rows met before and the new ones, in order."""
        if score.dtype == object:
            score = np.array([min(max(x, LONG[0]), LONG[1]) for x in score], object)
        same = slice(*np.searchsorted(self.ids[new], (own, own + 1)))
        at = np.arange(len(score))
        if same.start < same.stop:
            at = np.delete(at, same)
            score = score[at]
        if len(so_far[0]) == k:
            near = np.flatnonzero(score >= so_far[1][-1])
            at, score = at[near], score[near]
        if len(score) > 64 * (k + 1) and score.dtype != object:
            # k runs of rows have a row at least this good each
            whole = len(score) // 64 * 64
            tops = score[:whole].reshape(-1, 64).max(axis=1)
            near = np.flatnonzero(score >= np.partition(tops, len(tops) - k)[len(tops) - k])
            at, score = at[near], score[near]
        place, score = np.concatenate([so_far[0], new[at]]), np.concatenate([so_far[1], score])
        order = sorted(range(len(score)), key=lambda i: (-score[i], place[i]))[:k] if score.dtype == object else np.lexsort((place, -score))[:k]
        return place[order], score[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows, its own left out; depth: how deep the query read the
    lists of the row's block.

    Blocks and groups of queries are rows of two small tables whose pairs are dealt over the cluster; a task
    holds one block and one group at a time.
    """
    rows = written(quantised(vectors, key, vector, scale), "vectors")
    asked = written(quantised(queries, key, vector, scale), "queries")
    blocks, groups = (max(1, -(-t.count() // size)) for t, size in ((rows, BLOCK), (asked, QUERIES)))
    part = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # each side is sent to the pairs that it is part of, by the number of the other side's parts
    left = rows.select(part(blocks).alias("block"), each(groups).alias("group"), "id", "v", F.lit(0).alias("side"))
    right = asked.select(each(blocks).alias("block"), part(groups).alias("group"), "id", "v", F.lit(1).alias("side"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(tables)
        side, ids = t["side"].to_numpy(), t["id"].to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if len(ids) and t["dims"][0].as_py() else np.zeros((len(ids), 0))
        candidates, asked = exact(v[side == 0], v[side == 1])
        out: list[tuple[int, int, int, int]] = []
        if len(candidates):
            block, own = Block(ids[side == 0], candidates), ids[side == 1]
            for at in range(0, len(own), BATCH):
                for q, (found, score, depth) in zip(own[at : at + BATCH], block.best(asked[at : at + BATCH], own[at : at + BATCH], k)):
                    out += [(int(q), int(a), int(s), depth) for a, s in zip(block.ids[found], score)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [], []))], names=["query_id", "vec_id", "score", "depth"])

    dealt = left.union(right).withColumn("dims", F.size("v"))
    pairs = with_package(dealt).groupBy("dims", "block", "group").applyInArrow(run, "query_id bigint, vec_id bigint, score bigint, depth bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")
