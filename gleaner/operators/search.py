"""Retrieval: sparse, dense, late-interaction and quantised search, rank fusion.

Queries are a stated set, asked of all rows. A set of at most GROUP queries goes to the rows where they lie; a larger one
is cut into groups, and rows are dealt to each group. Either way a task multiplies a batch of rows with one group and
keeps each query's best, so no pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gleaner.functions import text as T
from gleaner.operators.joins import KEYS
from gleaner.staging import written
from gleaner.workers import pieces, with_package

#: Queries that a task holds; rows and queries that it multiplies at once; terms of texts that it weighs at once.
GROUP, ROWS, AT_ONCE, TERMS = 4096, 4096, 256, 4096
#: Rows of a group's part when rows are dealt.
PART = 262_144


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_weights(texts: DataFrame, key: str, text: str, k1: float, b: float, average: Column | None = None) -> DataFrame:
    """key, term and the saturated weight of the term in the text: a sparse vector in rows."""
    found = texts.select(key, T.tokens(F.col(text)).alias("_t")).withColumn("_len", F.size("_t"))
    terms = found.select(key, "_len", F.explode("_t").alias("term")).groupBy(key, "_len", "term").agg(F.count("*").alias("_tf"))
    if average is None:
        mean = found.agg(F.avg("_len").alias("_mean"))  # one row
        terms, average = terms.crossJoin(F.broadcast(mean)), F.col("_mean")
    weight = F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / average))
    return terms.select(key, "term", weight.alias("w"))


def lists_of(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def _told(texts: DataFrame, key: str, terms: pa.Array) -> DataFrame:
    """key, n (tokens), ids (of the terms that the text has, each once) and tf of each text."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_t"):
            tokens = batch.column("_t")
            n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
            place = pc.fill_null(pc.index_in(tokens.flatten(), value_set=sent.value), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            pairs, tf = np.unique(row[place >= 0] * (len(sent.value) + 1) + place[place >= 0], return_counts=True)
            each = np.bincount(pairs // (len(sent.value) + 1), minlength=len(n))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n), lists_of(pairs % (len(sent.value) + 1), each), lists_of(tf, each)], names=[key, "n", "ids", "tf"])

    kind = texts.schema[key].dataType.simpleString()
    return with_package(texts.select(key, T.tokens(F.col("text")).alias("_t"))).mapInArrow(run, f"`{key}` {kind}, n bigint, ids array<bigint>, tf array<bigint>")


def bm25(docs: DataFrame, queries: DataFrame, key: str, query: str, k: int = 5, k1: float = 1.2, b: float = 0.75, most: int = 500_000) -> DataFrame:
    """query, key, score and rank. Queries are weighted as documents are, and terms by their inverse document frequency.

    Texts are read into tokens once. Of each, only the terms that some query holds are kept; a task multiplies them with
    the queries' weights. Queries of over ``most`` terms together are joined with postings on terms instead.
    """
    spark = docs.sparkSession
    asked = term_weights(queries, query, "text", k1, b, F.lit(256.0)).withColumnRenamed("w", "q")
    got = asked.orderBy(query, "term").limit(most + 1).toArrow()
    if len(got) > most:
        return _bm25_joined(docs, asked, key, query, k, k1, b)
    terms = pc.unique(got["term"].combine_chunks())
    ids = pc.unique(got[query].combine_chunks())
    told = written(_told(docs, key, terms), "postings")
    total, mean = told.agg(F.count("*"), F.avg("n")).first()
    df = np.zeros(len(terms))
    for r in told.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # of the queries' terms only
        df[r["id"]] = r["count"]
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    column, row, weight = (x.to_numpy() for x in (pc.index_in(got[query].combine_chunks(), value_set=ids), pc.index_in(got["term"].combine_chunks(), value_set=terms), got["q"].combine_chunks()))
    blocks = []
    for at in range(0, len(ids), 256):  # terms of some queries at a time: a dense matrix of their own
        own = (column >= at) & (column < at + 256)
        used, where = np.unique(row[own], return_inverse=True)
        matrix = np.zeros((len(used) + 1, min(256, len(ids) - at)))
        matrix[where, column[own] - at] = weight[own] * idf[row[own]]
        place = np.full(len(terms) + 1, len(used))
        place[used] = np.arange(len(used))
        blocks.append((at, matrix, place))
    sent = spark.sparkContext.broadcast(blocks)
    scalar = (mean or 1.0, k1, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, k1, b = scalar
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                each = pc.list_value_length(batch.column("ids")).to_numpy().astype(np.int64)
                found, tf = batch.column("ids").flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
                length = np.repeat(batch.column("n").to_numpy(), each)
                w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
                full = np.flatnonzero(each)
                if not len(full):
                    continue
                doc = np.repeat(np.arange(len(full)), each[full])
                for at, matrix, place in sent.value:
                    spot = place[found]
                    score = np.zeros((len(full), matrix.shape[1]))
                    for part in range(0, len(found), TERMS):  # so that the rows at hand stay small, however long a text
                        rows = slice(part, part + TERMS)
                        own, first = np.unique(doc[rows], return_index=True)
                        score[own] += np.add.reduceat(matrix[spot[rows]] * w[rows, None], first, axis=0)
                    score = np.round(score, 6)
                    q, d = best_of(score.T, k, score.T > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(q + at), batch.column(key).take(pa.array(full[d])), pa.array(score[d, q])], names=["q", key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    hits = with_package(told).mapInArrow(run, f"q bigint, `{key}` {kind}, score double")
    names = spark.createDataFrame(list(enumerate(ids.to_pylist())), f"q bigint, `{query}` {queries.schema[query].dataType.simpleString()}")
    return ranked(hits, ["q"], [F.desc("score"), F.col(key)], k).join(F.broadcast(names), "q").select(query, key, "score", "rank")


def _bm25_joined(docs: DataFrame, asked: DataFrame, key: str, query: str, k: int, k1: float, b: float) -> DataFrame:
    """The same through joins on terms, for any number of queries."""
    postings = written(term_weights(docs, key, "text", k1, b).join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    total = docs.agg(F.count("*").alias("_n"))
    idf = postings.groupBy("term").agg(F.count("*").alias("_df")).crossJoin(F.broadcast(total)).select("term", F.ln(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)).alias("idf"))
    hits = postings.join(asked.join(idf, "term"), "term").groupBy(query, key).agg(F.round(F.sum(F.col("q") * F.col("w") * F.col("idf")), 6).alias("score"))
    return ranked(hits, [query], [F.desc("score"), F.col(key)], k)


def best_of(score: np.ndarray, k: int, fits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k greatest scores and those equal to the last of them, where ``fits``."""
    if fits is not None:
        score = np.where(fits, score, -np.inf)
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        held = score >= least[:, None]
    else:
        held = np.ones(score.shape, bool)
    return np.nonzero(held & (score > -np.inf))


Scorer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def products(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all pairs, to rank by and to tell."""
    score = np.round(queries @ rows.T, 6)
    return score, score


def eighths(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of vectors cut to 8 bits, to rank by, and those in full."""
    small = lambda x: np.trunc(x * 127 + np.copysign(0.5, x))  # noqa: E731  half away from zero
    return small(queries) @ small(rows).T, np.round(queries @ rows.T, 6)


def scored(vectors: DataFrame, queries: DataFrame, k: int, scorer: Scorer = products, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, first (what the scorer ranks by) and score of pairs, among them each query's k greatest by first."""
    whole = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows, asked = whole(vectors), whole(queries)
    schema = "query_id bigint, vec_id bigint, first double, score double"

    def table(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, v = batch["id"], batch["v"]
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        return ids.to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def pairs(ids: np.ndarray, v: np.ndarray, asked: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), ROWS):
            for q in range(0, len(asked[0]), AT_ONCE):
                first, score = scorer(v[at : at + ROWS], asked[1][q : q + AT_ONCE])
                a, b = best_of(first, k)
                yield pa.RecordBatch.from_arrays([pa.array(asked[0][q : q + AT_ONCE][a]), pa.array(ids[at : at + ROWS][b]), pa.array(first[a, b].astype(float)), pa.array(score[a, b])], names=["query_id", "vec_id", "first", "score"])

    few = asked.limit(GROUP + 1).toArrow()
    if len(few) <= GROUP:
        sent = vectors.sparkSession.sparkContext.broadcast(table(few) if len(few) else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and sent.value:
                    yield from pairs(*table(batch), sent.value)

        return with_package(rows).mapInArrow(run, schema)
    groups, parts = -(-asked.count() // GROUP), -(-rows.count() // PART)
    side = lambda df, n, part, of, other: df.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias(part), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(of - 1).cast("bigint"))).alias(other), "id", "v")
    left = side(rows, parts, "part", groups, "group").select("part", "group", "id", "v", F.lit(0).alias("side"))
    right = side(asked, groups, "group", parts, "part").select("part", "group", "id", "v", F.lit(1).alias("side"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        own, asked = t.filter(pc.equal(t["side"], 0)), t.filter(pc.equal(t["side"], 1))
        if len(own) and len(asked):
            yield from pairs(*table(own), table(asked))

    return with_package(left.union(right)).groupBy("part", "group").applyInArrow(meet, schema)


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score and rank of each query's k nearest rows, exact; ties go to the smaller id."""
    hits = scored(vectors, queries, k)
    return ranked(hits, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "vec_id", "score", "rank")


def quantised(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """A cheap first pass over 8-bit components for twice as many rows, scored again in full."""
    first = ranked(scored(vectors, queries, 2 * k, eighths), ["query_id"], [F.desc("first"), F.col("vec_id")], 2 * k).drop("rank")
    return ranked(first, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "vec_id", "score", "rank")


class Kept:
    """Each question's k best scores so far, of which only what reaches them is told on."""

    def __init__(self, questions: int, k: int):
        self.best = np.full((k, questions), -np.inf)

    @property
    def least(self) -> np.ndarray:
        return self.best[0]

    def reached(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row (document) and column (question) of the scores that are among the k best so far, or equal to the last."""
        k = len(self.best)
        both = np.concatenate([self.best, score])
        self.best = np.sort(np.partition(both, len(both) - k, axis=0)[len(both) - k :], axis=0)
        return np.nonzero(score >= self.least)


class Tokens:
    """The tokens of questions as columns of one matrix, those of a question side by side."""

    def __init__(self, questions: list, vectors: np.ndarray):
        order = np.argsort(questions, kind="stable")
        self.names, self.starts = np.unique(np.array(questions)[order], return_index=True)
        self.matrix = np.ascontiguousarray(vectors[order].T)
        self.lengths = np.sqrt((self.matrix**2).sum(axis=0))

    def maxima(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The best product of each token with the rows of each document, which begin at ``starts``."""
        return np.maximum.reduceat(rows @ self.matrix, starts, axis=0)

    def sums(self, maxima: np.ndarray) -> np.ndarray:
        return np.round(np.add.reduceat(maxima, self.starts, axis=1), 6)

    def bounds(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What no document's scores exceed, from the mean of its rows and their greatest distance from it."""
        n = np.diff(np.append(starts, len(rows)))
        mean = np.add.reduceat(rows, starts, axis=0) / n[:, None]
        far = np.sqrt(np.maximum.reduceat(((rows - np.repeat(mean, n, axis=0)) ** 2).sum(axis=1), starts))
        return np.add.reduceat(mean @ self.matrix + far[:, None] * self.lengths, self.starts, axis=1) + 1e-5


def documents_scored(batches: Iterator[pa.RecordBatch], tokens: Tokens, k: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Documents, numbers of questions and scores worth keeping; rows come document after document, ``first`` marks where each begins."""
    kept, open_doc, open_max = Kept(len(tokens.names), k), None, None

    def told(docs: pa.Array, maxima: np.ndarray):
        score = tokens.sums(maxima)
        d, q = kept.reached(score)
        return docs.take(pa.array(d)), q, score[d, q]

    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            first, docs = batch.column("first").to_numpy(zero_copy_only=False), batch.column("doc")
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if first[0] and open_doc is not None:
                yield told(open_doc, open_max)
                open_doc = None
            starts = np.flatnonzero(first)
            if not first[0]:
                starts = np.append(0, starts)
            alive = np.ones(len(starts), bool)
            if len(v) >= 4 * len(starts) > 8 and np.isfinite(kept.least).all():
                alive = (tokens.bounds(v, starts) >= kept.least).any(axis=1)
                alive[0] = alive[-1] = True  # the rest of these may be in other batches
            if not alive.all():
                sizes = np.diff(np.append(starts, len(v)))
                v, starts, sizes = v[np.repeat(alive, sizes)], starts[alive], sizes[alive]
                docs = docs.take(pa.array(starts))
                maxima = tokens.maxima(v, np.cumsum(sizes) - sizes)
            else:
                docs = docs.take(pa.array(starts))
                maxima = tokens.maxima(v, starts)
            if not first[0]:
                maxima[0] = np.maximum(maxima[0], open_max[0])
                docs = pa.concat_arrays([open_doc, docs.slice(1)])
            if len(docs) > 1:
                yield told(docs.slice(0, len(docs) - 1), maxima[:-1])
            open_doc, open_max = docs.slice(len(docs) - 1), maxima[-1:]
    if open_doc is not None:
        yield told(open_doc, open_max)


def max_sim(vectors: DataFrame, queries: DataFrame, doc: str, k: int, group: str | None = None) -> DataFrame:
    """Late interaction: of each document, the sum over query tokens of the best of its vectors; the k best documents.

    With ``group``, the best of each question by that column. Vectors are brought together by document, once; a task multiplies
    a document's vectors with all tokens, skips documents that cannot reach a question's k best, and tells on
    only what can. Documents of very many vectors are at most KEYS: each task tells the greatest products of its part.
    Tokens are a stated set, sent to every task, GROUP at a time (those of one question stay together).

    Cases: null vectors, and documents without another, take no part; a null document is one of its own; repeated rows change
    nothing; ties go to the smaller document; an empty table, of either kind, gives an empty result.
    """
    spark, kind = vectors.sparkSession, vectors.schema[doc].dataType
    asked = queries.where(F.col("embedding").isNotNull()).select(F.col("embedding").cast("array<double>").alias("v"), *([F.col(group).alias("q")] if group else []))
    got = asked.toArrow()
    q_kind = queries.schema[group].dataType.simpleString() if group else "int"
    names = pc.unique(got["q"].combine_chunks()) if group else pa.array([0])
    number = pc.index_in(got["q"].combine_chunks(), value_set=names).to_numpy() if group else np.zeros(len(got), np.int64)
    whole = got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1) if len(got) else np.zeros((0, 0))
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col(doc).alias("doc"), F.col("embedding").cast("array<double>").alias("v"))
    sizes = written(rows.groupBy("doc").agg(F.count("*").alias("n")), "document_sizes")
    limit = max(KEYS, (sizes.agg(F.sum("n")).first()[0] or 0) // KEYS)
    hot = sizes.where(F.col("n") > limit).select(F.col("doc").alias("hot_doc"), (F.row_number().over(Window.orderBy("doc")) - 1).alias("id"))  # at most KEYS rows
    names_hot = hot.orderBy("id").toArrow()["hot_doc"].combine_chunks()
    told = rows.join(F.broadcast(hot), F.col("doc").eqNullSafe(F.col("hot_doc")), "left").drop("hot_doc") if len(names_hot) else rows.withColumn("id", F.lit(None).cast("int"))
    first = (F.row_number().over(Window.partitionBy("doc").orderBy(F.lit(0))) == 1).alias("first")
    cold = told.where("id is null").select("doc", "v", first)
    few, many = told.where("id is not null").select("id", "v"), None

    # whole questions, until GROUP tokens are together
    counts = np.bincount(number, minlength=len(names)) if len(number) else np.zeros(len(names), np.int64)
    bundle = (np.cumsum(counts) - counts) // GROUP
    for b in np.unique(bundle):
        own = bundle[number] == b
        if not own.any():
            continue
        sent = spark.sparkContext.broadcast(Tokens(number[own].tolist(), whole[own]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for docs, q, score in documents_scored(batches, sent.value, k):
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.names[q].astype(np.int32)), docs, pa.array(score)], names=["q", "doc", "score"])

        def greatest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, np.ndarray] = {}
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    ids = batch.column("id").to_numpy()
                    order = np.argsort(ids, kind="stable")
                    found, starts = np.unique(ids[order], return_index=True)
                    for i, m in zip(found.tolist(), sent.value.maxima(v[order], starts)):
                        best[i] = np.maximum(best[i], m) if i in best else m
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.list_(pa.float64()))], names=["id", "m"])

        found = with_package(cold).mapInArrow(run, StructType([StructField("q", IntegerType()), StructField("doc", kind), StructField("score", DoubleType())]))
        if len(names_hot):
            of = Tokens(number[own].tolist(), whole[own])
            place = spark.createDataFrame(list(enumerate(np.repeat(of.names, np.diff(np.append(of.starts, own.sum()))).tolist())), "at int, q int")
            parts = with_package(few).mapInArrow(greatest, "id int, m array<double>").select("id", F.posexplode("m").alias("at", "m")).groupBy("id", "at").agg(F.max("m").alias("m"))
            sums = parts.join(F.broadcast(place), "at").groupBy("id", "q").agg(F.round(F.sum("m"), 6).alias("score"))
            found = found.unionByName(sums.join(F.broadcast(hot), "id").select("q", F.col("hot_doc").alias("doc"), "score"))
        many = found if many is None else many.unionByName(found)
    if many is None:
        many = cold.where("false").select(F.lit(0).alias("q"), "doc", F.lit(0.0).alias("score"))
    best = ranked(many, ["q"], [F.desc("score"), F.col("doc")], k)
    if not group:
        return best.select(F.col("doc").alias(doc), "score")
    asked_names = spark.createDataFrame(list(enumerate(names.to_pylist())), f"q int, `_name` {q_kind}")
    return best.join(F.broadcast(asked_names), "q").select(F.col("doc").alias(doc), F.col("_name").alias(group), "score", "rank")


def fuse(lists: DataFrame, k: int | Column, base: int, constant: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal-rank fusion of hits (list, rank, path, chunk_index, summary) keyed by path and chunk, null chunks alike.

    A rank r counts 1 / (constant + r - 1 + base). The summary list's last duplicate names the row's text, else
    the fast list's first. Ties keep the order of insertion: the summary list first. With ``by``, each question's
    lists are fused apart, and ``k`` may be a column of the hits that is the same for all of a question.
    """
    summary = F.col("list") == "summary"
    order = F.struct(F.when(summary, 1).otherwise(0).alias("first"), F.when(summary, F.col("rank")).otherwise(-F.col("rank")).alias("then"))
    place = F.struct(F.when(F.col("list") == "summary", 0).otherwise(1).alias("l"), F.col("rank").alias("r"))
    limit = [F.max(k).alias("_k")] if isinstance(k, Column) else []
    found = lists.groupBy(*by, "path", "chunk_index").agg(
        F.round(F.sum(1.0 / (F.col("rank") + (constant - 1 + base))), 9).alias("score"),
        F.when(F.count_distinct("list") > 1, "both").otherwise(F.max("list")).alias("tier"),
        F.max_by("summary", order).alias("summary"), F.min(place).alias("_at"), *limit,
    )
    if not by:
        return found.orderBy(F.desc("score"), "_at", "path").limit(k).drop("_at")
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "_at", "path")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (F.col("_k") if limit else k)).drop("_at", "_k")
