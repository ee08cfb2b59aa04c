"""A kept inverted index: postings in slices of documents, searched without the documents' texts.

A slice is a bounded run of documents that one task reads; building shuffles nothing. Of each slice the index has one row with its
documents (``id`` is null) and one for each of its terms: the documents that have it, how often, and for each such count the
shortest document, from which follows the greatest weight that any of them can have, whatever the mean length becomes.
Terms are numbered by the XXH64 of their text; a build in which two terms share a number is an error.

Search reads only the rows of asked terms. A task goes through slices one by one and keeps each question's k best: a
slice is skipped whose bounds cannot reach the kth, and within one only documents are scored that have a term which matters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.search import lists_of, ranked, term_weights
from gleaner.staging import written
from gleaner.workers import pieces, with_package

#: Documents and postings of a slice, at which it is closed; rows told at once.
DOCS, POSTINGS, ROWS = 65_536, 1_000_000, 1024
#: Asked terms up to which the scan is told them, so that it skips row groups.
LISTED = 1000
#: Scores are rounded to six places before they are ranked; bounds are held against the kth with this much room.
ROOM = 1e-5

FIELDS = "slice bigint, id bigint, term string, n bigint, tokens bigint, docs array<int>, tf array<int>, top_tf array<int>, top_len array<int>, keys array<{kind}>, lens array<int>"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def numbers(terms: list[str]) -> np.ndarray:
    """The numbers of terms: their XXH64, as ``xxhash64`` of Spark gives it."""
    return np.array([xxhash.xxh64_intdigest(t.encode(), seed=42) for t in terms], np.uint64).view(np.int64)


class _Slice:
    """Documents that are gathered until they fill a slice."""

    def __init__(self) -> None:
        self.terms: dict[str, int] = {}
        self.keys, self.lens, self.pairs, self.docs, self.postings = [], [], [], 0, 0

    def add(self, keys: pa.Array, tokens: pa.Array) -> None:
        n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
        told = tokens.flatten().dictionary_encode()
        local = np.array([self.terms.setdefault(t, len(self.terms)) for t in told.dictionary.to_pylist()], np.int64)
        found = local[told.indices.to_numpy()] if len(told) else np.zeros(0, np.int64)
        pairs, tf = np.unique(np.repeat(np.arange(len(n)), n) << 32 | found, return_counts=True)
        self.pairs.append(((pairs >> 32) + self.docs, pairs & 0xFFFFFFFF, tf))
        self.keys.append(keys)
        self.lens.append(n)
        self.docs, self.postings = self.docs + len(n), self.postings + len(pairs)

    def rows(self, at: int) -> Iterator[pa.RecordBatch]:
        doc, term, tf = (np.concatenate(x) for x in zip(*self.pairs))
        lens, keys = np.concatenate(self.lens), pa.concat_arrays(self.keys)
        none = lambda kind: pa.nulls(1, pa.list_(kind))
        whole = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([len(keys)]), pa.array([int(lens.sum())]), *[none(pa.int32())] * 4, whole, lists_of(lens.astype(np.int32), np.array([len(lens)]))], names=NAMES)
        if not len(term):
            return
        order = np.argsort(term, kind="stable")  # documents of a term stay in order
        docs, counts = doc[order].astype(np.int32), tf[order].astype(np.int32)
        sizes = np.bincount(term, minlength=len(self.terms))
        by = np.lexsort((lens[doc], tf, term))
        head = np.ones(len(by), bool)  # of each term and count, the shortest document
        head[1:] = (term[by][1:] != term[by][:-1]) | (tf[by][1:] != tf[by][:-1])
        tops = by[head]
        names, m = list(self.terms), len(self.terms)
        nulls = lambda kind: pa.nulls(m, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, at)), pa.array(numbers(names)), pa.array(names), pa.array(sizes), nulls(pa.int64()), lists_of(docs, sizes), lists_of(counts, sizes),
             lists_of(tf[tops].astype(np.int32), np.bincount(term[tops], minlength=m)), lists_of(lens[doc][tops].astype(np.int32), np.bincount(term[tops], minlength=m)), nulls(pa.list_(keys.type)), nulls(pa.list_(pa.int32()))], names=NAMES)


def slices(docs: DataFrame, key: str, text: str = "text", batch: int = 0, docs_most: int = DOCS, postings_most: int = POSTINGS) -> DataFrame:
    """The rows of an index over documents. Null and empty texts are documents without a term; repeated rows are documents of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = batch << 48 | TaskContext.get().partitionId() << 24, _Slice()
        for whole in batches:
            for begin in range(0, whole.num_rows, min(ROWS, docs_most)):
                piece = whole.slice(begin, min(ROWS, docs_most))
                held.add(piece.column(0), piece.column(1))
                if held.docs >= docs_most or held.postings >= postings_most:
                    yield from held.rows(at)
                    at, held = at + 1, _Slice()
        if held.docs:
            yield from held.rows(at)

    kind = docs.schema[key].dataType.simpleString()
    return with_package(docs.select(F.col(key).alias("_k"), T.tokens(F.col(text)).alias("_t"))).mapInArrow(run, FIELDS.format(kind=kind))


def build(docs: DataFrame, path: str, key: str, text: str = "text", batch: int = 0, **most: int) -> DataFrame:
    """Writes an index of documents below a folder, or a further batch of them (of another number) to one that is there.

    A batch that is written again takes the place of what it wrote before. Files are sorted by terms, so that a search for few
    terms skips most of them.
    """
    slices(docs, key, text, batch, **most).sortWithinPartitions("id", "slice").write.mode("overwrite").parquet(f"{path}/batch={batch}")
    index = opened(docs.sparkSession, path)
    shared = index.where("id is not null").groupBy("id").agg(F.min("term").alias("a"), F.max("term").alias("b")).where("a != b").first()
    if shared:
        raise ValueError(f"terms {shared['a']!r} and {shared['b']!r} share the number {shared['id']}")
    return index


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def _kernel(sent, mean: float, k: int, k1: float, b: float):
    weight = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

    def found(rows: pa.Table, best: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Question, documents (their places in the slice) and scores; best: of each question, its k best scores so far."""
        ids, asked = sent
        lens = rows["lens"][0].values.to_numpy()
        terms = {}
        for i in range(1, len(rows)):
            place = np.searchsorted(ids, rows["id"][i].as_py())
            own = [rows[c][i].values.to_numpy() for c in ("docs", "tf", "top_tf", "top_len")]
            terms[int(place)] = own[0], weight(own[1], lens[own[0]]), weight(own[2], own[3]).max()
        for q, (wanted, weights) in enumerate(asked):
            here = [(w * terms[t][2], t, w) for t, w in zip(wanted, weights) if t in terms]
            least = best[q][0] - ROOM if len(best[q]) == k else 0.0
            here.sort()
            bounds = np.cumsum([h[0] for h in here])
            if not here or bounds[-1] < least:
                continue
            few = int(np.searchsorted(bounds, least)) if least > 0 else 0  # the first terms alone reach nothing
            must = here[few:]
            score = np.bincount(np.concatenate([terms[t][0] for _, t, _ in must]), np.concatenate([w * terms[t][1] for _, t, w in must]), len(lens))
            docs = np.flatnonzero(score)
            score = score[docs]
            for i in range(few - 1, -1, -1):
                fits = score + bounds[i] >= least
                docs, score = docs[fits], score[fits]
                own, of, _ = terms[here[i][1]]
                spot = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                score = score + np.where(own[spot] == docs, here[i][2] * of[spot], 0.0)
            score = np.round(score, 6)
            kth = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0
            fits = (score >= kth) & (score > 0)
            best[q] = np.sort(np.append(best[q], score[fits]))[-k:]
            fits &= score >= (best[q][0] if len(best[q]) == k else 0.0)
            yield q, docs[fits], score[fits]

    return found


def _asked(queries: DataFrame, query: str, k1: float, b: float) -> DataFrame:
    return term_weights(queries, query, "text", k1, b, F.lit(256.0)).select(query, F.xxhash64("term").alias("id"), "w")


def search(index: DataFrame, queries: DataFrame, key: str, query: str, k: int = 5, k1: float = 1.2, b: float = 0.75, most: int = 500_000) -> DataFrame:
    """query, key, score and rank: the rows that ``search.bm25`` gives of the documents, from their index alone.

    Questions of over ``most`` terms together are asked group by group. Without questions, or without a document that
    has a term of one, there is no row.
    """
    asked = _asked(queries, query, k1, b)
    got = asked.orderBy(query, "id").limit(most + 1).toArrow()
    if len(got) > most:
        groups = -(-2 * asked.count() // most)
        own = F.pmod(F.xxhash64(query), F.lit(groups))
        parts = [queries.where(own == g) for g in range(groups)]
        return reduce(DataFrame.union, (written(_asked_once(index, p, key, query, k, k1, b), "hits") for p in parts))
    return _asked_once(index, queries, key, query, k, k1, b)


def _asked_once(index: DataFrame, queries: DataFrame, key: str, query: str, k: int, k1: float, b: float) -> DataFrame:
    spark = index.sparkSession
    got = _asked(queries, query, k1, b).orderBy(query, "id").toArrow()
    names = pc.unique(got[query].combine_chunks())
    ids = np.unique(got["id"].to_numpy())
    if len(ids) <= LISTED:
        wanted = index.where(F.col("id").isin(ids.tolist()))
    else:
        wanted = index.join(F.broadcast(spark.createDataFrame(pa.table({"id": ids}))), "id", "left_semi")
    total, tokens = index.where("id is null").agg(F.sum("n"), F.sum("tokens")).first()
    df = np.zeros(len(ids))
    for r in wanted.groupBy("id").agg(F.sum("n").alias("n")).collect():  # of the asked terms only
        df[np.searchsorted(ids, r["id"])] = r["n"]
    idf = np.log(1 + ((total or 0) - df + 0.5) / (df + 0.5))
    row, place = pc.index_in(got[query].combine_chunks(), value_set=names).to_numpy(), np.searchsorted(ids, got["id"].to_numpy())
    weights = got["w"].to_numpy() * idf[place]
    order = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[order], np.arange(1, len(names)))
    each = [(p.tolist(), w.tolist()) for p, w in zip(np.split(place[order], cuts), np.split(weights[order], cuts))] if len(names) else []
    sent = spark.sparkContext.broadcast((ids, each))
    scalar = (tokens / total if total and tokens else 1.0, k, k1, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, best = _kernel(sent.value, *scalar), [np.zeros(0) for _ in sent.value[1]]
        for rows in _runs(batches):
            keys = rows["keys"][0].values
            for q, docs, score in found(rows, best):
                if len(docs):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), q)), keys.take(pa.array(docs)), pa.array(score)], names=["q", key, "score"])

    kind = index.schema["keys"].dataType.elementType.simpleString()
    dealt = wanted.unionByName(index.where("id is null")).select("slice", "id", "docs", "tf", "top_tf", "top_len", "keys", "lens").repartition("slice").sortWithinPartitions("slice", "id")
    hits = with_package(dealt).mapInArrow(run, f"q bigint, `{key}` {kind}, score double")
    told = spark.createDataFrame(list(enumerate(names.to_pylist())), f"q bigint, `{query}` {queries.schema[query].dataType.simpleString()}")
    return ranked(hits, ["q"], [F.desc("score"), F.col(key)], k).join(F.broadcast(told), "q").select(query, key, "score", "rank")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each slice, which follow each other."""
    held, at = [], None
    for batch in batches:
        column = batch.column("slice").to_numpy()
        cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), len(column)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            if held and column[begin] != at:
                yield pa.Table.from_batches(held)
                held = []
            at = column[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def vectors(docs: DataFrame, key: str, text: str = "text", k1: float = 1.2, b: float = 0.75, average: float | None = None) -> DataFrame:
    """key, ids (numbers of terms, ascending) and weights of each text with a term: sparse vectors, told in tasks.

    Weights saturate as in ``search.term_weights``; without a given average the mean length of all texts is taken.
    """
    told = docs.select(F.col(key).alias("_k"), T.tokens(F.col(text)).alias("_t"))
    mean = average or told.agg(F.avg(F.coalesce(F.size("_t"), F.lit(0)))).first()[0] or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches, 1):
            for begin in range(0, whole.num_rows, ROWS):
                piece = whole.slice(begin, ROWS)
                part = _Slice()
                part.add(piece.column(0), piece.column(1))
                (doc, term, tf), = part.pairs
                named = numbers(list(part.terms))
                order = np.lexsort((named[term], doc))
                w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * part.lens[0][doc] / mean))
                each = np.bincount(doc, minlength=part.docs)
                full = np.flatnonzero(each)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(full)), lists_of(named[term[order]], each[full]), lists_of(w[order], each[full])], names=[key, "ids", "weights"])

    return with_package(told).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<bigint>, weights array<double>")
