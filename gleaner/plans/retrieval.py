"""Queries for search and fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import answering, hybrid, inverted, search
from gleaner.plans.registry import query, table
from gleaner.staging import shared_dir

_BM25 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents),
q AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM benchmark),
m AS (SELECT avg(len(t)) AS mean, count(*) AS n FROM d),
dt AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
qt AS (SELECT item_id, len, term, count(*) AS tf FROM (SELECT item_id, len(t) AS len, unnest(t) AS term FROM q) GROUP BY ALL),
p AS (SELECT doc_id, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) AS w FROM dt, m),
a AS (SELECT item_id, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / 256.0::DOUBLE)) AS q FROM qt),
i AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, m GROUP BY term, n),
s AS (SELECT item_id, doc_id, round(sum(q * w * idf), 6) AS score FROM p JOIN a USING (term) JOIN i USING (term) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
"""


@query(_BM25 + "SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    """The best documents for each benchmark item, by sparse search."""
    return search.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id").select("item_id", "doc_id", "score", "rank")


@query(_BM25 + """, h AS (SELECT r.item_id, r.rank, contains(d.text, b.text) AS hit FROM r JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 5)
SELECT count(*) FILTER (best = 1) AS hit_at_1, count(*) FILTER (best <= 5) AS hit_at_5, count(*) AS items FROM (SELECT item_id, min(rank) FILTER (hit) AS best FROM h GROUP BY item_id)""")
def bm25_recall(spark, sf_dir):
    """How many items have a document that holds them verbatim at rank 1, and at rank 5 or before."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = search.bm25(docs, items, "doc_id", "item_id")
    held = found.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("item")), "item_id")
    best = held.groupBy("item_id").agg(F.min(F.when(F.contains("text", "item"), F.col("rank"))).alias("best"))
    return best.agg(F.count_if(F.col("best") == 1).alias("hit_at_1"), F.count_if(F.col("best") <= 5).alias("hit_at_5"), F.count("*").alias("items"))


@query(_BM25 + "SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def kept_index_topk(spark, sf_dir):
    """The best documents for each benchmark item, from an index that is built once and read in place of texts."""
    index = inverted.build(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "doc_id")
    return inverted.search(index, table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(_BM25 + """SELECT doc_id, count(*) AS terms, round(sum(w), 4) AS total, round(max(w), 6) AS greatest FROM p GROUP BY doc_id""")
def sparse_vectors(spark, sf_dir):
    """Each document's sparse vector: how many numbered terms it has, and their weights summed and at most."""
    told = inverted.vectors(table(spark, sf_dir, "documents"), "doc_id")
    return told.select("doc_id", F.size("ids").cast("bigint").alias("terms"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("weights"), 6).alias("greatest"))


_DENSE = """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label,
  round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 100 = 0")


@query(_DENSE + "SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    """The nearest vectors to each hundredth one, exact."""
    return search.dense(*_vectors(spark, sf_dir), 10)


_LISTS = _DENSE + """, l AS (
  SELECT query_id // 200 AS question, CASE query_id % 200 WHEN 0 THEN 'summary' ELSE 'fast' END AS list, rank, CAST(vec_id AS VARCHAR) AS path, CASE WHEN vec_id % 3 <> 0 THEN CAST(vec_id % 7 AS INTEGER) END AS chunk_index,
   CASE query_id % 200 WHEN 0 THEN 's' ELSE 'f' END || vec_id AS summary FROM r WHERE rank <= 40)
"""
_FUSE = """, f AS (SELECT question, path, chunk_index, round(sum(1.0::DOUBLE / (rank + {c})), 9) AS score, CASE WHEN count(DISTINCT list) > 1 THEN 'both' ELSE max(list) END AS tier,
  coalesce(arg_max(summary, rank) FILTER (list = 'summary'), arg_min(summary, rank)) AS summary, min(CASE list WHEN 'summary' THEN 0 ELSE 1 END * 1000 + rank) AS place FROM l GROUP BY question, path, chunk_index),
g AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, place, path) AS rank FROM f)
SELECT question, path, chunk_index, score, tier, summary, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 10"""


def _two_lists(spark, sf_dir):
    """Each two hundred's first and second asked vector are one question to two tiers."""
    hits = search.dense(*_vectors(spark, sf_dir), 40)
    name = F.when(F.col("query_id") % 200 == 0, "summary").otherwise("fast")
    chunk = F.when(F.col("vec_id") % 3 != 0, (F.col("vec_id") % 7).cast("int"))
    return hits.select(F.floor(F.col("query_id") / 200).alias("question"), name.alias("list"), "rank", F.col("vec_id").cast("string").alias("path"), chunk.alias("chunk_index"), F.concat(F.left(name, F.lit(1)), F.col("vec_id").cast("string")).alias("summary"))


@query(_LISTS + _FUSE.format(c=60))
def rrf_outer(spark, sf_dir):
    """Fusion of two tiers' hits: ranks from one, constant 60."""
    return search.fuse(_two_lists(spark, sf_dir), 10, base=1, constant=60, by=("question",))


@query(_BM25 + """, de AS (SELECT b.item_id, d.doc_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings v JOIN documents d ON d.doc_id = v.vec_id),
dr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM de),
l AS (SELECT item_id, doc_id, rank FROM dr WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank FROM r WHERE rank <= 20),
f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (rank + 1)), 9) AS score FROM l GROUP BY item_id, doc_id),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 20""")
def rrf_inner(spark, sf_dir):
    """Fusion of dense and sparse hits of each item: ranks from zero, constant 2."""
    docs, items, vectors = (table(spark, sf_dir, n) for n in ("documents", "benchmark", "embeddings"))
    held = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return hybrid.inner(search.dense(held, asked, 20).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank"), search.bm25(docs, items, "doc_id", "item_id", 20), ["item_id"], ["doc_id"], 20)


@query("""WITH m AS (SELECT v.label, q.vec_id, max(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))) AS m
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 GROUP BY v.label, q.vec_id)
SELECT label, round(sum(m), 6) AS score FROM m GROUP BY label ORDER BY score DESC, label LIMIT 5""")
def maxsim_topk(spark, sf_dir):
    """Late interaction, labels as documents, each hundredth vector as a token of one question."""
    return search.max_sim(*_vectors(spark, sf_dir), "label", 5)


@query("""WITH v AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 127) AS INTEGER)) AS e8 FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e8, v.e8), lambda p: p[1] * p[2])) AS rough,
  round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM v, v q WHERE q.vec_id % 100 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rough DESC, vec_id) AS n FROM s),
b AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM a WHERE n <= 20)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM b WHERE rank <= 10""")
def quantised_rescore(spark, sf_dir):
    """Search over 8-bit vectors with twice the candidates, then full precision."""
    return search.quantised(*_vectors(spark, sf_dir), 10)


@query("SELECT conv_id, turn, CASE WHEN " + " OR ".join("regexp_matches(text, '(?i)" + p + "')" for p in T.LIST_ALL) + " THEN 'LIST_ALL' ELSE 'GENERAL' END AS class FROM conversations")
def query_class(spark, sf_dir):
    """Which questions ask for everything."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.question_class(F.col("text")).alias("class"))


@query(r"""WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_$/.-]+'), lambda x: length(x) >= 2 AND lower(x) NOT IN ('""" + "','".join(T.STOP_WORDS) + r"""'))) AS tokens FROM benchmark WHERE item_id % 100 = 0),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents),
h AS (SELECT item_id, doc_id, line_number, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY line_number) AS n FROM l, t WHERE len(list_filter(tokens, lambda x: contains(line, x))) > 0)
SELECT item_id, doc_id, CAST(line_number AS INTEGER) AS line_number FROM h WHERE n <= 30""")
def grep_lines(spark, sf_dir):
    """The first 30 lines of each document that hold a telling token of a question, for every hundredth item as a question."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").where("item_id % 100 = 0")
    return answering.line_hits(docs.select(F.col("doc_id").alias("path"), "text"), items.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))).select(F.col("question_id").alias("item_id"), F.col("path").alias("doc_id"), "line_number")


@query("""WITH r AS (SELECT conv_id, turn, role || ': ' || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn DESC) AS context FROM r WHERE place <= 4 GROUP BY conv_id""")
def context_assembly(spark, sf_dir):
    """The last four turns of a conversation, the newest first, as one text."""
    from gleaner.operators.state import latest

    last = latest(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 4).select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    lines = F.reverse(F.array_sort(F.collect_list(F.struct("turn", "line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))
