"""Hybrid search over a table of questions: dense and sparse hits fused, a visual tier fused with them, then reranked.

Points: path, chunk_index (null: the file itself), vec_id, embedding and text. Questions: question_id, question, search (the
words searched for) and embedding. Pages: path, page, vec_id, embedding. Each step works on all questions at once; what a
question's class changes (how many hits, whether to rerank) are columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import search

# Hits for questions that ask for everything and for others, the local model's bound, and the pool of a rerank.
LIST_ALL_HITS, GENERAL_HITS, LOCAL_HITS = 30, 5, 12
RERANK_LEAST, RERANK_TIMES = 10, 2
# Constants of the two fusions.
INNER, OUTER = 2, 60

Rerank = Callable[[Column, Column], Column]


def overlap(question: Column, text: Column) -> Column:
    """A stand-in for a model: which share of the question's distinct tokens the text holds."""
    asked = F.array_distinct(T.tokens(question))
    return F.size(F.array_intersect(asked, T.tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def planned(questions: DataFrame, top_k: int = GENERAL_HITS, rerank: bool = False, local: bool = False, lists: bool = True) -> DataFrame:
    """The questions with class, top_k (widened for questions that ask for everything, never narrowed), rerank and fetch."""
    is_list = (T.question_class(F.col("question")) == "LIST_ALL") & F.lit(lists)
    wide = LIST_ALL_HITS if top_k < LIST_ALL_HITS else top_k
    wide = LOCAL_HITS if local and top_k < LIST_ALL_HITS and wide > LOCAL_HITS else wide
    k = F.when(is_list, wide).otherwise(top_k)
    again = F.lit(rerank) & ~is_list
    fetch = F.when(again, F.greatest(F.lit(RERANK_LEAST), RERANK_TIMES * k)).otherwise(k)
    return questions.withColumns({"class": T.question_class(F.col("question")), "top_k": k, "rerank": again, "fetch": fetch})


def inner(dense: DataFrame, sparse: DataFrame, by: list[str], key: list[str], k: int | Column) -> DataFrame:
    """by, key, score and rank: dense and sparse hits (with a rank from 1) fused by 1 / (2 + rank from 0)."""
    both = dense.select(*by, *key, "rank").unionByName(sparse.select(*by, *key, "rank"))
    found = both.groupBy(*by, *key).agg(F.round(F.sum(1.0 / (F.col("rank") + (INNER - 1))), 9).alias("score"))
    return search.ranked(found, by, [F.desc("score"), *map(F.col, key)], 1 << 30).where(F.col("rank") <= k)


def summary_tier(points: DataFrame, questions: DataFrame, most: int) -> DataFrame:
    """question_id, path, chunk_index, rank: of each planned question the 2 x fetch best points by both searches."""
    embedded = questions.where("embedding is not null").select(F.col("question_id").alias("vec_id"), "embedding")
    dense = search.dense(points.select("vec_id", "embedding"), embedded, most).select(F.col("query_id").alias("question_id"), "vec_id", "rank")
    sparse = search.bm25(points.select("vec_id", "text"), questions.select("question_id", F.col("search").alias("text")), "vec_id", "question_id", most).select("question_id", "vec_id", "rank")
    limit = questions.select("question_id", (2 * F.col("fetch")).alias("_limit"))
    cut = lambda hits: hits.join(limit, "question_id").where(F.col("rank") <= F.col("_limit")).drop("_limit")
    fused = cut(inner(cut(dense), cut(sparse), ["question_id"], ["vec_id"], most))
    return fused.join(points.select("vec_id", "path", "chunk_index"), "vec_id").select("question_id", "path", "chunk_index", "rank")


def visual_tier(pages: DataFrame, tokens: DataFrame, questions: DataFrame, most: int) -> DataFrame:
    """question_id, path, page, rank: of the best 2 x fetch pages by late interaction, each file's best, in order.

    tokens: question_id, vec_id and embedding, some rows for each question. Without pages or tokens there are no hits.
    """
    of = F.struct("path", "page")
    page_hits = search.max_sim(pages.withColumn("of", of), tokens, "of", most, "question_id")
    limit = questions.select("question_id", (2 * F.col("fetch")).alias("_limit"))
    page_hits = page_hits.join(limit, "question_id").where(F.col("rank") <= F.col("_limit"))
    best = page_hits.groupBy("question_id", F.col("of.path").alias("path")).agg(F.min_by("of.page", "rank").alias("page"), F.min("rank").alias("at"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("at"))).drop("at")


def merged(summary: DataFrame, visual: DataFrame | None, planned_: DataFrame) -> DataFrame:
    """question_id, path, chunk_index, score, tier, page and rank: both tiers' hits fused, the ``fetch`` best of each question."""
    hits = summary.select("question_id", F.lit("summary").alias("list"), "rank", "path", "chunk_index", F.lit(None).cast("string").alias("summary"))
    if visual is not None:
        shown = F.concat(F.lit("(visual match — page "), F.col("page").cast("string"), F.lit(")"))
        hits = hits.unionByName(visual.select("question_id", F.lit("fast").alias("list"), "rank", "path", F.lit(None).cast("int").alias("chunk_index"), shown.alias("summary")))
    hits = hits.where("path is not null and path != ''").join(planned_.select("question_id", "fetch"), "question_id")
    return search.fuse(hits, F.col("fetch"), 1, OUTER, ("question_id",))


def reranked(hits: DataFrame, planned_: DataFrame, texts: Column, rerank: Rerank = overlap) -> DataFrame:
    """The ``top_k`` best hits of each question, by the scorer where the question asks for it and has two hits or more.

    texts: what the scorer reads of a hit, null or empty for its path. Equal scores keep their order.
    """
    told = hits.join(planned_.select("question_id", "question", "top_k", "rerank"), "question_id")
    many = F.count("*").over(Window.partitionBy("question_id")) > 1
    read = F.when(F.coalesce(texts, F.lit("")) != "", texts).otherwise(F.col("path"))
    score = F.when(F.col("rerank") & many, rerank(F.col("question"), read)).otherwise(F.col("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("_score"), "rank")
    out = told.withColumn("_score", score.cast("double")).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("top_k"))
    return out.withColumns({"score": F.col("_score"), "rank": F.col("_rank")}).drop("_score", "_rank", "question", "top_k", "rerank")


def run_search(points: DataFrame, questions: DataFrame, pages: DataFrame | None = None, tokens: DataFrame | None = None, top_k: int = GENERAL_HITS, rerank: bool = False, local: bool = False, scorer: Rerank = overlap) -> DataFrame:
    """question_id, path, chunk_index, score, tier, summary and rank of the hits of all questions."""
    asked = planned(questions, top_k, rerank, local)
    most = 2 * max(RERANK_LEAST, RERANK_TIMES * max(top_k, LIST_ALL_HITS))  # no question fetches more
    visual = visual_tier(pages, tokens, asked, most) if pages is not None and tokens is not None else None
    hits = merged(summary_tier(points, asked, most), visual, asked)
    texts = points.select("path", "chunk_index", F.col("text").alias("_text"))
    read = hits.alias("h").join(texts.alias("t"), (F.col("h.path") == F.col("t.path")) & F.col("h.chunk_index").eqNullSafe(F.col("t.chunk_index")), "left").select("h.*", F.coalesce("h.summary", "_text").alias("_text"))
    return reranked(read, asked, F.col("_text"), scorer).withColumn("summary", F.col("_text")).drop("_text", "fetch")


def rows_of_hits(hits: DataFrame, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """For each question and file: its best rank (files keep the order of their first hit) and its hit rows, sorted."""
    return hits.groupBy(*keys, "path").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_set("chunk_index")).alias("rows"))


def with_keywords(query: Column, keywords: Column) -> Column:
    """What is searched for: the query and its keywords."""
    return F.trim(F.concat_ws(" ", query, F.array_join(keywords, " ")))


def rewritten(question: Column, query: Column, keywords: Column) -> Column:
    """A model's rewriting of a question, with the question itself where the model gave none."""
    return with_keywords(F.when(F.coalesce(query, F.lit("")) != "", query).otherwise(question), keywords)


def rewrite_prompt(question: Column, history: Column) -> Column:
    """The question after the turns before it (array of struct<q, a>), numbered; alone where there are none."""
    number = lambda i: F.concat(F.lit("[Turn "), (i + 1).cast("string"), F.lit("] "))
    turns = F.transform(history, lambda t, i: F.concat(number(i), F.lit("Q: "), t["q"], F.lit("\n"), number(i), F.lit("A: "), t["a"]))
    told = F.concat(F.lit("Previous conversation turns:\n"), F.array_join(turns, "\n"), F.lit("\n\nCurrent question: "), question)
    return F.when(F.coalesce(F.size(history), F.lit(0)) > 0, told).otherwise(question)
