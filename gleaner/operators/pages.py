"""Which pages of long documents to read for many questions at once: one pass over the texts, counts joined with questions.

All keywords make one automaton, which is run once over each page; what is shuffled are counts, not texts. Texts are read
again only of the pages that are chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import routing
from gleaner.functions import text as T
from gleaner.staging import written
from gleaner.workers import pieces, with_package

#: Characters of keywords in one automaton; more are asked in several passes.
MOST = 4_000_000


def counted(texts: DataFrame, keywords: list[str]) -> DataFrame:
    """doc, page, keyword and hits (occurrences that do not overlap) of the lower-cased text in ``low``."""
    sent = texts.sparkSession.sparkContext.broadcast(keywords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, word in enumerate(sent.value):
            found.add_word(word, (k, len(word)))
        found.make_automaton()
        for batch in pieces(batches, "low"):  # a page has hits of very many keywords
            row, word, hits = [], [], []
            for i, low in enumerate(batch.column("low").to_pylist()):
                count: dict[int, int] = {}
                ends: dict[int, int] = {}
                for end, (k, size) in found.iter(low or ""):
                    if end - size >= ends.get(k, -1):
                        ends[k] = end
                        count[k] = count.get(k, 0) + 1
                row += [i] * len(count)
                word += [sent.value[k] for k in count]
                hits += count.values()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(at), batch.column("page").take(at), pa.array(word, pa.string()), pa.array(hits, pa.int64())], names=["doc", "page", "keyword", "hits"])

    kind = {f.name: f.dataType.simpleString() for f in texts.schema}
    return with_package(texts.select("doc", "page", "low")).mapInArrow(run, f"doc {kind['doc']}, page {kind['page']}, keyword string, hits bigint")


def chosen(pages: DataFrame, asks: DataFrame, top: int = 10, around: int = 1, budget: int = 25_000) -> DataFrame:
    """question_id, doc, page, hits and block (an anchor and the text) of the pages to read for each question.

    pages: doc, page (from 1, each once) and text; asks: question_id, doc and keywords (array), one row for each pair. Pages score by how
    often they hold the keywords, in any case; contents pages are left out of the scores. The ``top`` best (ties: the
    earlier) and ``around`` pages beside each are read in order until a question's blocks of a document hold ``budget`` characters; the page
    that gets there is the last. A question without keywords (blank ones do not count), or without a hit, has no pages.

    Cases: a null text is an empty page; keywords that come twice count twice; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    label = routing.page_label(text)
    anchor = F.concat(F.lit("## PDF page "), F.col("page").cast("string"), F.coalesce(F.concat(F.lit(" (book p. "), label, F.lit(")")), F.lit("")))
    words = asks.select("question_id", "doc", F.explode(F.transform(F.filter("keywords", lambda k: F.trim(k) != ""), lambda k: F.lower(k))).alias("keyword"))
    words = written(words.groupBy("question_id", "doc", "keyword").agg(F.count("*").alias("times")), "page_questions")
    distinct = words.select("keyword").distinct().withColumn("part", F.floor(F.sum(F.length("keyword")).over(Window.orderBy("keyword")) / MOST))  # a stated set
    sizes = written(pages.select("doc", "page", F.length(F.concat(anchor, F.lit("\n"), text)).alias("size"), T.toc_page(text).alias("toc")), "page_sizes")
    texts = pages.join(sizes.where("not toc").select("doc", "page"), ["doc", "page"], "left_semi").select("doc", "page", F.lower(text).alias("low"))
    hits = None
    parts: dict[int, list[str]] = {}
    for r in distinct.collect():
        parts.setdefault(r["part"], []).append(r["keyword"])
    for own in parts.values():
        found = counted(texts, own)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = texts.where("false").select("doc", "page", F.col("low").alias("keyword"), F.lit(0).cast("bigint").alias("hits"))
    scored = hits.join(words, ["doc", "keyword"]).groupBy("question_id", "doc", "page").agg(F.sum(F.col("hits") * F.col("times")).alias("hits"))
    scored = written(scored, "page_hits")
    best = Window.partitionBy("question_id", "doc").orderBy(F.desc("hits"), "page")
    seeds = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top)
    near = seeds.select("question_id", "doc", F.explode(F.sequence(F.col("page") - around, F.col("page") + around)).alias("page")).distinct()
    before = F.sum("size").over(Window.partitionBy("question_id", "doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))  # a few pages
    read = near.join(sizes, ["doc", "page"]).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget)
    told = read.join(scored, ["question_id", "doc", "page"], "left").select("question_id", "doc", "page", F.coalesce("hits", F.lit(0).cast("bigint")).alias("hits"))
    return told.join(pages.select("doc", "page", F.concat(anchor, F.lit("\n"), text).alias("block")), ["doc", "page"]).select("question_id", "doc", "page", "hits", "block")


def excerpts(found: DataFrame) -> DataFrame:
    """question_id, doc and text: the chosen pages in order, as one text; a budget bounds it."""
    pages = F.array_sort(F.collect_list(F.struct("page", "block")))
    return found.groupBy("question_id", "doc").agg(F.array_join(F.transform(pages, lambda p: p["block"]), "\n\n").alias("text"))
