"""Queries over the engine's own steps: routing, the manifest's marks, hybrid search, prompts, evaluation, settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import answering, evaluation, hybrid, index, router, rows, search, state
from gleaner.operators import manifest as M
from gleaner.plans.registry import ORACLE_SQL, query, table
from gleaner.plans.retrieval import _BM25

# ---- routing: documents stand for files, with what a peek would tell of them derived from their ids and sizes

_EXTS = (".pdf", ".pdf", ".docx", ".xlsx", ".pptx", ".html", ".ipynb", ".png", ".txt", ".py", ".json", ".csv", ".zip")


def peeks(spark, sf_dir) -> DataFrame:
    k, n = F.col("doc_id"), F.col("n_chars")
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (k % len(_EXTS)).cast("int") + 1)
    image = ext == ".png"
    return table(spark, sf_dir, "documents").select(
        "doc_id", ext.alias("ext"), F.when(k % 97 == 0, ".bashrc").otherwise(F.concat(F.lit("f"), ext)).alias("name"), (n * 211).alias("size_bytes"), (k % 53).alias("page_count"), (n % 700).alias("text_density"),
        (k % 5 != 0).alias("extractable"), ((k % 10) / F.lit(10.0)).alias("image_ratio"), (n * 37).alias("row_count"), F.when(image, k * 7 % 1500).alias("width"), F.when(image, n % 1500).alias("height"),
        F.left(F.concat(F.when(k % 2 == 0, "hereby total balance SSN ").otherwise(""), F.col("text")), F.lit(5000)).alias("peek_text"), F.when(k % 31 == 0, "broken").alias("peek_error"),
        F.when(k % 7 == 0, "Critical").when(k % 7 == 1, "casual").alias("accuracy"), F.when(k % 11 == 0, "never").when(k % 11 == 1, "always").alias("visual"), F.when(k % 3 == 0, 0.01).alias("budget_gb"),
        (k % 4 != 0).alias("gpu"), F.when(k % 6 == 0, 8.0).otherwise(0.0).alias("used_mb"),
    )


_PEEKS = f"""
p AS (SELECT doc_id AS k, n_chars AS n, text, ['{"','".join(_EXTS)}'][doc_id % {len(_EXTS)} + 1] AS ext, doc_id % 97 = 0 AS dot, n_chars * 211 AS size, doc_id % 53 AS pages, n_chars % 700 AS density, doc_id % 5 <> 0 AS ok,
 (doc_id % 10) / 10.0::DOUBLE AS ratio, n_chars * 37 AS n_rows, doc_id * 7 % 1500 AS w, n_chars % 1500 AS h, doc_id % 31 = 0 AS bad, doc_id % 4 <> 0 AS gpu, CASE WHEN doc_id % 6 = 0 THEN 8.0 ELSE 0.0 END AS used FROM documents),
q AS (SELECT p.*, s.score AS sens,
 CASE ext WHEN '.txt' THEN 'text' WHEN '.py' THEN 'code' WHEN '.json' THEN 'config' ELSE substr(ext, 2) END AS kind0, greatest(pages, 1) * 0.2::DOUBLE AS mb0, greatest(pages, 1) * CASE WHEN gpu THEN 1.0 ELSE 10.0 END AS s0,
 least(10, CASE ext WHEN '.pdf' THEN CASE WHEN density < 50 THEN 5 WHEN density < 500 THEN 2 ELSE 0 END + CASE WHEN ok THEN 0 ELSE 3 END WHEN '.docx' THEN CASE WHEN ratio > 0.3 THEN 2 ELSE 0 END
  WHEN '.png' THEN CASE WHEN w >= 600 AND h >= 600 THEN 4 ELSE 0 END + CASE WHEN h <> 0 AND (w / h < 0.65 OR w / h > 1.6) THEN 1 ELSE 0 END ELSE 0 END) AS vs FROM p JOIN ({ORACLE_SQL["sensitivity_score"].replace("FROM documents", "FROM (SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 'hereby total balance SSN ' ELSE '' END || text)[1:5000] AS text FROM documents)")}) s ON s.doc_id = p.k),
r AS (SELECT *, CASE WHEN dot THEN 'dotfile' ELSE kind0 END AS kind, CASE WHEN k % 7 = 0 OR sens >= 4 THEN 'critical' WHEN k % 7 = 1 THEN 'casual' ELSE 'normal' END AS lv, CASE WHEN k % 7 = 0 THEN 'user' WHEN sens >= 4 THEN 'auto' WHEN k % 7 = 1 THEN 'user' ELSE 'default' END AS og,
 mb0 <= 50 AND s0 <= CASE WHEN gpu THEN 30 ELSE 10 END AND used + mb0 <= CASE WHEN k % 3 = 0 THEN 10.24 ELSE 5120 END AND k % 11 <> 0 AS see FROM q),
t AS (SELECT *, CASE WHEN lv = 'critical' THEN 'T3,T2' ELSE 'T2' END AS rd, CASE WHEN lv = 'critical' THEN 'T3,T4' ELSE 'T4' END AS sh,
 CASE WHEN bad AND size = 0 AND text[1:5000] = '' AND k % 2 = 1 THEN 'peek failed: broken' WHEN dot THEN NULL WHEN kind = 'zip' THEN 'unsupported extension: .zip' WHEN bad AND kind <> 'pdf' THEN 'peek failed: broken' WHEN kind = 'png' AND size < 51200 AND w < 600 AND h < 600 THEN 'thumbnail'
  WHEN kind = 'pdf' AND pages = 0 THEN 'pdf empty or unreadable: ' || CASE WHEN bad THEN 'broken' ELSE 'None' END WHEN kind = 'pptx' AND pages = 0 THEN 'pptx unreadable: empty' WHEN kind = 'html' AND (NOT ok OR density = 0) THEN 'html extracted empty — likely JS-only SPA'
  WHEN kind = 'ipynb' AND pages = 0 THEN 'ipynb has no cells' END AS skip FROM r),
d AS (SELECT *, CASE WHEN skip IS NOT NULL THEN '' ELSE CASE kind WHEN 'text' THEN CASE WHEN size >= 102400 THEN 'T0' ELSE 'T1' END WHEN 'dotfile' THEN CASE WHEN size >= 102400 THEN 'T0' ELSE 'T1' END WHEN 'code' THEN CASE WHEN size >= 512000 THEN 'T0' ELSE 'T1' END
  WHEN 'config' THEN CASE WHEN size >= 51200 THEN 'T0' ELSE 'T1' END WHEN 'csv' THEN CASE WHEN size < 20971520 THEN 'T1' WHEN n_rows <= 100000 THEN 'T2' ELSE 'T0' END
  WHEN 'pdf' THEN CASE WHEN pages <= 5 AND k % 11 <> 1 THEN 'T3' WHEN vs < 7 AND ok AND density >= 100 THEN rd WHEN see THEN sh ELSE 'T3' END WHEN 'docx' THEN CASE WHEN ratio > 0.3 AND see THEN sh ELSE rd END
  WHEN 'xlsx' THEN CASE WHEN size > 10485760 THEN 'T0' ELSE rd END WHEN 'pptx' THEN CASE WHEN ratio >= 0.5 AND see THEN rd || ',T4' ELSE rd END WHEN 'png' THEN CASE WHEN see THEN sh ELSE 'T3' END ELSE rd END END AS routes FROM t)
"""


@query("WITH " + _PEEKS + """SELECT k AS doc_id, routes, CASE WHEN routes = '' THEN NULL WHEN contains(routes, 'T3') THEN 'T3' WHEN contains(routes, 'T2') THEN 'T2' WHEN contains(routes, 'T4') THEN 'T4' ELSE routes END AS primary_tier, skip AS skip_reason, CAST(vs AS INTEGER) AS visual_score, CAST(sens AS INTEGER) AS sensitivity,
 CASE WHEN skip IS NULL THEN lv ELSE 'normal' END AS level, CASE WHEN skip IS NULL THEN og ELSE 'default' END AS origin, CASE WHEN skip IS NULL AND kind IN ('pdf', 'docx', 'pptx', 'png') THEN mb0 ELSE 0.0::DOUBLE END AS cost_mb FROM d""")
def route_decision(spark, sf_dir):
    """The tiers of each file, why it is skipped, its scores, criticality and cost."""
    found = router.decided(peeks(spark, sf_dir)).withColumn("primary_tier", router.primary(F.col("routes")))
    return found.select("doc_id", F.array_join("routes", ",").alias("routes"), "primary_tier", "skip_reason", F.col("visual_score").cast("int").alias("visual_score"), F.col("sensitivity").cast("int").alias("sensitivity"), "level", "origin", "cost_mb")


@query("WITH " + _PEEKS + """, e AS (SELECT unnest(CASE WHEN routes = '' THEN ['skip'] WHEN contains(routes, ',') THEN list_append(string_split(routes, ','), 'several') ELSE [routes] END) AS tier FROM d) SELECT tier, count(*) AS files FROM e GROUP BY tier""")
def route_tally(spark, sf_dir):
    """Files by tier."""
    return router.tally(router.decided(peeks(spark, sf_dir)))


# each file decided with nothing used, those that are to be seen let in one after another, and the others decided with nothing left
_FIRST = _PEEKS.replace("CASE WHEN doc_id % 6 = 0 THEN 8.0 ELSE 0.0 END AS used", "0.0 AS used")
_AGAIN = re.sub(r"\bsee\b", "(see AND NOT gone)", _FIRST[_FIRST.rindex("d AS (SELECT") :].replace("d AS (SELECT", "e AS (SELECT")).replace("FROM t)", "FROM t JOIN o USING (k))")


@query("WITH RECURSIVE " + _FIRST + f""", w AS (SELECT k, greatest(pages, 1) AS units, row_number() OVER (ORDER BY k) AS n FROM d WHERE contains(routes, 'T4')),
f AS (SELECT n, k, CASE WHEN units <= 1000 THEN units ELSE 0 END AS used, units > 1000 AS gone FROM w WHERE n = 1 UNION ALL SELECT w.n, w.k, CASE WHEN used + units <= 1000 THEN used + units ELSE used END, used + units > 1000 FROM f JOIN w ON w.n = f.n + 1),
o AS (SELECT p.k, coalesce(f.gone, false) AS gone FROM p LEFT JOIN f USING (k)), {_AGAIN} SELECT k AS doc_id, routes, skip AS skip_reason FROM e""")
def visual_budget(spark, sf_dir):
    """The tiers of the files of a corpus that shares 200 MB of the visual tier, in the order of their ids."""
    found = router.within_budget(peeks(spark, sf_dir).drop("used_mb"), "doc_id", 200.0)
    return found.select("doc_id", F.array_join("routes", ",").alias("routes"), "skip_reason")


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'skip' WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 53 < 1 THEN 'skip' WHEN doc_id % 53 - 1 > 50 OR n_chars >= 100 THEN 'summary' ELSE 'fast' END WHEN doc_id % 3 = 1 THEN 'fast' ELSE 'summary' END AS tier, CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 1 END AS pool FROM documents""")
def two_tiers(spark, sf_dir):
    """The older routing into two tiers, and how far patches are pooled."""
    k = F.col("doc_id")
    ext = F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, ".jpg").otherwise(".pptx")
    name = F.when(k % 9 == 0, ".hidden").otherwise("shown")
    return table(spark, sf_dir, "documents").select("doc_id", router.two_tiers(ext, name, k % 53 - 1, F.col("n_chars")).alias("tier"), router.pool_factor(ext).cast("int").alias("pool"))


# ---- the manifest: documents known to it, and files as they are now


def _path(column="doc_id"):
    return F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col(column).cast("string"), F.lit(".txt"))


def manifest(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id")
    at = lambda mod: F.when(k % mod != 0, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(
        _path().alias("path"), F.col("n_chars").alias("size"), F.when(k % 4 != 0, F.concat(k.cast("string"), F.lit(".md"))).alias("summary_file"), at(4).alias("summarized_at"), at(5).alias("ingested_at"), F.when(k % 10 == 1, k % 4).alias("row_count"), at(2).alias("fast_indexed_at"), F.when(k % 2 != 0, k % 9).alias("fast_pages"),
        (k % 100).cast("double").alias("mtime"), F.array(F.when(k % 2 == 0, "T1").otherwise("T2")).alias("routes"), F.lit(1).alias("visual_score"), F.lit(2).alias("sensitivity_score"), F.lit(0.5).alias("cost_mb"), F.lit(1.0).alias("cost_s"), F.lit("normal").alias("level"), F.lit("default").alias("origin"), F.lit(None).cast("string").alias("skip_reason"), F.lit(None).cast("string").alias("content_hash"),
    )


def files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(_path().alias("path"), (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("size"), (F.col("doc_id") % 90).cast("double").alias("mtime"), "doc_id")


_M = """m AS (SELECT '/' || source || '/' || doc_id || '.txt' AS path, doc_id AS k, n_chars AS size, CASE WHEN doc_id % 4 <> 0 THEN doc_id || '.md' END AS summary_file, doc_id % 4 <> 0 AS summarized, doc_id % 5 <> 0 AS ingested, CASE WHEN doc_id % 10 = 1 THEN doc_id % 4 END AS row_count, doc_id % 2 <> 0 AS fast,
 CASE WHEN doc_id % 2 <> 0 THEN doc_id % 9 END AS fast_pages, (doc_id % 100)::DOUBLE AS mtime, CASE WHEN doc_id % 2 = 0 THEN 'T1' ELSE 'T2' END AS routes FROM documents WHERE doc_id % 3 <> 0),
f AS (SELECT '/' || source || '/' || doc_id || '.txt' AS path, doc_id AS k, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, (doc_id % 90)::DOUBLE AS mtime FROM documents WHERE doc_id % 5 <> 0)
"""


def _shown(found: DataFrame) -> DataFrame:
    stamp = lambda c: F.when(F.col(c).isNotNull(), F.year(c)).alias(c)
    return found.select("path", "size", "summary_file", stamp("summarized_at"), stamp("ingested_at"), stamp("fast_indexed_at"), "fast_pages", F.array_join("routes", ",").alias("routes"), "level", "content_hash")


def _mark(spark, sf_dir, name: str) -> DataFrame:
    """Two events for each file, of which the newer counts."""
    found = files(spark, sf_dir).select(
        "path", "size", F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("summary_file"), F.lit(3).cast("bigint").alias("fast_pages"), F.array(F.lit("T3"), F.lit("T4")).alias("routes"), F.lit(7).alias("visual_score"), F.lit(8).alias("sensitivity_score"),
        F.lit(2.0).alias("cost_mb"), F.lit(3.0).alias("cost_s"), F.lit("critical").alias("level"), F.lit("auto").alias("origin"), F.lit(None).cast("string").alias("skip_reason"), F.lit("abc").alias("content_hash"), F.to_timestamp(F.lit("2025-01-01 00:00:00")).alias("at"),
    )
    old = found.withColumns({"size": F.lit(-1).cast("bigint"), "content_hash": F.lit("old"), "summary_file": F.lit("old"), "level": F.lit("casual"), "fast_pages": F.lit(0).cast("bigint"), "at": F.to_timestamp(F.lit("2023-01-01 00:00:00"))})
    return _shown(M.mark(manifest(spark, sf_dir), found.unionByName(old), name))


def _mark_sql(creates: bool = True, size="coalesce(f.size, m.size)", summary="m.summary_file", summarized="CASE WHEN m.summarized THEN 2024 END", ingested="CASE WHEN m.ingested THEN 2024 END", fast="CASE WHEN m.fast THEN 2024 END", pages="m.fast_pages", routes="coalesce(m.routes, '')", level="'normal'", content="NULL::VARCHAR") -> str:
    return f"""WITH {_M} SELECT coalesce(m.path, f.path) AS path, {size} AS size, {summary} AS summary_file, CAST({summarized} AS INTEGER) AS summarized_at, CAST({ingested} AS INTEGER) AS ingested_at, CAST({fast} AS INTEGER) AS fast_indexed_at,
 CAST({pages} AS BIGINT) AS fast_pages, {routes} AS routes, {level} AS level, {content} AS content_hash FROM m {"FULL" if creates else "LEFT"} JOIN f ON m.path = f.path"""


_HAS = "CASE WHEN f.path IS NOT NULL THEN {} ELSE {} END"


@query(_mark_sql(summary=_HAS.format("'new' || f.k", "m.summary_file"), summarized=_HAS.format("2025", "CASE WHEN m.summarized THEN 2024 END"), ingested=_HAS.format("NULL", "CASE WHEN m.ingested THEN 2024 END")))
def mark_summarized(spark, sf_dir):
    """A new summary: what the visual tier and the router said stays, and the file waits to be ingested."""
    return _mark(spark, sf_dir, "summarized")


@query(_mark_sql(creates=False, size="m.size", ingested=_HAS.format("2025", "CASE WHEN m.ingested THEN 2024 END")))
def mark_ingested(spark, sf_dir):
    """Files that are in the index now; unknown ones make no rows."""
    return _mark(spark, sf_dir, "ingested")


@query(_mark_sql(routes=_HAS.format("'T3,T4'", "m.routes"), level=_HAS.format("'critical'", "'normal'")))
def mark_routed(spark, sf_dir):
    """The router's verdict."""
    return _mark(spark, sf_dir, "routed")


@query(_mark_sql(fast=_HAS.format("2025", "CASE WHEN m.fast THEN 2024 END"), pages=_HAS.format("3", "m.fast_pages")))
def mark_fast_indexed(spark, sf_dir):
    """Files that the visual tier holds now."""
    return _mark(spark, sf_dir, "fast_indexed")


@query(_mark_sql(size="coalesce(m.size, 0)", content=_HAS.format("'abc'", "NULL")))
def mark_content_hash(spark, sf_dir):
    """Hashes of contents; a file unknown so far gets a row of size 0."""
    return _mark(spark, sf_dir, "content_hash")


@query(f"""WITH {_M} SELECT f.path, m.path IS NULL OR m.size <> f.size OR f.mtime > m.mtime AS summary, m.path IS NOT NULL AND NOT m.ingested AS ingest, m.path IS NULL OR NOT m.fast OR m.size <> f.size AS fast,
 m.path IS NOT NULL AND m.size = f.size AND (m.summary_file IS NOT NULL OR m.fast) AS done FROM f LEFT JOIN m ON m.path = f.path""")
def needs_work(spark, sf_dir):
    """Which work each file needs, times of change counted."""
    return M.needs(files(spark, sf_dir), manifest(spark, sf_dir), by_mtime=True)


@query(f"""WITH {_M} SELECT m.path, 'stale' AS state FROM m ANTI JOIN f ON m.path = f.path UNION ALL SELECT m.path, CASE WHEN m.k % 8 = 1 THEN 'anew' ELSE 'kept' END FROM m LEFT JOIN f ON m.path = f.path
 WHERE NOT (m.summary_file IS NOT NULL AND m.k % 8 = 1 AND f.path IS NULL)""")
def manifest_cleaned(spark, sf_dir):
    """Rows whose file is gone, and rows after those whose summary is gone lost it: an eighth of the summaries are."""
    known, now = manifest(spark, sf_dir), files(spark, sf_dir)
    left = known.where(~F.coalesce(F.regexp_extract("summary_file", r"^(\d+)", 1).try_cast("bigint") % 8 == 1, F.lit(False))).select("summary_file").where("summary_file is not null")
    cleaned = M.clean_missing_summaries(known, now, left)
    number = F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("bigint")
    anew = F.col("summary_file").isNull() & F.col("summarized_at").isNull() & F.col("ingested_at").isNull() & (number % 8 == 1)
    return M.clean_stale(known, now)[1].select("path", F.lit("stale").alias("state")).union(cleaned.select("path", F.when(anew, "anew").otherwise("kept")))


@query(f"""WITH {_M}, c AS (SELECT '/' || source || '/' || doc_id || '.txt' AS path, doc_id % 3 + 1 AS pages FROM documents WHERE doc_id % 4 = 1) SELECT m.path, CAST(CASE WHEN c.path IS NOT NULL THEN 2026 WHEN m.fast THEN 2024 END AS INTEGER) AS year, CAST(coalesce(c.pages, m.fast_pages) AS BIGINT) AS fast_pages FROM m LEFT JOIN c ON m.path = c.path""")
def reconcile_fast(spark, sf_dir):
    """What the visual tier holds, written back to the manifest."""
    held = table(spark, sf_dir, "documents").where("doc_id % 4 = 1").select(_path().alias("path"), F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3)).alias("page"))
    got = M.reconcile_fast(manifest(spark, sf_dir), held, F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    return got.select("path", F.year("fast_indexed_at").alias("year"), "fast_pages")


_ROOTS = "r AS (SELECT DISTINCT '/' || source AS path, source[-1:] < '5' AS enabled FROM documents)"


def _roots(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().select(F.concat(F.lit("/"), "source").alias("path"), (F.right("source", F.lit(1)) < "5").alias("enabled"))


@query(f"WITH {_M}, {_ROOTS} SELECT m.path FROM m SEMI JOIN r ON r.enabled AND starts_with(m.path, r.path || '/')")
def within_roots(spark, sf_dir):
    """Rows of the manifest below an enabled root."""
    return M.within_roots(manifest(spark, sf_dir), _roots(spark, sf_dir)).select("path")


@query(f"""WITH {_M} SELECT 'files' AS name, count(*) AS n FROM m UNION ALL SELECT 'summarized', count(summary_file) FROM m UNION ALL SELECT 'ingested', count(*) FILTER (ingested) FROM m UNION ALL SELECT 'fast', count(*) FILTER (fast) FROM m UNION ALL SELECT 'skipped', 0 UNION ALL SELECT routes, count(*) FROM m GROUP BY routes""")
def manifest_tiers(spark, sf_dir):
    """Rows of the manifest by state, and by tier."""
    return M.stats(manifest(spark, sf_dir))


_UUID = r"regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


@query(f"""WITH {_M}, a AS (SELECT path || '::row:' || i AS key FROM (SELECT path, unnest(range(row_count)) AS i FROM m WHERE row_count > 0) UNION ALL SELECT path FROM m WHERE row_count IS NULL OR row_count = 0 OR summary_file IS NOT NULL) SELECT DISTINCT {_UUID.format("key")} AS point_id FROM a""")
def expected_points(spark, sf_dir):
    """Ids of all points that the manifest asks for."""
    return index.expected(manifest(spark, sf_dir))


@query(f"""WITH {_M}, {_ROOTS}, n AS (SELECT f.path, r.path AS folder, f.size, m.path IS NULL OR m.size <> f.size AS summary FROM f JOIN r ON starts_with(f.path, r.path || '/') LEFT JOIN m ON m.path = f.path)
SELECT r.path AS folder, count(n.path) AS total, count(*) FILTER (n.summary) AS remaining, CAST(coalesce(sum(n.size), 0) AS BIGINT) AS size FROM r LEFT JOIN n ON n.folder = r.path GROUP BY r.path UNION ALL SELECT NULL, count(*), count(*) FILTER (summary), CAST(coalesce(sum(size), 0) AS BIGINT) FROM n""")
def plan_by_folder(spark, sf_dir):
    """Files, remaining files and sizes of each root, and of all."""
    return index.by_folder(files(spark, sf_dir), manifest(spark, sf_dir), _roots(spark, sf_dir))


# ---- search: documents are points where a vector has their id, benchmark items are questions


def points(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id", "embedding")
    return table(spark, sf_dir, "documents").join(v, "doc_id").select("vec_id", _path().alias("path"), F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") % 3).cast("int").alias("chunk_index"), "embedding", "text")


def questions(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    ask = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("List all of the "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").join(v, "item_id").select(F.col("item_id").alias("question_id"), ask.alias("question"), F.col("text").alias("search"), "embedding")


def _hybrid(spark, sf_dir, **kind) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    pages = v.select(F.concat(F.lit("/scan/"), (F.col("vec_id") % 50).cast("string")).alias("path"), F.col("vec_id").alias("page"), "vec_id", "embedding")
    items = table(spark, sf_dir, "benchmark").select("item_id")
    tokens = items.select(F.col("item_id").alias("question_id"), F.explode(F.array("item_id", F.col("item_id") + 40)).alias("vec_id")).join(v.select("vec_id", "embedding"), "vec_id")
    return hybrid.run_search(points(spark, sf_dir), questions(spark, sf_dir), pages, tokens, **kind)


_CLASS = "CASE WHEN i.item_id % 3 = 0 OR " + " OR ".join("regexp_matches(i.text, '(?i)" + p + "')" for p in T.LIST_ALL) + " THEN 30 ELSE 5 END"
_DOT = "list_sum(list_transform(list_zip({}, {}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_PATH = "'/' || d.source || '/' || d.doc_id || '.txt'"
_HYBRID = f"""WITH pt AS (SELECT v.vec_id, {_PATH} AS path, CASE WHEN d.doc_id % 4 = 0 THEN CAST(d.doc_id % 3 AS INTEGER) END AS chunk_index, v.embedding AS e, d.text, d.doc_id FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id),
qs AS (SELECT i.item_id, {_CLASS} AS k, v.embedding AS e, i.text FROM benchmark i JOIN embeddings v ON v.vec_id = i.item_id),
""" + _BM25.strip().removeprefix("WITH ").replace("FROM documents", "FROM pt").replace("FROM benchmark", "FROM qs") + f""",
dh AS (SELECT qs.item_id, vec_id, row_number() OVER (PARTITION BY qs.item_id ORDER BY round({_DOT.format("qs.e", "pt.e")}, 6) DESC, vec_id) AS rank, k FROM qs, pt),
sh AS (SELECT r.item_id, r.doc_id AS vec_id, r.rank, k FROM r JOIN qs USING (item_id)),
ih AS (SELECT item_id, vec_id, k, round(sum(1.0::DOUBLE / (rank + 1)), 9) AS score FROM (SELECT * FROM dh WHERE rank <= 2 * k UNION ALL BY NAME SELECT * FROM sh WHERE rank <= 2 * k) GROUP BY ALL),
il AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank FROM ih),
pg AS (SELECT vec_id AS page, '/scan/' || vec_id % 50 AS path, embedding AS e FROM embeddings),
tk AS (SELECT i.item_id, v.vec_id, v.embedding AS e FROM benchmark i JOIN embeddings v ON v.vec_id IN (i.item_id, i.item_id + 40)),
ps AS (SELECT item_id, path, page, round(sum({_DOT.format("tk.e", "pg.e")}), 6) AS score FROM tk, pg GROUP BY ALL),
pr AS (SELECT ps.*, k, row_number() OVER (PARTITION BY ps.item_id ORDER BY score DESC, path, page) AS rank FROM ps JOIN qs USING (item_id)),
bp AS (SELECT item_id, path, arg_min(page, rank) AS page, min(rank) AS best FROM pr WHERE rank <= 2 * k GROUP BY item_id, path),
vl AS (SELECT item_id, path, page, row_number() OVER (PARTITION BY item_id ORDER BY best) AS rank FROM bp),
al AS (SELECT il.item_id, 0 AS l, il.rank, path, chunk_index, text AS shown FROM il JOIN pt USING (vec_id) WHERE il.rank <= 2 * k UNION ALL SELECT item_id, 1, rank, path, NULL, '(visual match — page ' || page || ')' FROM vl),
fu AS (SELECT item_id, path, chunk_index, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score, CASE WHEN count(DISTINCT l) > 1 THEN 'both' WHEN max(l) = 0 THEN 'summary' ELSE 'fast' END AS tier, min(l * 1000000 + rank) AS place, arg_min(shown, l) AS shown FROM al GROUP BY ALL),
fr AS (SELECT fu.*, k, row_number() OVER (PARTITION BY fu.item_id ORDER BY score DESC, place, path) AS rank FROM fu JOIN qs USING (item_id)),
hits AS (SELECT item_id AS question_id, path, chunk_index, score, tier, CAST(rank AS INTEGER) AS rank, shown FROM fr WHERE rank <= k)
"""


@query(_HYBRID + "SELECT question_id, path, chunk_index, score, tier, rank FROM hits")
def hybrid_search(spark, sf_dir):
    """Dense, sparse and visual hits of every question, fused twice; questions that ask for everything get more."""
    return _hybrid(spark, sf_dir).select("question_id", "path", "chunk_index", "score", "tier", "rank")


@query(_HYBRID + "SELECT question_id, tier, count(*) AS hits, count(DISTINCT path) AS files FROM hits GROUP BY question_id, tier")
def tier_breakdown(spark, sf_dir):
    """Hits of each question by tier."""
    return _hybrid(spark, sf_dir).groupBy("question_id", "tier").agg(F.count("*").alias("hits"), F.count_distinct("path").alias("files"))


@query(_HYBRID + "SELECT question_id, path, min(rank) AS rank, coalesce(array_to_string(list_sort(list_distinct(list(chunk_index) FILTER (chunk_index IS NOT NULL))), ','), '') AS hit_rows FROM hits GROUP BY question_id, path")
def rows_by_file(spark, sf_dir):
    """The files of each question in the order of their first hit, with their hit rows."""
    return hybrid.rows_of_hits(_hybrid(spark, sf_dir)).select("question_id", "path", "rank", F.array_join("rows", ",").alias("hit_rows"))


@query(_BM25 + """, h AS (SELECT r.item_id, min(r.rank) FILTER (contains(d.text, b.text)) AS best FROM r JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 20 GROUP BY r.item_id)
SELECT count(*) AS n, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mean_reciprocal_rank, count(*) FILTER (best <= 1) AS hits_at_1, round(count(*) FILTER (best <= 1) / count(*)::DOUBLE, 6) AS recall_at_1, count(*) FILTER (best <= 5) AS hits_at_5, round(count(*) FILTER (best <= 5) / count(*)::DOUBLE, 6) AS recall_at_5,
 count(*) FILTER (best <= 20) AS hits_at_20, round(count(*) FILTER (best <= 20) / count(*)::DOUBLE, 6) AS recall_at_20 FROM benchmark LEFT JOIN h USING (item_id)""")
def retrieval_recall(spark, sf_dir):
    """Recall of sparse search at 1, 5 and 20: of the documents that hold an item word for word, its first rank."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = search.bm25(docs, items, "doc_id", "item_id", 20)
    held = found.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("item")), "item_id").where(F.contains("text", "item")).groupBy("item_id").agg(F.min("rank").alias("hit_rank"))
    return evaluation.recall_at(items.select("item_id").join(held, "item_id", "left"), 1, 5, 20)


@query(_BM25 + """, ans AS (SELECT b.item_id, ['easy', 'medium', 'hard'][b.item_id % 3 + 1] AS difficulty, b.item_id % 7 <> 0 AS ok, coalesce(list(r.doc_id) FILTER (rank <= 2), []) AS used0, coalesce(list(r.doc_id) FILTER (rank <= 1 OR rank = 3), []) AS expected, coalesce(list(r.doc_id) FILTER (rank = 2), []) AS bad FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND rank <= 3 GROUP BY b.item_id),
scored AS (SELECT difficulty, ok, CASE WHEN ok THEN used0 ELSE [] END AS used, expected, bad FROM ans)
SELECT difficulty, count(*) AS n, count(*) FILTER (ok) AS succeeded, count(*) FILTER (ok AND len(list_intersect(expected, used)) = len(expected)) AS perfect, count(*) FILTER (ok AND len(list_intersect(used, bad)) = 0) AS undistracted, CAST(sum(len(list_intersect(used, bad))) AS BIGINT) AS distractors_cited,
 round(sum(len(list_intersect(expected, used))) / sum(len(expected))::DOUBLE, 6) AS recall, round(sum(len(list_intersect(expected, used))) / nullif(sum(len(used)), 0)::DOUBLE, 6) AS precision FROM scored GROUP BY ROLLUP (difficulty)""")
def eval_difficulty(spark, sf_dir):
    """Scores of answers by difficulty: the first two hits are cited, the first and third expected, the second a distractor."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = search.bm25(docs, items, "doc_id", "item_id", 3)
    got = hits.groupBy("item_id").agg(*(F.collect_list(F.when(F.col("rank").isin(*r), F.col("doc_id"))).alias(n) for n, r in (("used", (1, 2)), ("expected", (1, 3)), ("distractors", (2,)))))
    none = F.array().cast("array<bigint>")
    level = F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (F.col("item_id") % 3).cast("int") + 1)
    told = items.select("item_id").join(got, "item_id", "left").select(level.alias("difficulty"), (F.col("item_id") % 7 != 0).alias("ok"), *(F.coalesce(c, none).alias(c) for c in ("expected", "used", "distractors")))
    return evaluation.by_difficulty(told)


# ---- rows as text: each user's events are a table, errors are hits


def event_rows(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    head = ("event_id", "event_type", "props")
    w = Window.partitionBy("user_id").orderBy("event_id")
    fields = F.create_map(*(x for c in head for x in (F.lit(c), F.col(c).cast("string"))))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), (F.row_number().over(w) - 1).cast("bigint").alias("row_idx"), F.array(*map(F.lit, head)).alias("headers"), fields.alias("fields"), "event_type")


_ROWS = """e AS (SELECT CAST(user_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, event_type, event_id || ',' || event_type || ',"' || replace(props, '"', '""') || '"' AS line, 'event_id: ' || event_id || ' | event_type: ' || event_type || ' | props: ' || props AS told FROM events)"""


@query(f"""WITH {_ROWS}, s AS (SELECT path, i, greatest(0, i - 2) AS b, least(n, i + 3) AS z FROM e WHERE event_type = 'error'),
m AS (SELECT *, CASE WHEN b <= max(z) OVER (PARTITION BY path ORDER BY b, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY b, z ROWS UNBOUNDED PRECEDING) AS island FROM m),
w AS (SELECT path, island, min(b) AS b, max(z) AS z FROM g GROUP BY path, island),
p AS (SELECT w.path, w.b, string_agg(e.line || CASE WHEN e.event_type = 'error' THEN '   (this row matched the question)' ELSE '' END, chr(10) ORDER BY e.i) AS part FROM w JOIN e ON e.path = w.path AND e.i >= w.b AND e.i < w.z GROUP BY w.path, w.b)
SELECT path, string_agg('event_id,event_type,props' || chr(10) || part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY b) AS block FROM p GROUP BY path""")
def row_window_block(spark, sf_dir):
    """Each table's hit rows and those around them, as quoted lines under the header, windows apart."""
    found = event_rows(spark, sf_dir)
    return rows.window_blocks(found, found.where("event_type = 'error'").select("path", "row_idx"))


@query(f"WITH {_ROWS} SELECT path, 'event_id,event_type,props' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS block FROM e WHERE i < 5 GROUP BY path")
def sample_block(spark, sf_dir):
    """Each table's first five rows under the header."""
    return rows.sample_blocks(event_rows(spark, sf_dir))


@query(f"""WITH {_ROWS}, h AS (SELECT path, i FROM e WHERE event_type = 'error') SELECT h.path, h.i AS row_idx, string_agg('[row ' || e.i || CASE WHEN e.i = h.i THEN ' (match)] ' ELSE '] ' END || e.told, chr(10) ORDER BY e.i) AS snippet FROM h JOIN e ON e.path = h.path AND e.i BETWEEN h.i - 2 AND h.i + 2 GROUP BY h.path, h.i""")
def expanded_hits(spark, sf_dir):
    """Each hit row with its neighbours, numbered and marked."""
    found = event_rows(spark, sf_dir)
    return rows.expanded_hits(found, found.where("event_type = 'error'").select("path", "row_idx"))


@query(f"WITH {_ROWS} SELECT path, i AS row_idx, line, n >= 10 AS truncated FROM e WHERE i < 10")
def table_preview(spark, sf_dir):
    """Each table's first ten rows, and whether there may be more."""
    return rows.preview(event_rows(spark, sf_dir), 10)


# ---- answers


@query("""WITH a AS (SELECT doc_id AS question_id, unnest(['/' || source || '/a%20b ' || doc_id || '.txt', ' /' || source || '/a  b ' || doc_id || '.txt  [pages 1-2]', '/nowhere', '/' || source || '/c' || doc_id]) AS cited, generate_subscripts([1, 2, 3, 4], 1) AS pos FROM documents),
g AS (SELECT doc_id AS question_id, unnest(['/' || source || '/a b ' || doc_id || '.txt', '/' || source || '/c' || doc_id]) AS path FROM documents),
t AS (SELECT a.question_id, pos, cited, path FROM a LEFT JOIN g ON g.question_id = a.question_id AND g.path = trim(regexp_replace(regexp_replace(url_decode(cited), '\\s*\\[[^\\]]*\\]\\s*$', ''), '\\s+', ' ', 'g')))
SELECT question_id, array_to_string(list(path ORDER BY pos) FILTER (path IS NOT NULL), ';') AS sources, array_to_string(list(cited ORDER BY pos) FILTER (path IS NULL), ';') AS dropped FROM t GROUP BY question_id""".replace("\\\\", "\\"))
def citation_semi(spark, sf_dir):
    """Cited files that a question was given, however loosely they are written, and those that are made up."""
    docs = table(spark, sf_dir, "documents")
    key, head = F.col("doc_id").cast("string"), F.concat(F.lit("/"), "source", F.lit("/"))
    cited = F.array(F.concat(head, F.lit("a%20b "), key, F.lit(".txt")), F.concat(F.lit(" "), head, F.lit("a  b "), key, F.lit(".txt  [pages 1-2]")), F.lit("/nowhere"), F.concat(head, F.lit("c"), key))
    answers = docs.select(F.col("doc_id").alias("question_id"), F.lit(False).alias("not_found"), cited.alias("sources_used"))
    given = docs.select(F.col("doc_id").alias("question_id"), F.explode(F.array(F.concat(head, F.lit("a b "), key, F.lit(".txt")), F.concat(head, F.lit("c"), key))).alias("path"))
    return answering.kept_sources(answers, given).select("question_id", F.array_join("sources", ";").alias("sources"), F.array_join("dropped", ";").alias("dropped"))


@query("""WITH t AS (SELECT doc_id, 'On 2024-05-14 and 5/14/24, ' || doc_id || ' paid $12.50 at 8:30 AM for CSC ' || (100 + doc_id % 900) || ', said "' || source || ' ok". May 4, 2026. ' || text AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(flatten([""" + ", ".join(f"regexp_extract_all(t, '{p}')" for p in answering.HIGHLIGHTS) + """]), lambda x: trim(x)))), ';') AS tokens FROM t""")
def highlights(spark, sf_dir):
    """What is worth a highlight in an answer; texts are told beginnings that hold some."""
    key = F.col("doc_id")
    said = F.concat(F.lit("On 2024-05-14 and 5/14/24, "), key.cast("string"), F.lit(" paid $12.50 at 8:30 AM for CSC "), (100 + key % 900).cast("string"), F.lit(', said "'), "source", F.lit(' ok". May 4, 2026. '), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(answering.highlights(said)), ";").alias("tokens"))


@query("""SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'image' WHEN page_id % 6 = 1 THEN 'pdf' WHEN page_id % 6 = 2 THEN 'csv' WHEN page_id % 6 = 3 THEN 'text' ELSE 'unsupported' END AS kind FROM pages""")
def preview_kind(spark, sf_dir):
    """How a file is shown."""
    ext = F.element_at(F.array(*map(F.lit, (".PNG", ".pdf", ".csv", ".yaml", ".zip", ""))), (F.col("page_id") % 6).cast("int") + 1)
    return table(spark, sf_dir, "pages").select("page_id", answering.preview_kind(F.concat(F.lit("/a/b"), ext)).alias("kind"))


@query("""WITH p AS (SELECT conv_id, string_agg('--- File ' || turn || ': /c/' || conv_id || '/' || turn || ' ---' || chr(10) || text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, 'asked ' || conv_id AS question FROM p) SELECT l.conv_id, question, count(*) AS files, CAST(sum(length(trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13)))) AS BIGINT) AS chars FROM l JOIN conversations c ON c.conv_id = l.conv_id GROUP BY ALL""")
def prompt_parts(spark, sf_dir):
    """Prompts read back: conversations are prompts whose turns are files."""
    head = F.concat(F.lit("--- File "), F.col("turn").cast("string"), F.lit(": /c/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(" ---\n"), "text")
    told = F.transform(F.array_sort(F.collect_list(F.struct("turn", head.alias("t")))), lambda x: x["t"])
    prompt = F.concat(F.lit("Question: asked "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(told, "\n"))
    parts = answering.prompt_parts(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(prompt.alias("prompt")).withColumnRenamed("conv_id", "question_id"))
    chars = F.aggregate("files", F.lit(0).cast("bigint"), lambda s, f: s + F.length(f["text"]))
    return parts.select(F.col("question_id").alias("conv_id"), "question", F.size("files").cast("bigint").alias("files"), chars.alias("chars"))


# ---- settings, folders, logs


@query("""WITH d AS (SELECT 'k' || c_custkey AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer), u AS (SELECT 'k' || o_custkey AS key, max(o_orderstatus) AS value FROM orders GROUP BY 1), e AS (SELECT 'k' || s_suppkey AS key, 'env' AS value FROM supplier)
SELECT key, coalesce(e.value, u.value, d.value) AS value, CASE WHEN e.key IS NOT NULL THEN 0 WHEN u.key IS NOT NULL THEN 1 ELSE 2 END AS layer FROM d FULL JOIN u USING (key) FULL JOIN e USING (key)""")
def settings_overlay(spark, sf_dir):
    """Settings of the environment over the user's over the defaults."""
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias("key")
    env = table(spark, sf_dir, "supplier").select(key("s_suppkey"), F.lit("env").alias("value"))
    user = table(spark, sf_dir, "orders").groupBy(key("o_custkey")).agg(F.max("o_orderstatus").alias("value"))
    return state.overlay(env, user, table(spark, sf_dir, "customer").select(key("c_custkey"), F.col("c_nationkey").cast("string").alias("value")))


@query("""SELECT 'k' || c_custkey AS key, coalesce(o.value, CAST(c_nationkey AS VARCHAR)) AS value FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS value FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def settings_patch(spark, sf_dir):
    """A patch of settings: keys that are not known are left out."""
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias("key")
    return state.patched(table(spark, sf_dir, "customer").select(key("c_custkey"), F.col("c_nationkey").cast("string").alias("value")), table(spark, sf_dir, "orders").select(key("o_custkey"), F.col("o_orderstatus").alias("value")))


_IMAGES, _DOCUMENTS = (".png", ".jpg"), (".pdf", ".docx")


@query("""WITH x AS (SELECT doc_id, source || '/' || doc_id % 4 AS parent, CASE WHEN doc_id % 4 = 3 AND doc_id % 16 = 3 THEN '.pdf' WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.png' END AS ext FROM documents),
l AS (SELECT parent FROM x GROUP BY parent HAVING count(*) FILTER (ext IN ('.png', '.jpg')) >= 15 AND count(*) FILTER (ext IN ('.pdf', '.docx')) = 0) SELECT doc_id FROM x WHERE NOT (ext IN ('.png', '.jpg') AND parent IN (FROM l))""")
def asset_folders(spark, sf_dir):
    """Files without the images of folders that hold fifteen or more and no document."""
    k = F.col("doc_id")
    ext = F.when((k % 4 == 3) & (k % 16 == 3), ".pdf").when(k % 3 == 0, ".txt").otherwise(".png")
    found = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), (k % 4).cast("string")).alias("parent"), ext.alias("ext"))
    return state.without_assets(found, _IMAGES, _DOCUMENTS).select("doc_id")


@query("""WITH l AS (SELECT event_id // 3 AS request_id, event_id % 3 = 0 AS asked, ts, event_type FROM events), a AS (SELECT request_id, arg_min(event_type, ts) FILTER (asked) AS request, min(ts) FILTER (asked) AS t0, arg_min(event_type, ts) FILTER (NOT asked) AS response, min(ts) FILTER (NOT asked) AS t1 FROM l GROUP BY request_id)
SELECT request_id, request, response, round(epoch(t1) - epoch(t0), 3) AS seconds FROM a WHERE t0 IS NOT NULL""")
def log_join(spark, sf_dir):
    """Requests with their first response, by request: each three events are one exchange."""
    k = F.col("event_id")
    log = table(spark, sf_dir, "events").select(F.expr("event_id div 3").alias("request_id"), F.when(k % 3 == 0, "request").otherwise("response").alias("kind"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("body"))
    return state.exchanges(log, "event_id").withColumn("seconds", F.round("seconds", 3))


@query("""WITH c AS (SELECT user_id, max(event_id) AS n FROM events WHERE event_type = 'error' GROUP BY user_id),
e AS (SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id DESC) AS place FROM events e LEFT JOIN c USING (user_id) WHERE e.event_type <> 'error' AND (c.n IS NULL OR e.event_id > c.n))
SELECT CAST(u.user_id AS VARCHAR) AS user, count(e.event_id) AS entries, coalesce(string_agg(CAST(e.event_id AS VARCHAR), ' ' ORDER BY place), '') AS numbers
FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) u LEFT JOIN (SELECT * FROM e WHERE place <= 10) e USING (user_id) GROUP BY u.user_id""")
def recents_log(spark, sf_dir):
    """Each user's ten newest entries after the last clearing, from the log: errors clear, other events are entries."""
    action = F.when(F.col("event_type") == "error", "clear").otherwise("add")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("n"), action.alias("action"), F.col("event_type").alias("entry"))
    return state.recents(log).select("user", F.size("entries").cast("bigint").alias("entries"), F.array_join(F.col("numbers").cast("array<string>"), " ").alias("numbers"))


@query("""WITH i AS (SELECT max(ts) AS t FROM events WHERE event_type = 'purchase'), a AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts END AS asked FROM events) SELECT event_id, coalesce(asked < t, false) AS is_stale FROM a, i""")
def staleness(spark, sf_dir):
    """Answers asked before the index changed; a time that cannot be read counts as fresh."""
    events = table(spark, sf_dir, "events")
    built = F.broadcast(events.where("event_type = 'purchase'").agg(F.max("ts").alias("built")))  # one row
    asked = F.when(F.col("event_id") % 10 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    return state.stale(events.withColumn("asked_at", asked).crossJoin(built), F.col("built")).select("event_id", "is_stale")


@query("""SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS INTEGER) AS place FROM documents QUALIFY place <= 50""")
def seeded_sample(spark, sf_dir):
    """Fifty documents in an order that a seed decides."""
    from pyspark.sql import Window

    found = evaluation.shuffled(table(spark, sf_dir, "documents"), "doc_id", 50, 42)
    return found.select("doc_id", F.row_number().over(Window.orderBy(evaluation.seeded(F.col("doc_id"), 42), "doc_id")).alias("place"))  # fifty rows
