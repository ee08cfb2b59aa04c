"""Queries over routing and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import routing
from gleaner.functions import text as T
from gleaner.plans import corpus  # noqa: F401  its SQL is read below
from gleaner.plans.registry import ORACLE_SQL, query, table


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.docx' ELSE '.txt' END AS ext, n_chars // 10 AS density, doc_id % 3 <> 0 AS extractable,
 (doc_id % 10) / 10.0::DOUBLE AS ratio, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 2000 END AS w, CASE WHEN doc_id % 7 <> 0 THEN n_chars % 1500 END AS h FROM documents)
SELECT doc_id, CAST(least(10, CASE WHEN ext = '.pdf' THEN CASE WHEN density < 50 THEN 5 WHEN density < 500 THEN 2 ELSE 0 END + CASE WHEN extractable THEN 0 ELSE 3 END
 WHEN ext = '.docx' AND ratio > 0.3 THEN 2
 WHEN ext = '.png' AND w IS NOT NULL AND h IS NOT NULL THEN CASE WHEN w >= 600 AND h >= 600 THEN 4 ELSE 0 END + CASE WHEN h <> 0 AND (w / h < 0.65 OR w / h > 1.6) THEN 1 ELSE 0 END ELSE 0 END) AS INTEGER) AS score FROM f""")
def visual_score(spark, sf_dir):
    """How much a file needs to be seen."""
    key, n = F.col("doc_id"), F.col("n_chars")
    ext = F.when(key % 4 == 0, ".pdf").when(key % 4 == 1, ".png").when(key % 4 == 2, ".docx").otherwise(".txt")
    known = lambda c: F.when(key % 7 != 0, c)
    score = routing.visual_score(ext, F.floor(n / 10), key % 3 != 0, (key % 10) / F.lit(10.0), known(key % 2000), known(n % 1500))
    return table(spark, sf_dir, "documents").select("doc_id", score.cast("int").alias("score"))


@query(f"""WITH s AS ({ORACLE_SQL["sensitivity_score"]}), w AS (SELECT *, doc_id % 4 AS k FROM s)
SELECT doc_id, CASE WHEN k = 0 OR score >= 4 THEN 'critical' WHEN k = 1 THEN 'casual' ELSE 'normal' END AS level,
 CASE WHEN k = 0 THEN 'user' WHEN score >= 4 THEN 'auto' WHEN k IN (1, 2) THEN 'user' ELSE 'default' END AS origin FROM w""")
def criticality(spark, sf_dir):
    """How much accuracy a file needs, and who says so."""
    k = F.col("doc_id") % 4
    wish = F.when(k == 0, "Critical").when(k == 1, "casual").when(k == 2, "normal")
    found = table(spark, sf_dir, "documents").select("doc_id", routing.criticality(T.sensitivity(F.col("text")), wish).alias("c"))
    return found.select("doc_id", "c.level", "c.origin")


@query(r"""WITH l AS (SELECT page_id, string_split(CAST(page_id AS VARCHAR) || chr(10) || html, chr(10)) AS l FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, string_split(html || chr(10) || ' xii ', chr(10)) FROM pages WHERE page_id % 2 = 1)
SELECT page_id, list_filter(list_transform(list_concat(l[1:3], list_reverse(l[greatest(1, len(l) - 2):len(l)])), lambda x: regexp_extract(x, '^[ \t\r\f]*([0-9]{1,4}|[IVXLCDM]+|[ivxlcdm]+)[ \t\r\f]*$', 1)), lambda x: x <> '')[1] AS label FROM l""")
def page_label(spark, sf_dir):
    """Printed page numbers; pages get one at their head or their foot."""
    key, html = F.col("page_id"), F.col("html")
    text = F.when(key % 2 == 0, F.concat(key.cast("string"), F.lit("\n"), html)).otherwise(F.concat(html, F.lit("\n xii ")))
    return table(spark, sf_dir, "pages").select("page_id", routing.page_label(text).alias("label"))


@query("""WITH e AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'FileNotFoundError' WHEN 2 THEN 'LlamaServerBinaryError' WHEN 3 THEN 'LlamaServerCrashError' ELSE 'ValueError' END AS name, lower(coalesce(text, '')) AS t FROM conversations),
s AS (SELECT conv_id, turn, CASE WHEN name = 'LlamaServerBinaryError' THEN 'not set up' WHEN name = 'LlamaServerCrashError' THEN 'not started' WHEN t LIKE '%429%' OR t LIKE '%rate%' OR t LIKE '%quota%' THEN 'busy' WHEN t LIKE '%401%' OR t LIKE '%403%' OR t LIKE '%unauthor%' OR t LIKE '%api key%' THEN 'account'
 WHEN name = 'TimeoutError' OR t LIKE '%connection%' THEN 'network' WHEN name = 'FileNotFoundError' OR t LIKE '%no such file%' THEN 'missing' WHEN t LIKE '%qdrant%' OR t LIKE '%collection%' THEN 'starting' ELSE 'unknown' END AS kind FROM e)
SELECT conv_id, turn, kind, CASE kind WHEN 'account' THEN 401 WHEN 'missing' THEN 404 WHEN 'unknown' THEN 500 ELSE 503 END AS status FROM s""")
def failure_kind(spark, sf_dir):
    """What kind of failure a logged message tells of."""
    k = F.col("conv_id") % 5
    name = F.when(k == 0, "TimeoutError").when(k == 1, "FileNotFoundError").when(k == 2, "LlamaServerBinaryError").when(k == 3, "LlamaServerCrashError").otherwise("ValueError")
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.failure(name, F.col("text")).alias("f"))
    return found.select("conv_id", "turn", "f.kind", "f.status")
