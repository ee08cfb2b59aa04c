"""Queries over the index gate, prompts and best hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import answers
from gleaner.operators import gate
from gleaner.plans.registry import query, table

RULES = gate.Rules(
    roots=(gate.Root("/c", exclude=("tmp/*7.txt",)), gate.Root("/c/tmp", include=("/*9.*",), max_mb=0.001)),
    files=("/c/101.log",), excluded=("/c/old",), exclude=("**/draft*", "!draft3*"), dirs=("cache",), extensions=(".log",),
    categories=((".csv", "data"), (".md", "text"), (".txt", "text")), off=frozenset({"data"}), max_mb=0.01,
)
KINDS = ((".keep", True), (".ignore", False))
LINES = (("/c", ".ignore", 0, "*3.md"), ("/c", ".ignore", 1, "!13.md"), ("/c/tmp", ".keep", 0, "*3.md"))

_FILES = """SELECT doc_id, '/c/' || CASE WHEN doc_id % 4 = 0 THEN 'tmp/' WHEN doc_id % 9 = 0 THEN 'old/' WHEN doc_id % 10 = 0 THEN 'a/cache/' ELSE '' END
 || CASE WHEN doc_id % 11 = 0 THEN '.' WHEN doc_id % 13 = 0 THEN 'draft' ELSE '' END || doc_id || CASE doc_id % 5 WHEN 1 THEN '.log' WHEN 2 THEN '.csv' WHEN 3 THEN '.md' ELSE '.txt' END AS path, n_chars AS size FROM documents"""
_GATE = rf"""WITH f AS ({_FILES}), g AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, path LIKE '/c/tmp/%' AS tmp FROM f),
v AS (SELECT doc_id, size, CASE WHEN path = '/c/101.log' THEN 'explicitly included file: /c/101.log' WHEN path LIKE '/c/old/%' THEN 'explicitly excluded: /c/old'
 WHEN tmp AND regexp_matches(name, '9\.') THEN 'folder rule include in /c/tmp'
 WHEN name LIKE 'draft%' AND name NOT LIKE 'draft3%' THEN 'global exclude pattern' WHEN path LIKE '%/cache/%' THEN 'default exclude: dir ''cache'''
 WHEN name LIKE '%.log' THEN 'default exclude: extension ''.log'''
 WHEN tmp AND name LIKE '%3.md' THEN 'included by .keep in /c/tmp' WHEN name LIKE '%3.md' AND name <> '13.md' THEN 'excluded by .ignore in /c'
 WHEN name LIKE '.%' THEN 'hidden file' WHEN name LIKE '%.csv' THEN 'category disabled: data'
 WHEN size > CASE WHEN tmp THEN 0.001 ELSE 0.01 END * 1024 * 1024 THEN 'exceeds max file size' ELSE 'ok' END AS reason FROM g)"""


def _gated(spark, sf_dir):
    key = F.col("doc_id")
    when = lambda pairs, rest: F.coalesce(*(F.when(key % m == r, x) for m, r, x in pairs), F.lit(rest))
    path = F.concat(
        F.lit("/c/"), when(((4, 0, "tmp/"), (9, 0, "old/"), (10, 0, "a/cache/")), ""), when(((11, 0, "."), (13, 0, "draft")), ""), key.cast("string"), when(((5, 1, ".log"), (5, 2, ".csv"), (5, 3, ".md")), ".txt")
    )
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("n_chars").alias("size"))
    return gate.gated(files, RULES, spark.createDataFrame(LINES, "dir string, kind string, pos int, line string"), KINDS)


@query(_GATE + "SELECT doc_id, reason, reason = 'ok' OR reason LIKE 'explicitly included%' OR reason LIKE 'folder rule include%' OR reason LIKE 'included by %' AS allowed FROM v")
def index_gate(spark, sf_dir):
    """Which files enter the index, and why."""
    return _gated(spark, sf_dir).select("doc_id", "reason", "allowed")


@query(_GATE + "SELECT reason, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM v GROUP BY reason")
def gate_tally(spark, sf_dir):
    """How many files, and how much, each reason holds."""
    return _gated(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '\b([A-Z]{2,3})\s*\(', 1) AS b, regexp_extract_all(text, '\(([A-Z]{2,3})\)', 1) AS w FROM documents),
c AS (SELECT doc_id, CASE WHEN len(b) > 0 THEN b ELSE w END AS c FROM m)
SELECT doc_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ',') AS codes FROM c""")
def category_codes(spark, sf_dir):
    """Codes before brackets, else within them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(answers.category_codes(F.col("text")), ",").alias("codes"))


@query("""SELECT p_partkey, concat_ws(' ', nullif(p_name, ''), nullif(p_brand, ''), p_type || ', ' || p_size) AS text FROM part""")
def embedding_text(spark, sf_dir):
    """What is embedded of an entry: title, summary, lists."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", answers.embedding_text(F.col("p_name"), F.col("p_brand"), F.array("p_type", F.col("p_size").cast("string"))).alias("text"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT doc_id, line, regexp_matches(line, '^[A-Z][a-z]') AS is_head, count(*) FILTER (regexp_matches(line, '^[A-Z][a-z]')) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
SELECT doc_id, section, max(CASE WHEN is_head THEN line END) AS head, count(*) AS n_lines FROM s GROUP BY doc_id, section""")
def text_sections(spark, sf_dir):
    """Texts cut at lines that look like headers."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return answers.sections(lines, "doc_id", "pos", "line", "^[A-Z][a-z]")


@query("SELECT source, max(n_chars) AS n_chars, arg_min(doc_id, (-n_chars, doc_id)) AS doc_id FROM documents GROUP BY source")
def best_page(spark, sf_dir):
    """The best page of each file, the earliest among equals; folders stand for files, lengths for scores."""
    return answers.best_per_key(table(spark, sf_dir, "documents"), "source", "n_chars", "doc_id")


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (n_chars > 5000) AS n_long, round(avg(n_chars), 4) AS mean FROM documents GROUP BY lang")
def disk_usage(spark, sf_dir):
    """Sums, counts and averages of sizes."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.count_if(n > 5000).alias("n_long"), F.round(F.avg(n), 4).alias("mean"))
