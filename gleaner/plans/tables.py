"""Queries over the index's own tables: rows as text, rollups, matching of paths, joins, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import offerings, state
from gleaner.plans.registry import query, table


@query("SELECT o_orderkey, concat_ws(' | ', 'o_orderkey: ' || o_orderkey, 'o_custkey: ' || o_custkey, 'o_orderstatus: ' || nullif(o_orderstatus, '')) AS row_text FROM orders")
def row_text(spark, sf_dir):
    """Rows as text, without empty fields."""
    cell = lambda c: F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" | ", *map(cell, ("o_orderkey", "o_custkey", "o_orderstatus"))).alias("row_text"))


@query("""SELECT n_nationkey AS folder, count(o_orderkey) AS files, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS size, max(o_orderdate) AS latest FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey""")
def folder_stats(spark, sf_dir):
    """Files, their sizes and the latest time of each folder; empty folders have zeros."""
    files = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    told = files.groupBy(F.col("c_nationkey").alias("folder")).agg(F.count("*").alias("files"), F.sum("o_orderkey").alias("size"), F.max("o_orderdate").alias("latest"))
    roots = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("folder"))
    return roots.join(told, "folder", "left").select("folder", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("size", F.lit(0)).alias("size"), "latest")


@query("""SELECT coalesce(source, 'total') AS folder, count(*) AS files, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS remaining FROM documents GROUP BY ROLLUP (source)""")
def index_plan(spark, sf_dir):
    """Files of each folder, those not yet indexed, and the totals."""
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("done")).distinct()
    docs = table(spark, sf_dir, "documents").join(done, F.col("doc_id") == F.col("done"), "left")
    return docs.rollup("source").agg(F.count("*").alias("files"), F.count_if(F.col("done").isNull()).alias("remaining")).select(F.coalesce("source", F.lit("total")).alias("folder"), "files", "remaining")


@query("""SELECT count(*) AS files, count(*) FILTER (n_chars >= 2000) AS long_files, count(DISTINCT source) AS folders, CAST(sum(n_chars) AS BIGINT) AS size, round(avg(n_chars), 6) AS mean_size FROM documents""")
def manifest_stats(spark, sf_dir):
    """Totals of the manifest."""
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("files"), F.count_if(F.col("n_chars") >= 2000).alias("long_files"), F.count_distinct("source").alias("folders"), F.sum("n_chars").alias("size"), F.round(F.avg("n_chars"), 6).alias("mean_size"))


@query("""SELECT array_to_string(list_slice(string_split(url, '/'), 1, 4), '/') AS prefix, count(*) AS n FROM pages GROUP BY 1""")
def path_depth_counts(spark, sf_dir):
    """Files by the first parts of their path; shorter paths whole."""
    return table(spark, sf_dir, "pages").groupBy(F.array_join(F.slice(F.split("url", "/"), 1, 4), "/").alias("prefix")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS place FROM c)
SELECT source, n, round(sum(n) OVER (ORDER BY place) / (SELECT sum(n) FROM c)::DOUBLE, 6) AS cumulative_share FROM r WHERE place <= 50""")
def page_share(spark, sf_dir):
    """The largest folders and the share of all files that they hold together."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "source").limit(50)  # fifty rows from here on
    run = Window.orderBy(F.desc("n"), "source").rowsBetween(Window.unboundedPreceding, 0)
    return top.crossJoin(F.broadcast(total)).select("source", "n", F.round(F.sum("n").over(run) / F.col("total"), 6).alias("cumulative_share"))


_ROOTS = ("http://", "https://", "https://www.", "https://blog.")


@query("WITH r AS (SELECT unnest(['" + "','".join(_ROOTS) + "']) AS root) SELECT page_id, arg_max(root, length(root)) AS root FROM pages LEFT JOIN r ON starts_with(url, root) GROUP BY page_id")
def prefix_root_match(spark, sf_dir):
    """The most specific configured root of each path."""
    roots = F.array(*map(F.lit, sorted(_ROOTS, key=len, reverse=True)))  # configuration, a few
    return table(spark, sf_dir, "pages").select("page_id", F.get(F.filter(roots, lambda r: F.startswith(F.col("url"), r)), F.lit(0)).alias("root"))


_RULES = {"http:": "deny", "https:": "allow", "http:/": "allow"}


@query("""WITH p AS (SELECT page_id, string_split(split_part(url, '?', 1), '/') AS parts FROM pages), a AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS depth, parts FROM p),
b AS (SELECT page_id, depth, array_to_string(list_slice(parts, 1, depth), '/') AS dir FROM a), r(dir, verdict) AS (VALUES ('http:', 'deny'), ('https:', 'allow'), ('http:/', 'allow'))
SELECT page_id, arg_max(verdict, depth) AS verdict FROM b JOIN r USING (dir) GROUP BY page_id""")
def ancestor_rule(spark, sf_dir):
    """The verdict of the deepest ancestor that has a rule."""
    parts = F.split(F.split_part(F.col("url"), F.lit("?"), F.lit(1)), "/")
    above = table(spark, sf_dir, "pages").select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("dir")))).alias("a")).select("page_id", "a.depth", "a.dir")
    rules = spark.createDataFrame(list(_RULES.items()), "dir string, verdict string")
    return above.join(rules, "dir").groupBy("page_id").agg(F.max_by("verdict", "depth").alias("verdict"))


@query("SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'not offered') AS offering FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def enrich_left(spark, sf_dir):
    """Rows with what is known of them, or a note that nothing is."""
    offered = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("code"), F.col("quality").cast("string").alias("offering"))
    return offerings.enriched(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("code")), offered, "offering").drop("code")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def enrich_orphans(spark, sf_dir):
    """What nothing refers to."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS place FROM conversations)
SELECT role, conv_id, turn, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""")
def recents_ring(spark, sf_dir):
    """The ten newest entries."""
    rows = table(spark, sf_dir, "conversations").withColumn("at", F.struct("conv_id", "turn"))
    return state.latest(rows, ["role"], "at", 10).select("role", "conv_id", "turn", "place")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type""")
def outcome_tally(spark, sf_dir):
    """Counts by outcome."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^:/?#]*)', 1) IN ('localhost', '127.0.0.1', '::1') AS is_local FROM pages""")
def loopback_urls(spark, sf_dir):
    """Which addresses are this machine's own."""
    return table(spark, sf_dir, "pages").select("page_id", T.loopback(F.col("url")).alias("is_local"))


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) SELECT doc_id, lines[1] AS first_line, lines[(len(lines) // 2) + 1] AS middle_line, lines[len(lines)] AS last_line FROM p""")
def three_point_sample(spark, sf_dir):
    """The first, the middle and the last line of a text."""
    lines = F.split("text", "\n")
    at = lambda i: F.element_at(lines, i)
    return table(spark, sf_dir, "documents").select("doc_id", at(F.lit(1)).alias("first_line"), at((F.size(lines) / 2).cast("int") + 1).alias("middle_line"), at(F.lit(-1)).alias("last_line"))
