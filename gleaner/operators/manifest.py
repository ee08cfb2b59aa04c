"""The manifest as a table: what each mark changes, what still needs work, and how it is kept in line with the files.

A mark is a table of events (path, the new values, and `at`); of several for one path the newest counts. Every function
gives a new manifest, which the caller writes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = (
    "path string, size bigint, summary_file string, summarized_at timestamp, ingested_at timestamp, row_count bigint, fast_indexed_at timestamp, fast_pages bigint, mtime double, "
    "routes array<string>, visual_score int, sensitivity_score int, cost_mb double, cost_s double, level string, origin string, skip_reason string, content_hash string"
)
#: What a new row holds where its mark says nothing.
DEFAULTS = {"size": "0L", "routes": "cast(array() as array<string>)", "visual_score": "0", "sensitivity_score": "0", "cost_mb": "0D", "cost_s": "0D", "level": "'normal'", "origin": "'default'"}


@dataclass(frozen=True)
class Mark:
    """sets: columns taken from the event; stamps: set to its time; clears: set to null; creates: rows for unknown paths."""

    sets: tuple[str, ...] = ()
    stamps: tuple[str, ...] = ()
    clears: tuple[str, ...] = ()
    creates: bool = True


ROUTED = ("routes", "visual_score", "sensitivity_score", "cost_mb", "cost_s", "level", "origin", "skip_reason")
MARKS = {
    "summarized": Mark(sets=("size", "summary_file"), stamps=("summarized_at",), clears=("ingested_at",)),
    "ingested": Mark(stamps=("ingested_at",), creates=False),
    "routed": Mark(sets=("size", *ROUTED)),
    "fast_indexed": Mark(sets=("size", "fast_pages"), stamps=("fast_indexed_at",)),
    "content_hash": Mark(sets=("content_hash",)),
}


def newest(events: DataFrame) -> DataFrame:
    """The newest event of each path; of several at one time always the same one, by a hash of the row."""
    w = Window.partitionBy("path").orderBy(F.desc("at"), F.xxhash64(*events.columns))
    return events.where("path is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mark(manifest: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """The manifest after events of one kind; columns that the mark does not name stay as they are."""
    rule, new = MARKS[name], F.col("e.path").isNotNull()
    joined = manifest.alias("m").join(newest(events).alias("e"), F.col("m.path") == F.col("e.path"), "full" if rule.creates else "left")

    def value(column: str):
        old = F.col(f"m.{column}")
        if column in DEFAULTS:
            old = F.when(F.col("m.path").isNull(), F.expr(DEFAULTS[column])).otherwise(old)
        told = F.col(f"e.{column}") if column in rule.sets else F.col("e.at") if column in rule.stamps else F.lit(None) if column in rule.clears else old
        return F.when(new, told).otherwise(old)

    return joined.select(F.coalesce("m.path", "e.path").alias("path"), *(value(c).cast(manifest.schema[c].dataType.simpleString()).alias(c) for c in manifest.columns if c != "path"))


def unknown(manifest: DataFrame, events: DataFrame) -> DataFrame:
    """Events whose path the manifest does not know: an error where a mark creates no rows."""
    return events.join(manifest.select("path"), "path", "left_anti")


def drop(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    return manifest.join(paths.select("path"), "path", "left_anti")


def needs(files: DataFrame, manifest: DataFrame, by_mtime: bool = False) -> DataFrame:
    """path and which work each file (path, size, mtime) needs: summary, ingest, fast; done: it has been through with this size."""
    m = F.col("m.path").isNotNull()
    other = ~F.col("f.size").eqNullSafe(F.col("m.size"))
    later = F.coalesce(F.col("f.mtime") > F.col("m.mtime"), F.lit(False)) & F.lit(by_mtime)
    through = F.col("m.summary_file").isNotNull() | F.col("m.fast_indexed_at").isNotNull()
    return files.alias("f").join(manifest.alias("m"), F.col("f.path") == F.col("m.path"), "left").select(
        F.col("f.path").alias("path"), (~m | other | later).alias("summary"), (m & F.col("m.ingested_at").isNull()).alias("ingest"),
        (~m | F.col("m.fast_indexed_at").isNull() | other).alias("fast"), (m & ~other & through).alias("done"),
    )


def clean_stale(manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest without rows whose file is gone, and what they leave behind: path and summary_file of each."""
    gone = manifest.join(files.select("path"), "path", "left_anti")
    return drop(manifest, gone), gone.select("path", "summary_file")


def clean_missing_summaries(manifest: DataFrame, files: DataFrame, summaries: DataFrame) -> DataFrame:
    """Rows whose summary is gone lose what tells of it, to be summarised anew; without their file they go.

    summaries: summary_file. Rows without a summary stay.
    """
    known = summaries.select("summary_file").distinct().withColumn("_has", F.lit(True))
    there = files.select("path").distinct().withColumn("_file", F.lit(True))
    told = manifest.join(known, "summary_file", "left").join(there, "path", "left")
    lost = F.coalesce(F.col("summary_file") != "", F.lit(False)) & F.col("_has").isNull()
    kept = told.where(~lost | F.col("_file"))
    clear = ("summary_file", "summarized_at", "ingested_at")
    return kept.select(*(F.when(lost, None).otherwise(F.col(c)).alias(c) if c in clear else F.col(c) for c in manifest.columns))


def reconcile_fast(manifest: DataFrame, pages: DataFrame, at) -> DataFrame:
    """The visual tier's time and pages of each file that it holds (path, one row a page), written back to known rows."""
    counts = pages.groupBy("path").agg(F.count("*").alias("_pages"))
    told = manifest.join(counts, "path", "left")
    has = F.col("_pages").isNotNull()
    new = {"fast_indexed_at": F.when(has, at).otherwise(F.col("fast_indexed_at")), "fast_pages": F.coalesce("_pages", "fast_pages")}
    return told.select(*(new[c].alias(c) if c in new else F.col(c) for c in manifest.columns))


def under(path, root):
    """Whether a path is a root or lies below it; a name that only begins alike does not."""
    return (path == root) | path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def within_roots(manifest: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows below an enabled root (path, enabled): ancestors of each path meet roots by equality, whatever their number."""
    enabled = roots.where("enabled").select(F.when(F.col("path") == "/", "").otherwise(F.rtrim("path", F.lit("/"))).alias("_root")).distinct()
    parts = F.split("path", "/")
    above = manifest.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.array_join(F.slice(parts, 1, d), "/"))).alias("_root"))
    return manifest.join(above.join(enabled, "_root").select("path").distinct(), "path", "left_semi")


def with_root(roots: DataFrame, path: str) -> DataFrame:
    """The roots, and the path among them where no enabled root covers it."""
    covered = roots.where(F.col("enabled") & under(F.lit(path), F.col("path"))).limit(1)
    new = roots.sparkSession.createDataFrame([(path, True)], "path string, enabled boolean")
    return roots.unionByName(new.join(covered.select(F.lit(True).alias("_c")), F.lit(True), "left_anti"), allowMissingColumns=True)


def stats(manifest: DataFrame) -> DataFrame:
    """name and n: rows, those summarised, ingested, seen by the visual tier and skipped, and rows by tier."""
    counts = {"files": F.lit(True), "summarized": F.col("summary_file").isNotNull(), "ingested": F.col("ingested_at").isNotNull(), "fast": F.col("fast_indexed_at").isNotNull(), "skipped": F.col("skip_reason").isNotNull()}
    pairs = manifest.agg(*(F.count_if(c).alias(n) for n, c in counts.items())).select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in counts))).alias("x")).select("x.*")
    return pairs.union(manifest.select(F.explode("routes").alias("name")).groupBy("name").agg(F.count("*").alias("n")))


def summary_name(content_hash, tier):
    """The name of the file of a summary."""
    return F.concat(content_hash, F.lit("_"), F.lower(tier), F.lit(".md"))


def relative(path, root: str):
    """A path from the root on where it lies below it, else whole."""
    return F.when(under(path, F.lit(root)) & (path != root), F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(path)


def covers(running, roots, path, folder):
    """Whether a job under way works on a folder: one of its roots, or, without roots, its path."""
    return F.coalesce(running & F.when(F.coalesce(F.size(roots), F.lit(0)) > 0, F.array_contains(roots, folder)).otherwise(path == folder), F.lit(False))
