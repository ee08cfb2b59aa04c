"""A corpus kept up to date: files arrive as a stream, are routed, go to their tiers, and are committed batch by batch.

The committed table is the manifest: a batch that is cut off runs again under its number, against the table as it stood
before it, and writes the same rows. Expensive steps are asked once for each content, whether its copies are in
the batch or came before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions import text as T
from gleaner.operators import router, tiers
from gleaner.sources import peeks
from gleaner.staging import discarded, scratch, written
from gleaner.streaming import ingest

#: Fixed value: files of a batch.
BATCH = 100

OUTCOME = (
    "path string, size bigint, mtime timestamp, content_hash string, routes array<string>, skip_reason string, level string, origin string, visual_score int, sensitivity_score int, "
    "cost_mb double, markdown string, fast_pages bigint, deduped boolean, error string, seen timestamp"
)


@dataclass(frozen=True)
class Models:
    """What the tiers need: a summariser (path, content_hash, routes, content to content_hash, markdown, error) and an
    encoder of pages (path, content to path, fast_pages, error)."""

    summarise: Callable[[DataFrame], DataFrame]
    encode: Callable[[DataFrame], DataFrame]


def arriving(spark: SparkSession, root: str, batch: int = BATCH) -> DataFrame:
    """The files below a folder as a stream of ``batch`` files a trigger: path, size, mtime and content."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", batch).load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def outcomes(files: DataFrame, known: DataFrame, models: Models, gpu: bool = False, cap_mb: float = router.Limits.corpus_mb, force: bool = False) -> DataFrame:
    """A row of OUTCOME for each file (path, size, mtime, content) that is new, has another size, or was never gone through with.

    Tiers: T0 previews large files; T1, T2 and T3 have a summary, asked once for each content; T4 encodes pages, within what is
    left of the corpus's budget, files in the order of their paths. A tier that fails leaves its error, and the file is gone through again.
    """
    done = known.where((F.col("markdown").isNotNull() | F.col("fast_pages").isNotNull() | F.col("skip_reason").isNotNull()) & F.col("error").isNull())
    fresh = files if force else files.join(done.select("path", "size"), ["path", "size"], "left_anti")
    fresh = written(fresh.withColumn("content_hash", T.content_hash(F.col("content"))), "arrived")
    told = peeks.peeked(fresh).withColumns({"gpu": F.lit(gpu), "accuracy": F.lit(None).cast("string"), "visual": F.lit(None).cast("string"), "budget_gb": F.lit(None).cast("double")})
    place = F.row_number().over(Window.orderBy("path"))  # a batch is of bounded size
    told = told.join(fresh.select("path").withColumn("place", place), "path")
    gone = known.where(F.array_contains("routes", "T4")).join(fresh.select("path"), "path", "left_anti").agg(F.sum("cost_mb")).first()[0] or 0.0
    routed = written(router.within_budget(told, "place", cap_mb - gone).select(
        "path", "routes", "skip_reason", "level", "origin", F.col("visual_score").cast("int"), F.col("sensitivity").cast("int").alias("sensitivity_score"), "cost_mb"), "routed")
    has = lambda *names: F.arrays_overlap("routes", F.array(*map(F.lit, names)))
    both = fresh.join(routed, "path")

    large = both.where(has("T0"))
    previewed = tiers.previewed(large, fresh.sparkSession.createDataFrame([], "path string, n_rows bigint, text string"))
    asked = both.where(has("T1", "T2", "T3"))
    before = done.where("markdown is not null").groupBy("content_hash").agg(F.first("markdown").alias("markdown"))
    firsts = asked.join(before, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("path").alias("path"))
    made = written(models.summarise(asked.join(firsts, ["content_hash", "path"], "left_semi").select("path", "content_hash", "routes", "content")), "summaries")  # asked once
    copies = asked.select("path", "content_hash").join(firsts.select("path", F.lit(True).alias("_first")), "path", "left")
    summaries = copies.join(made.select("content_hash", "markdown", "error").unionByName(before.withColumn("error", F.lit(None).cast("string"))), "content_hash", "left")
    summaries = summaries.select("path", "markdown", F.col("error").alias("_e"), (F.col("_first").isNull() & F.col("markdown").isNotNull()).alias("deduped"))
    texts = previewed.select("path", "markdown", F.lit(None).cast("string").alias("_e"), F.lit(False).alias("deduped")).unionByName(summaries)
    shown = written(models.encode(both.where(has("T4")).select("path", "content")), "encoded").select("path", "fast_pages", F.col("error").alias("_v"))

    out = both.drop("content").join(texts, "path", "left").join(shown, "path", "left").withColumns({
        "error": F.concat_ws("; ", "_e", "_v"), "deduped": F.coalesce("deduped", F.lit(False)), "seen": F.current_timestamp(),
    })
    return out.withColumn("error", F.nullif(F.col("error"), F.lit(""))).select([F.col(c.split()[0]).cast(c.split()[1]) for c in OUTCOME.split(", ")])


def keep_up(files: DataFrame, target: str, checkpoint: str, models: Models, gpu: bool = False, cap_mb: float = router.Limits.corpus_mb, parts: int = ingest.PARTS) -> StreamingQuery:
    """Goes through a stream of files and commits a row of OUTCOME for each, batch after batch, to the table below target."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        with scratch() as made:
            known = ingest.before(spark, target, n, spark.createDataFrame([], OUTCOME).schema)
            ingest.commit(target, outcomes(batch, known, models, gpu, cap_mb), n, "path", "seen", parts)
            discarded(made, batch)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def swept(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """The manifest without files that are no longer there (present: path)."""
    return manifest.join(present.select("path"), "path", "left_semi")


def tally(manifest: DataFrame) -> DataFrame:
    """kind and files: by tier, skipped, deduped and failed."""
    kind = F.concat(F.when(F.size("routes") > 0, F.col("routes")).otherwise(F.array(F.lit("skipped"))), F.when(F.col("deduped"), F.array(F.lit("deduped"))).otherwise(F.array().cast("array<string>")), F.when(F.col("error").isNotNull(), F.array(F.lit("failed"))).otherwise(F.array().cast("array<string>")))
    return manifest.select(F.explode(kind).alias("kind")).groupBy("kind").agg(F.count("*").alias("files"))
