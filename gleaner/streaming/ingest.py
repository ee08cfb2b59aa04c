"""Incremental ingest: files that arrive are merged into a table by their key, batch after batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.state import upsert

#: Parts of a table by hashes of the key: a batch rewrites those that its keys fall into.
PARTS = 64


def _folders(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _versions(spark: SparkSession, target: str) -> dict[int, dict[int, str]]:
    """Of each part, its versions that were written whole, by number of the batch."""
    out: dict[int, dict[int, str]] = {}
    for batch in _folders(spark, target):
        if batch.startswith("v") and "_SUCCESS" in _folders(spark, f"{target}/{batch}"):
            for part in _folders(spark, f"{target}/{batch}"):
                if part.startswith("part="):
                    out.setdefault(int(part[5:]), {})[int(batch[1:])] = f"{target}/{batch}/{part}"
    return out


def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, target: str) -> DataFrame:
    """The table as it stands: the newest version of each part."""
    paths = [versions[max(versions)] for _, versions in sorted(_versions(spark, target).items())]
    if not paths:
        raise AnalysisException(f"nothing was ingested below {target}")
    return spark.read.parquet(*paths)


def before(spark: SparkSession, target: str, n: int, schema) -> DataFrame:
    """The table as it stood before the batch of that number, whether or not the batch ran already."""
    paths = [versions[max(old)] for _, versions in sorted(_versions(spark, target).items()) if (old := [v for v in versions if v < n])]
    return _read(spark, paths, schema)


def commit(target: str, rows: DataFrame, n: int, key: str, order: str, parts: int = PARTS) -> None:
    """Merges a batch's rows into the table below target, as ``ingest`` tells."""
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")
    newest = Window.partitionBy(key).orderBy(F.desc(order), F.xxhash64(*rows.columns))
    new = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").withColumn("part", part).persist()
    touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most ``parts``
    known = {k: {v: p for v, p in versions.items() if v < n} for k, versions in _versions(spark, target).items()}
    old = _read(spark, [known[k][max(known[k])] for k in touched if known.get(k)], rows.schema).withColumn("part", part)
    upsert(old, new, key).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/v{n:012d}")
    new.unpersist()
    for versions in known.values():
        for v in sorted(versions)[:-1]:
            _delete(spark, versions[v])


def ingest(arriving: DataFrame, target: str, key: str, order: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Merges a stream into a table below target; the newest row of a key (by ``order``) of a batch stays.

    A batch writes, in a folder of its own number, new versions of only those parts that its keys fall into, so it costs
    what it touches, and a batch that runs again writes the same rows in the same place. Versions that a batch
    replaces are deleted by the next one, so a reader of the table before has a batch's time to finish.
    """
    merge = lambda batch, n: commit(target, batch, n, key, order, parts)
    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
