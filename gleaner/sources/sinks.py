"""Sinks: snapshots of tables with a guard, sorted files by key, logs of long texts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = "version bigint, name string, n_rows bigint, created_at timestamp"


def snapshots(spark: SparkSession, target: str) -> DataFrame:
    """A row for each table of each snapshot that was written whole."""
    try:
        return spark.read.schema(META).parquet(f"{target}/meta")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], META)


def _newest(spark: SparkSession, target: str) -> list:
    known = snapshots(spark, target)
    return known.join(known.agg(F.max("version").alias("version")), "version").collect()


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], target: str, force: bool = False) -> bool:
    """Writes the tables as the next version below target; False where that would put an empty snapshot over a full one.

    Tables come first and the rows of ``meta`` last, so a run that dies leaves the version before it in force. One
    writer at a time.
    """
    before = _newest(spark, target)
    if not force and any(r["n_rows"] for r in before) and all(df.isEmpty() for df in tables.values()):
        return False
    version = max((r["version"] for r in before), default=0) + 1
    rows = None
    for name, df in tables.items():
        path = f"{target}/v{version:012d}/{name}"
        df.write.mode("overwrite").parquet(path)
        counted = spark.read.schema(df.schema).parquet(path).agg(F.lit(version).cast("bigint").alias("version"), F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.current_timestamp().alias("created_at"))
        rows = counted if rows is None else rows.unionByName(counted)
    if rows is not None:
        rows.coalesce(1).write.mode("append").parquet(f"{target}/meta")
    return True


def restore(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of the newest snapshot; none if there is none."""
    return {r["name"]: spark.read.parquet(f"{target}/v{r['version']:012d}/{r['name']}") for r in _newest(spark, target)}


def save_json(df: DataFrame, key: str, path: str) -> None:
    """JSON lines in order of a key, the names of each line in order too, in the place of what the folder held.

    They are written whole beside it and then renamed, so a reader meets the old lines or the new ones, and a run that dies
    leaves the old ones, which the next save finds. Ranges of the key are written by many tasks; names of files follow
    their order. One writer at a time.
    """
    spark, Path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path
    new, old, place = Path(f"{path}.new"), Path(f"{path}.old"), Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(place):  # a run died between the renames
        fs.rename(old, place)
    df.select(*(F.col(f"`{n}`") for n in sorted(df.columns))).orderBy(key).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(place):
        fs.rename(place, old)
    fs.rename(new, place)
    fs.delete(old, True)


def write_by(df: DataFrame, key: str, order: str, path: str) -> None:
    """CSV files in a folder for each key, rows in order; ranges of key and order split a key that fills many tasks."""
    df.repartitionByRange(key, order).sortWithinPartitions(key, order).write.mode("overwrite").option("header", True).partitionBy(key).csv(path)


def shortened(text: Column, limit: int = 50_000) -> Column:
    """Head and tail of a text over the limit, with a note of how much lies between them."""
    half = limit // 2
    note = F.concat(F.lit("\n... ["), (F.length(text) - 2 * half).cast("string"), F.lit(" characters left out] ...\n"))
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), note, F.right(text, F.lit(half)))).otherwise(text)


def append_log(rows: DataFrame, path: str, limit: int = 50_000) -> None:
    """Adds rows to a log of JSON lines, their texts shortened."""
    rows.select(*(shortened(F.col(f"`{n}`"), limit).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in rows.dtypes)).write.mode("append").json(path)
