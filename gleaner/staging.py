"""Tables that cut a plan in two: written once to the folder that driver and executors share, then read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine."""
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return sc.getCheckpointDir().rstrip("/")


#: Bytes of a row group in tables of texts: a task holds one while it reads and one while it writes, whatever the file's size.
GROUP = 8_000_000

_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that are written within, for whoever writes a result from them to discard (``discarded``)."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def discarded(made: list[DataFrame], result: DataFrame) -> DataFrame:
    """The result, a written table, with all others of a scratch deleted."""
    for table in made:
        if table is not result:
            discard(table)
    return result


def written(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, so that a lost executor costs no earlier stage.

    The shuffles behind the table are dropped as soon as it is written; nothing reads them again. ``group``: bytes of
    a row group (Spark's own, if None).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        (df.write.option("parquet.block.size", group) if group else df.write).parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
