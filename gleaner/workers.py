"""What Python workers need: this package, and batches cut to a size that does not grow with the table."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


#: Bytes of text, or places of tokens, that a worker takes apart at once.
BYTES, TOKENS = 1_000_000, 131_072


def pieces(batches: Iterator[pa.RecordBatch], column: str | int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about BYTES of a text column each, or TOKENS of a column of lists (one row is never cut)."""
    for batch in batches:
        own = batch.column(column)
        listed = pa.types.is_list(own.type)
        sizes = np.asarray(pc.fill_null((pc.list_value_length if listed else pc.binary_length)(own), 0), dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + (TOKENS if listed else BYTES), side="right")))
            yield batch.slice(at, to - at)
            at = to


def with_package(df: DataFrame) -> DataFrame:
    """Lets Python workers find this package: Spark sends them an archive of it, once for each application."""
    sc, root = df.sparkSession.sparkContext, Path(__file__).resolve().parent
    name = f"{root.name}-package.zip"
    if root.suffix != ".zip" and not any(str(p).endswith(name) for p in sc._python_includes):
        path = Path(tempfile.mkdtemp(prefix=f"{root.name}-")) / name
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        sc.addPyFile(str(path))
    return df
