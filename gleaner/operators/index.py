"""The index of points: what a manifest makes of summaries and table rows, incremental merges, plans, drift and resets.

Points: point_id, path, chunk_index (null: the file itself), text, dense (its vector).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gleaner.functions import answers
from gleaner.functions import text as T
from gleaner.operators import manifest as M
from gleaner.operators import state

#: Fixed value: the size of a point's vector.
SIZE = 384

Embedder = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str]) -> np.ndarray:
    """A stand-in for a model: signed hashes of tokens, summed and scaled to length one."""
    import re
    import zlib

    out = np.zeros((len(texts), SIZE), np.float32)
    for k, text in enumerate(texts):
        for token in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(token.encode())
            out[k, h % SIZE] += 1 if h & 1 << 16 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embedded(texts: Column, embedder: Embedder = hashed) -> Column:
    """Vectors of texts, in batches, by a model that each worker holds."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embedder(batch.fillna("").tolist())))

    return run(texts)


def pooled(vectors: Column, factor: Column) -> Column:
    """A page's vectors, each run of ``factor`` of them as their mean."""
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(vectors) / factor).cast("int") - 1, F.lit(0))), lambda g: F.slice(vectors, g * factor + 1, factor))
    mean = lambda vs: F.transform(F.sequence(F.lit(0), F.size(vs[0]) - 1), lambda d: F.aggregate(vs, F.lit(0.0), lambda s, v: s + F.get(v, d).cast("double")) / F.size(vs))
    return F.transform(F.filter(groups, lambda g: F.size(g) > 0), mean)


def file_points(summaries: DataFrame) -> DataFrame:
    """A point of each parsed summary (source, title, summary, keywords, entities, identifiers)."""
    text = answers.embedding_text(F.col("title"), F.col("summary"), F.col("keywords"), F.col("entities"), F.col("identifiers"))
    return summaries.select(T.point_id(F.col("source")).alias("point_id"), F.col("source").alias("path"), F.lit(None).cast("bigint").alias("chunk_index"), text.alias("text"))


def row_key(path: Column, row: Column) -> Column:
    return F.concat(path, F.lit("::row:"), row.cast("string"))


def row_points(rows: DataFrame) -> DataFrame:
    """A point of each table row (path, row_idx, headers, fields)."""
    from gleaner.operators.rows import labelled_row

    return rows.select(T.point_id(row_key(F.col("path"), F.col("row_idx"))).alias("point_id"), "path", F.col("row_idx").alias("chunk_index"), labelled_row(F.col("headers"), F.col("fields")).alias("text"))


def expected(manifest: DataFrame) -> DataFrame:
    """point_id of all points that the manifest asks for: rows of tables, and files, tables among them only with a summary."""
    has_rows = F.coalesce(F.col("row_count") > 0, F.lit(False))
    rows = manifest.where(has_rows).select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("row_count") - 1)).alias("i"))
    whole = manifest.where(~has_rows | F.coalesce(F.col("summary_file") != "", F.lit(False)))
    return rows.select(T.point_id(row_key(F.col("path"), F.col("i"))).alias("point_id")).union(whole.select(T.point_id(F.col("path")))).distinct()


def incremental(points: DataFrame, manifest: DataFrame, summaries: DataFrame, rows: DataFrame, at: Column, force: bool = False, sweep: bool = True, embedder: Embedder = hashed) -> tuple[DataFrame, DataFrame]:
    """The points and the manifest after all summaries and table rows are in that are not yet, or all with ``force``.

    Ids hang on paths only, so a run that is cut off and begins anew writes the same points. ``sweep`` drops points
    that the manifest does not ask for.
    """
    todo = manifest.where(F.col("ingested_at").isNull() | F.lit(force)).select("path", "row_count")
    new = file_points(summaries.join(todo.select(F.col("path").alias("source")), "source", "left_semi")).unionByName(row_points(rows.join(todo.where("row_count > 0").select("path"), "path", "left_semi")))
    new = new.withColumn("dense", embedded(F.col("text"), embedder))
    merged = state.upsert(points, new.select(points.columns), "point_id")
    if sweep:
        merged = merged.join(expected(manifest), "point_id", "left_semi")
    done = M.mark(manifest, new.select("path").distinct().withColumn("at", at), "ingested")
    return merged, done


def checked_size(points: DataFrame, size: int = SIZE, vector: str = "dense") -> DataFrame:
    """The points; reading one whose vector has another size fails and names both."""
    n = F.size(vector)
    told = F.concat(F.lit("index has vectors of "), n.cast("string"), F.lit(f", the model gives {size}: index anew"))
    return points.withColumn(vector, F.when(n == size, F.col(vector)).otherwise(F.raise_error(told).cast(points.schema[vector].dataType)))


def without(points: DataFrame, ids: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """The points without those of the ids and of the paths."""
    out = points if ids is None else points.join(ids.select("point_id"), "point_id", "left_anti")
    return out if paths is None else out.join(paths.select("path"), "path", "left_anti")


def rebuilt(points: DataFrame, manifest: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Both without what lies at or below a root, so that it is indexed from scratch; with an empty root, without anything."""
    gone = M.under(F.col("path"), F.lit(root)) | F.lit(root == "")
    return points.where(~gone), manifest.where(~gone)


def drift(points: DataFrame, manifest: DataFrame) -> DataFrame:
    """kind and n: points that the manifest does not ask for, points that are missing, and files still to be ingested."""
    want, has = expected(manifest), points.select("point_id").distinct()
    counts = [("orphans", has.join(want, "point_id", "left_anti")), ("missing", want.join(has, "point_id", "left_anti")), ("waiting", manifest.where("ingested_at is null"))]
    out = None
    for kind, rows in counts:
        row = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


def by_folder(files: DataFrame, manifest: DataFrame, roots: DataFrame) -> DataFrame:
    """folder, total, remaining (files that are new or have another size) and size of each root, and of all (null).

    A file counts for the deepest root that it lies below; roots without files have zeros.
    """
    need = M.needs(files, manifest).select("path", "summary")
    parts = F.split("path", "/")
    above = files.select("path", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.struct(d.alias("d"), F.array_join(F.slice(parts, 1, d), "/").alias("dir")))).alias("a")).select("path", "size", "a.*")
    own = above.join(roots.select(F.col("path").alias("dir")), "dir").groupBy("path", "size").agg(F.max_by("dir", "d").alias("folder"))
    told = own.join(need, "path")
    counted = told.rollup("folder").agg(F.grouping("folder").alias("g"), F.count("*").alias("total"), F.count_if("summary").alias("remaining"), F.sum("size").alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    each = roots.select(F.col("path").alias("folder")).join(counted.where("g = 0"), "folder", "left").select("folder", zero("total"), zero("remaining"), zero("size"))
    return each.unionByName(counted.where("g = 1").select(F.lit(None).cast("string").alias("folder"), "total", "remaining", zero("size")))


def suggestion_sample(summaries: DataFrame, seed: int, most: int = 15, chars: int = 400) -> DataFrame:
    """source and text of some summaries that questions may be made from, the same for one seed."""
    return summaries.orderBy(F.xxhash64(F.lit(seed), "source"), "source").limit(most).select("source", F.left("summary", F.lit(chars)).alias("text"))
