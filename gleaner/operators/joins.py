"""Joins that no single key can fill a task of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are sent to every task, at most: those of more rows than a KEYS-th of all have.
KEYS = 500


def joined(rows: DataFrame, told: DataFrame, on: list[str], total: int, few: int = 0) -> DataFrame:
    """Inner join with a table of one row for each key, whose ``n`` tells how many of the ``total`` rows have it.

    Keys of over max(KEYS, total / KEYS) rows are at most KEYS: they are sent to every task, so that no task gets all
    rows of one; the others are joined by shuffle, as no key of theirs fills a task. Where all rows are ``few`` at most,
    one task could hold them, and no key is told apart: the plan is half as large, and the driver keeps no broadcasts.
    """
    if total <= few:
        return rows.join(told.drop("n"), on)
    limit = max(KEYS, total // KEYS)
    hot, rest = F.broadcast(told.where(F.col("n") > limit).drop("n")), told.where(F.col("n") <= limit).drop("n")
    few = rows.join(F.broadcast(told.where(F.col("n") > limit).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(few.join(rest, on))
