"""Logs that arrive as streams: requests with their responses, recent questions by user, contents met for the first time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.operators.state import STORED, known_actions
from gleaner.workers import with_package


def exchanges(log: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """request_id, request, response and seconds of a streamed log (request_id, kind `request` or `response`, at, body).

    A request waits ``within`` for its response; then it is told without one. Of several rows of a kind with one id the first to come
    counts. Rows that are more than ``late`` behind the newest time of the log are left out, as are responses without
    a request and rows without an id or a time.
    """
    whole = log.where("request_id is not null and at is not null")

    def side(kind: str, at: str) -> DataFrame:
        rows = whole.where(F.col("kind") == kind).select(F.col("request_id").alias(f"_{kind}"), F.col("at").cast("timestamp").alias(at), F.col("body").alias(kind))
        return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([f"_{kind}"])

    asked, told = side("request", "_asked"), side("response", "_told")
    fits = (F.col("_request") == F.col("_response")) & (F.col("_told") >= F.col("_asked")) & (F.col("_told") <= F.col("_asked") + F.expr(f"interval {within}"))
    took = F.col("_told").cast("double") - F.col("_asked").cast("double")
    return asked.join(told, fits, "left_outer").select(F.col("_request").alias("request_id"), "request", "response", took.alias("seconds"))


class _Ring(StatefulProcessor):
    """Of each user the number of the last clearing, and the newest entries after it."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cleared = handle.getValueState("cleared", "n bigint")
        self.entries = handle.getListState("entries", "n bigint, entry string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cleared = self.cleared.get()[0] if self.cleared.exists() else None
        held = pd.DataFrame([tuple(r) for r in self.entries.get()] if self.entries.exists() else [], columns=["n", "entry"]).astype({"n": "int64"})
        for part in rows:  # a user's rows may be many: at most one part and the ring are held
            wiped = part.loc[part["action"] == "clear", "n"]
            if len(wiped):
                cleared = max(int(wiped.max()), cleared) if cleared is not None else int(wiped.max())
            held = pd.concat([held, part.loc[part["action"] == "add", ["n", "entry"]]]).drop_duplicates("n")
            if cleared is not None:
                held = held[held["n"] > cleared]
            held = held.nlargest(self.most, "n") if len(held) > self.most else held
        held = held.sort_values("n", ascending=False)
        if cleared is not None:
            self.cleared.update((cleared,))
        if len(held):
            self.entries.put([(int(n), e) for n, e in held.itertuples(index=False)])
        else:
            self.entries.clear()
        yield pd.DataFrame({"user": [key[0]], "numbers": [held["n"].tolist()], "entries": [held["entry"].tolist()]})

    def close(self) -> None:
        pass


def recents(log: DataFrame, most: int = STORED) -> DataFrame:
    """user, numbers and entries, as ``state.recents`` gives them of a whole log, of each user whom a batch touches.

    A clearing removes entries with smaller numbers, whenever they come: rows may come in any order and more than once. The output is
    an update; the state store has to be RocksDB's.
    """
    return with_package(known_actions(log)).groupBy("user").transformWithStateInPandas(_Ring(most), "user string, numbers array<bigint>, entries array<string>", "update", "None")


def first_of_content(files: DataFrame, hash: str = "content_hash", for_: str = "1 day") -> DataFrame:
    """The streamed files whose content did not come before, in this batch or in earlier ones of the last ``for_``.

    Time is that of arrival, so no file is too late, however old it is. A content that comes again later than that is let through:
    whoever must not ask twice then looks into what is kept (``corpus.outcomes``).
    """
    return files.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", for_).dropDuplicatesWithinWatermark([hash]).drop("_arrived")
