"""Streams of logs against a replay of the whole log."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.operators import state
from gleaner.streaming import logs

START = datetime(2026, 1, 1)
LOG = "request_id string, kind string, at timestamp, body string"


def streamed(spark, folder, frames, schema):
    """Frames as a stream, one a batch."""
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        files = sorted(folder.glob("part-*.parquet"), key=lambda p: p.stat().st_mtime)
        files[-1].rename(folder / f"{i:04d}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def sunk(df, folder, mode="append"):
    """Every batch's rows, with the batch's number."""
    out = str(folder / "out")
    keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b{n}")
    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.option("recursiveFileLookup", True).parquet(out)


def test_requests_meet_their_responses(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    one = [("a", "request", at(0), "qa"), ("b", "request", at(1), "qb"), ("c", "request", at(2), "qc"), (None, "request", at(2), "x"), ("a", "request", at(3), "again")]
    two = [("a", "response", at(4), "ra"), ("z", "response", at(5), "alone"), ("b", "response", None, "no time")]
    three = [("b", "response", at(50), "rb"), ("d", "request", at(52), "qd"), ("d", "response", at(53), "rd"), ("d", "response", at(54), "again")]
    late = [("c", "response", at(3), "too late"), ("e", "request", at(1), "too late")]
    end = [("end", kind, at(10_000), "end") for kind in ("request", "response")]
    log = [one, two, three, [("f", "request", at(100), "qf"), ("g", "response", at(100), "alone")], late, end, [("end2", kind, at(20_000), "end") for kind in ("request", "response")]]
    got = sunk(logs.exchanges(streamed(spark, tmp_path / "log", log, LOG)), tmp_path).drop("batch").where("request_id not like 'end%'")
    whole = spark.createDataFrame([r for part in log for r in part if r not in late and r[0] and r[2]], LOG)
    want = state.exchanges(whole).where("request_id not like 'end%'")
    told = lambda df: sorted(map(str, df.collect()))
    assert told(got) == told(want) and got.count() == 5 and got.where("response is null").count() == 2


def replayed(rows, most):
    held = {}
    for user, n, action, entry in sorted(rows, key=lambda r: r[1]):
        held[user] = [] if action == "clear" else [(n, entry), *held.get(user, [])][:most]
    return {u: ([n for n, _ in e], [e for _, e in e]) for u, e in held.items()}


def test_recents_are_those_of_a_replay(rocks, tmp_path):
    r = random.Random(5)
    rows = [(r.choice("abc"), n, r.choice(["add"] * 12 + ["clear"]), r.choice([None, "", f"question {n}"])) for n in range(200)] + [("d", 500, "clear", None)]
    mixed = sorted(rows, key=lambda x: x[1] + r.random() * 60)  # rows come in any order
    frames = [mixed[i : i + 70] for i in range(0, len(mixed), 70)] + [mixed[:30]]  # and more than once
    frames[0] += [(None, 1, "add", "x"), ("a", None, "add", "x"), ("a", 999, "forget", "x")]
    schema = "user string, n bigint, action string, entry string"
    out = sunk(logs.recents(streamed(rocks, tmp_path / "log", frames, schema)), tmp_path, "update")
    last = {x["user"]: (x["numbers"], x["entries"]) for x in out.orderBy("batch").collect()}
    assert last == replayed(rows, 10) and last["d"] == ([], [])
    whole = state.recents(rocks.createDataFrame([x for f in frames for x in f], schema), most=3)
    assert {x["user"]: (x["numbers"], x["entries"]) for x in whole.collect()} == replayed(rows, 3)


def test_a_content_goes_to_the_extractor_once(spark, tmp_path):
    frames = [[("a", "h1"), ("b", "h1"), ("c", "h2")], [("d", "h1"), ("e", "h3")], [("f", "h3"), ("g", "h2")]]
    out = sunk(logs.first_of_content(streamed(spark, tmp_path / "in", frames, "path string, content_hash string")), tmp_path)
    assert sorted(r["content_hash"] for r in out.collect()) == ["h1", "h2", "h3"] and out.columns == ["path", "content_hash", "batch"]
