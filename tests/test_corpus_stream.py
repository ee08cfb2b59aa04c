"""A corpus as a stream of files: routed, summarised once a content, committed, cut off and begun again."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.streaming import corpus, ingest

WORDS = "Many plain words that say something about nothing in particular. " * 40


def png(width, height):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + b"x" * 60_000


@pytest.fixture
def models(tmp_path):
    """Each call of a model leaves a line, so that calls can be counted."""
    log = tmp_path / "calls"
    log.mkdir()

    def summarise(asked):
        asked.select("content_hash").write.mode("append").text(str(log / "summaries"))
        return asked.select("content_hash", F.concat(F.lit("# "), F.left(F.col("content").cast("string"), F.lit(9))).alias("markdown"), F.when(F.col("path").endswith("bad.md"), "refused").alias("error")).withColumn("markdown", F.when(F.col("error").isNull(), F.col("markdown")))

    return corpus.Models(summarise, lambda asked: asked.select("path", F.lit(1).cast("bigint").alias("fast_pages"), F.lit(None).cast("string").alias("error"))), log


def test_a_corpus_is_gone_through_once_and_begun_again(spark, tmp_path, models):
    models, log = models
    root, target, check = tmp_path / "root", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    root.mkdir()
    for name, data in {"a.md": WORDS, "b.md": WORDS, "c.txt": "other " * 100, "big.txt": "line of a large file\n" * 20_000, "bad.md": "unreadable " * 50, "x.zip": "PK"}.items():
        (root / name).write_text(data)
    (root / "p.png").write_bytes(png(1200, 900))
    go = lambda m=models: corpus.keep_up(corpus.arriving(spark, str(root), batch=4), target, check, m, gpu=True, parts=4).awaitTermination()
    calls = lambda: sorted(r["value"] for r in spark.read.text(str(log / "summaries")).collect())
    go()
    got = {r["path"].rpartition("/")[2]: r for r in ingest.current(spark, target).collect()}
    assert {k: r["routes"] for k, r in got.items()} == {"a.md": ["T1"], "b.md": ["T1"], "c.txt": ["T1"], "big.txt": ["T0"], "bad.md": ["T1"], "x.zip": [], "p.png": ["T4"]}
    assert got["a.md"]["markdown"] == got["b.md"]["markdown"] == "# Many plai" and [got["a.md"]["deduped"], got["b.md"]["deduped"]].count(True) == 1
    assert got["bad.md"]["error"] == "refused" and got["bad.md"]["markdown"] is None and got["p.png"]["fast_pages"] == 1 and "preview" in got["big.txt"]["markdown"]
    assert got["x.zip"]["skip_reason"].startswith("unsupported") and len(calls()) == 3  # one for each content
    assert {r["kind"]: r["files"] for r in corpus.tally(ingest.current(spark, target)).collect()} == {"T0": 1, "T1": 4, "T4": 1, "skipped": 1, "deduped": 1, "failed": 1}

    # a batch is cut off after its models were asked; it runs again and commits what the whole run would have
    (root / "d.md").write_text(WORDS)
    (root / "e.md").write_text("new words " * 30)

    def broken(asked):
        raise RuntimeError("cut off")

    with pytest.raises(Exception, match="cut off"):
        go(corpus.Models(models.summarise, broken))
    assert ingest.current(spark, target).count() == 7
    go()
    got = {r["path"].rpartition("/")[2]: r for r in ingest.current(spark, target).collect()}
    assert len(got) == 9 and got["d.md"]["deduped"] and got["d.md"]["markdown"] == "# Many plai" and got["e.md"]["markdown"] == "# new words"
    assert len(set(calls())) == 4
    present = spark.createDataFrame([(r["path"],) for r in got.values() if "c.txt" not in r["path"]], "path string")
    assert corpus.swept(ingest.current(spark, target), present).count() == 8
