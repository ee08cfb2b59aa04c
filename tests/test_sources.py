import json

from gleaner.functions import text as T
from gleaner.operators import search, windows
from gleaner.sources import files
from gleaner.streaming.ingest import current, ingest
from pyspark.sql import functions as F


def test_discovery_prunes_hidden_and_excluded_folders(spark, tmp_path):
    for p in ("a.TXT", "b/c.csv", ".git/x.txt", "node_modules/y.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    got = {(r["path"].rpartition("/")[2], r["ext"], r["size"]) for r in files.discover(spark, str(tmp_path)).collect()}
    assert got == {("a.TXT", ".txt", 1), ("c.csv", ".csv", 1)}


def test_csv_rows_are_numbered_and_keep_quoted_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,name\n1,"two\nlines"\n2,caf\xff\xc3\xa9\n3\n')
    got = sorted((r["row_idx"], r["fields"]) for r in files.csv_rows(spark, str(tmp_path)).collect())
    assert got == [(0, {"id": "1", "name": "two\nlines"}), (1, {"id": "2", "name": "café"}), (2, {"id": "3", "name": ""})]


def test_notebook_cells(spark):
    book = json.dumps({"cells": [{"cell_type": "markdown", "source": ["a\n", "b"]}, {"cell_type": "code", "source": "x = 1"}]})
    got = spark.createDataFrame([(book,)], "t string").select(files.notebook_text(F.col("t"))).first()[0]
    assert got == "# Cell 1 (markdown)\na\nb\n\n# Cell 2 (code)\nx = 1"


def test_summaries_lose_headings_and_all_after_the_first_bold_line(spark):
    text = "Source: /a/b.pdf\n\n# Title\n\nfirst\n# gone\nsecond\n\n**Keywords:** x, y\n**Identifiers:** —\nlost"
    got = files.parse_summaries(spark.createDataFrame([(text,)], "value string")).first()
    assert (got["source"], got["title"], got["summary"], got["keywords"], got["identifiers"]) == ("/a/b.pdf", "Title", "first second", ["x", "y"], [])


def test_ingest_keeps_the_newest_row_of_each_key(spark, tmp_path):
    source, target, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    for batch in ([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], [(2, 5, "d"), (3, 1, "e")]):
        spark.createDataFrame(batch, "k bigint, t bigint, v string").coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema("k bigint, t bigint, v string").parquet(source), target, "k", "t", at).awaitTermination()
    got = current(spark, target).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, "c"), (2, 5, "d"), (3, 1, "e")]


def test_fusion_keeps_null_chunks_together(spark):
    hits = [("summary", 1, "doc.pdf", None, "s"), ("fast", 1, "doc.pdf", None, "f"), ("summary", 2, "foo.csv", 5, "first"), ("summary", 3, "foo.csv", 5, "second")]
    got = search.fuse(spark.createDataFrame(hits, "list string, rank int, path string, chunk_index int, summary string"), 5, 1, 60).collect()
    assert [(r["path"], r["tier"], r["summary"], round(r["score"], 6)) for r in got] == [("doc.pdf", "both", "s", round(2 / 61, 6)), ("foo.csv", "summary", "second", round(1 / 62 + 1 / 63, 6))]


def test_islands_touch_and_clamp(spark):
    hits = [("a", h, 50) for h in (5, 10)] + [("b", h, 100) for h in (5, 47, 6)] + [("c", 0, 10), ("c", 0, 10)]
    got = windows.islands(spark.createDataFrame(hits, "k string, i int, n int"), "k", "i", "n").collect()
    assert sorted(tuple(r) for r in got) == [("a", 3, 13, 2), ("b", 3, 9, 2), ("b", 45, 50, 1), ("c", 0, 3, 1)]


def test_sensitivity_of_a_statement(spark):
    text = "Total $1.00 Balance €2.50 £3.20 acct ****1234 2024-01-02 5.00 2024-01-03 6.00 2024-01-04 7.00 hereby SSN"
    frame = spark.createDataFrame([(text,), (None,), ("plain",)], "t string")
    assert [r[0] for r in frame.select(T.sensitivity(F.col("t"))).collect()] == [10, 0, 0]
