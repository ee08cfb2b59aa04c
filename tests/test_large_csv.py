"""CSV files cut into blocks at every byte, against the reader that has a file whole."""

import csv
import io
import random

import pytest

from gleaner.sources import files, large_csv

TEXTS = {
    "a": 'id,name\n1,"x\ny"\n2,"he said ""no""\n\nthen left"\n\n3,plain\n4,"a,b",extra\n5\n',
    "b": 'h1,h2\r\n"q""\r\n",2\r\nmid"quote,3\r\n"closed"x,4\r\n"open to the end,\n1,2',
    "c": 'one,one\nü,é\n"ö\nß",\n',
    "d": "",
    "e": "only,header\n",
}


def shown(df):
    return sorted((r["path"].rpartition("/")[2], r["row_idx"], r["headers"], sorted(r["fields"].items()) if r["fields"] else None, r["error"]) for r in df.collect())


@pytest.mark.parametrize("size", ["1500b", "128m"])
def test_blocks_give_the_rows_of_the_whole_file(spark, tmp_path, size):
    for name, text in TEXTS.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    (tmp_path / "f.csv").write_bytes(b"k,v\n1,a\xff\xe9b\n2,c\n")
    rng = random.Random(7)
    for name in "ghi":  # rows of every shape, so that blocks end anywhere
        signs = ['"', '""', ",", "\n", "\r\n", "a", "bc", "ü"]
        (tmp_path / f"{name}.csv").write_bytes(("h1,h2,h3\n" + "".join(rng.choices(signs, k=3000))).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = large_csv.large_csv_rows(spark, str(tmp_path))
        assert shown(got) == shown(files.csv_rows(spark, str(tmp_path)))
        latin = large_csv.large_csv_rows(spark, str(tmp_path), latin=True, glob="f.csv")
        assert [r["fields"]["v"] for r in latin.orderBy("row_idx").collect()] == ["aÿéb", "c"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_line_maps_the_states_as_the_reader_does():
    rng = random.Random(2)
    for _ in range(20_000):
        line = "".join(rng.choices('",a\r', weights=(5, 3, 3, 1), k=rng.randint(0, 9)))
        for inside in (False, True):
            # whether the line feed after the line is part of a field, told by the reader
            text = ('"' if inside else "") + line + "\n"
            rows = list(csv.reader(io.StringIO(text + 'mark",mark', newline="")))
            held = any("\nmark" in f or f.startswith("\n") for r in rows for f in r)
            assert large_csv.inside_after(line.encode(), inside) == held, (line, inside)


def test_a_file_of_many_blocks_is_read_by_many_tasks(spark, tmp_path):
    with (tmp_path / "big.csv").open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["k", "v"])
        out.writerows((k, "line\nend" if k % 5 == 0 else f'say "{k}"') for k in range(20_000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        got = large_csv.large_csv_rows(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        found = {r["row_idx"]: (r["fields"]["k"], r["fields"]["v"]) for r in got.collect()}
        assert found == {k: (str(k), "line\nend" if k % 5 == 0 else f'say "{k}"') for k in range(20_000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
