"""The kept index against search over texts: slices of any size, batches, ties, nulls, clashing names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import inverted, search

WORDS = [f"w{i}" for i in range(60)] + ["Ünïcode", "the", "THE"]


def corpus(spark, n, seed=1):
    r = random.Random(seed)
    texts = [" ".join(r.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=r.choice([1, 5, 40, 400]))) for _ in range(n)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(n, None, "x"), (n + 1, "", "x"), (0, texts[0], "x"), (n + 2, texts[1], "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string").repartition(3)


def told(df):
    return sorted((r["item"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the w3 w9 w9 w40"), (2, "w59"), (3, "nothing known"), (4, None), (5, " ".join(WORDS)), (6, "w0 w1 w58 ünïcode")], "item bigint, text string")


@pytest.mark.parametrize("most", [{}, {"docs_most": 7}, {"docs_most": 20, "postings_most": 50}])
def test_the_index_gives_what_a_search_over_texts_gives(spark, tmp_path, items, most):
    docs = corpus(spark, 300)
    index = inverted.build(docs, str(tmp_path / "index"), "doc_id", **most)
    want = told(search.bm25(docs, items, "doc_id", "item", k=4))
    assert told(inverted.search(index, items, "doc_id", "item", k=4)) == want and want
    assert told(inverted.search(index, items, "doc_id", "item", k=4, most=20)) == want  # in groups of questions
    if most:
        assert index.where("id is null").count() > 3


def test_texts_are_not_read_and_batches_add_up(spark, tmp_path, items):
    docs, path = corpus(spark, 200), str(tmp_path / "index")
    low, high = docs.where("doc_id < 90"), docs.where("doc_id >= 90")
    inverted.build(low, path, "doc_id")
    inverted.build(high.limit(3), path, "doc_id", batch=1)  # cut off, then written again
    index = inverted.build(high, path, "doc_id", batch=1)
    found = inverted.search(index, items, "doc_id", "item", k=5)
    assert told(found) == told(search.bm25(docs, items, "doc_id", "item", k=5))
    assert all("/index/" in f for f in found.inputFiles())


def test_an_index_of_nothing_and_no_questions(spark, tmp_path, items):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert inverted.search(inverted.build(none, str(tmp_path / "a"), "doc_id"), items, "doc_id", "item").collect() == []
    index = inverted.build(corpus(spark, 9), str(tmp_path / "b"), "doc_id")
    assert inverted.search(index, items.where("item < 0"), "doc_id", "item").collect() == []
    assert inverted.search(index, items.where("item in (3, 4)"), "doc_id", "item").collect() == []


def test_slices_are_passed_over_whose_bounds_do_not_reach(spark):
    ids, seen = [1, 2], []

    found = inverted._kernel((np.array([1, 2]), [([0, 1], [2.0, 1.0])]), 10.0, 1, 1.2, 0.75)
    slice_of = lambda tf, n: pa.table({"id": [None, 1], "docs": [None, [0]], "tf": [None, [tf]], "top_tf": [None, [tf]], "top_len": [None, [n]], "keys": [[7], None], "lens": [[n], None]})
    best = [np.zeros(0)]
    assert len(list(found(slice_of(5, 10), best))) == 1 and list(found(slice_of(1, 50), best)) == []


def test_vectors_are_numbered_terms(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "")], "doc_id bigint, text string")
    (row,) = inverted.vectors(docs, "doc_id", average=4.0).collect()
    numbers = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for t in "ab"}
    assert row["ids"] == sorted(numbers.values()) and inverted.numbers(["a", "b"]).tolist() == [numbers["a"], numbers["b"]]
    got = dict(zip(row["ids"], row["weights"]))
    weight = lambda tf: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 3 / 4))
    assert got == pytest.approx({numbers["a"]: weight(1), numbers["b"]: weight(2)})
