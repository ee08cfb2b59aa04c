"""Late interaction against all products."""

import random

import numpy as np
import pytest

from gleaner.operators import search


def brute(vectors, tokens, k):
    docs = {}
    for d, v in vectors:
        if v is not None:
            docs.setdefault(d, []).append(v)
    out = []
    for q in {q for q, _ in tokens}:
        own = [v for n, v in tokens if n == q]
        score = {d: round(sum(max(float(np.dot(t, v)) for v in vs) for t in own), 6) for d, vs in docs.items()}
        best = sorted(score, key=lambda d: (-score[d], d is not None, d or 0))[:k]
        out += [(d, q, score[d], n) for n, d in enumerate(best, 1)]
    return sorted(out, key=lambda r: (r[1], r[3]))


@pytest.mark.parametrize("keys", [500, 3])
def test_max_sim_equals_all_products(spark, monkeypatch, keys):
    """Of documents of any size, brought together or, if of very many vectors, in parts."""
    monkeypatch.setattr(search, "KEYS", keys)
    monkeypatch.setattr(search, "GROUP", 9)
    rng = np.random.default_rng(4)
    vectors = [(d, rng.normal(size=6).round(3).tolist()) for d in [*range(80), None] for _ in range(rng.integers(1, 9))]
    vectors += [(7, rng.normal(size=6).round(3).tolist()) for _ in range(600)] + vectors[:5] + [(3, None), (999, None)]
    random.Random(1).shuffle(vectors)
    tokens = [(q, rng.normal(size=6).round(3).tolist()) for q in ("a", "b", "c", "d") for _ in range(5)]
    v = spark.createDataFrame([(i, *x) for i, x in enumerate(vectors)], "vec_id int, doc int, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(tokens)], "vec_id int, name string, embedding array<double>")
    got = sorted(((r["doc"], r["name"], r["score"], r["rank"]) for r in search.max_sim(v, q, "doc", 4, "name").collect()), key=lambda r: (r[1], r[3]))
    assert got == brute(vectors, tokens, 4)
    one = [(r["doc"], r["score"]) for r in search.max_sim(v, q.where("name = 'a'"), "doc", 3).orderBy("score", ascending=False).collect()]
    assert one == [(d, s) for d, n, s, k in brute(vectors, tokens, 3) if n == "a"]
    assert search.max_sim(v.where("false"), q, "doc", 3, "name").count() == search.max_sim(v, q.where("false"), "doc", 3, "name").count() == 0


def test_bounds_skip_documents_but_none_of_the_best():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 16))
    rows = np.repeat(centres, 20, axis=0) + rng.normal(size=(8000, 16)) * 0.01
    tokens = search.Tokens([0, 0, 1], rng.normal(size=(3, 16)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(400), 20)), pa.array(rows.tolist()), pa.array((np.arange(8000) % 20 == 0).tolist())], names=["doc", "v", "first"])
    products, measured = tokens.maxima, []
    tokens.maxima = lambda v, starts: (measured.append(len(v)), products(v, starts))[1]
    got = {}
    for docs, q, score in search.documents_scored([batch], tokens, 5):
        for d, n, s in zip(docs.to_pylist(), q, score):
            got.setdefault(int(n), []).append((-s, d))
    want = np.round(np.add.reduceat(products(rows, np.arange(0, 8000, 20)), tokens.starts, axis=1), 6)
    for n in (0, 1):
        assert [d for _, d in sorted(got[n])[:5]] == sorted(range(400), key=lambda d: (-want[d, n], d))[:5]
    assert sum(measured) < 5000
