"""Vector codes, the filter audit and toxicity against brute force, their SQL and held-out labels; suffix shares and samples."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from oracle import expected, rows
from pyspark.sql import functions as F

from gleaner.llm import audit, codes, quality, queries, rules, toxicity, urls
from gleaner.llm.common import labelled


def brute_codes(vectors, scale, parts, entries, rounds):
    """vectors: (id, label, components); code and error of each, and the digest of the codebooks."""
    whole = [(i, label, [int(scale * x // 1) for x in v]) for i, label, v in vectors]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(whole[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, _, v in whole[:entries]] for p in range(parts)]
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        made = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, _, v in whole:
                own[near(v, p)[1]].append(cut(v, p))
            made.append([[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, books[p])])
        books = made
    out = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), label) for i, label, v in whole]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("scale", [16, 3e9, 1e60])
def test_codes_equal_brute_force_with_ties_nulls_and_numbers_of_any_size(spark, scale):
    rng = random.Random(2)
    made = [(i, rng.choice([None, 1, 2]), [rng.choice([rng.uniform(-1, 1), 0.5, -0.25]) for _ in range(8)]) for i in range(60)]
    made += [(3, 1, made[5][2]), (3, 1, made[5][2]), (None, 2, made[9][2])]
    broken = [(70, 1, None), (71, 1, [None] * 8), (72, 1, [float("nan")] * 8), (73, 1, [float("inf")] * 8)]
    v = spark.createDataFrame([(*r, "clash") for r in made + broken], "vec_id bigint, label int, embedding array<double>, code string").repartition(3)
    got = codes.compress(v, scale=scale, parts=4, entries=7, rounds=3).collect()
    want, sha = brute_codes(made, scale, 4, 7, 3)
    sums = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    most = codes.LONGEST
    want = [(i, c, min(e, most), min(sums[label], most) if e < most else most, sha) for i, c, e, label in want]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=key) == sorted(want, key=key)


def test_codes_equal_their_sql(spark, sf_dir):
    df = queries.op11_vector_codes(spark, sf_dir)
    assert (sorted(df.columns), rows(df.columns, df.collect())) == expected(queries.ORACLE_SQL["op11_vector_codes"], sf_dir)


def test_codes_of_empty_tables_and_unequal_lengths(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (2, 0, []), (3, None, [1.0, 2.0, 3.0, 0.0, 0.0])], "vec_id bigint, label int, embedding array<float>")
    assert codes.compress(v.where("false")).count() == 0
    got = {r["vec_id"]: (r["code"], r["error"]) for r in codes.compress(v, scale=1).collect()}
    assert got == {1: ("00000000", 0), 2: ("01010000", 0), 3: ("00000000", 0)}
    assert {r["code"] for r in codes.compress(v.where("vec_id = 2")).collect()} == {"00000000"}


def test_bounds_never_drop_the_nearest_entry():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 5, 16):
        a, b = (rng.integers(-40, 40, (n, width)) for n in (300, 64))
        b[9] = b[4]
        found, far, took = codes.nearest(codes.Side(a), codes.Side(b))
        want = ((a[:, None] - b[None]) ** 2).sum(2)
        assert (want.argmin(1) == found).all() and (want.min(1) == far).all()
        for level in range(len(codes.segments(width))):
            assert (codes.bound(codes.Side(a), codes.Side(b), level) <= want).all()
    near = np.repeat(rng.integers(-2000, 2000, (16, 16)), 32, axis=0) + rng.integers(-5, 5, (512, 16))
    assert codes.nearest(codes.Side(near), codes.Side(near[::4]))[2] < 512 * 128 / 3  # the filter filters


def brute_audit(docs, labels):
    """docs: (id, text, source)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = any((o or "") == t and i is not None and j is not None and j < i for j, o, _ in docs)
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), earlier)
        found.append((source or "", i, {c for c, x in zip("ABCDE", tests) if x}))
    out = []
    for part in {p for p, _, _ in found}:
        own, total = [(i, f) for p, i, f in found if p == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                gone = lambda f: f & set(order[:k])  # noqa: B023, E731
                lost = [i for i, f in own if c in f and not gone(f)]
                total[c] += len(lost)
                steps.append((
                    part, "".join(order), k + 1, sum(not f & set(order[: k + 1]) for _, f in own), len(lost), sum(c in f and bool(gone(f)) for _, f in own), sum(f == {c} for _, f in own),
                    sum(i in good for i in lost), sum(i in toxic for i in lost), c,
                ))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(8)
    words = ["alpha", "Beta", "GAMMA", "$", "naïve", "δ", "a|b"] + [f"w{k}" for k in range(90)]
    texts = [" ".join(rng.sample(words, rng.randint(30, 90))) + rng.choice(["", "\n", " \t\x0b"]) for _ in range(30)]
    texts += ["ABC " * 60, "low " * 60, " ".join(f"v{k}" for k in range(80)), None, "", "", None, " ".join(f"u{k}" for k in range(40_000))]
    docs = [(k, t, rng.choice(["x", "y", "", None])) for k, t in enumerate(texts)]
    docs += [(100 + k, texts[k % 7], "x") for k in range(20)] + [(3, texts[3], "y"), (3, "another text", "x"), (None, texts[1], "x"), (None, texts[1], "x"), (-1, texts[30], None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 7, "clash") for r in docs], "doc_id bigint, text string, source string, mask int, part string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit(d, lab)
    assert got.columns == ["part", "filter_order", "step", *audit.COUNTS]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)
    assert audit.audit(d.where("false"), lab).count() == 0
    assert audit.audit(d, lab.where("false")).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_audit_equals_its_sql(spark, sf_dir):
    df = queries.op12_filter_audit(spark, sf_dir)
    assert (sorted(df.columns), rows(df.columns, df.collect())) == expected(queries.ORACLE_SQL["op12_filter_audit"], sf_dir)


def test_toxicity_holds_out_well(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in queries.op13_toxicity(spark, big).collect()}
    labels = [r for r in spark.read.parquet(f"{big}/labels.parquet").collect() if got[r["doc_id"]]["held_out"] and r["toxic"] is not None]
    assert np.mean([got[r["doc_id"]]["predicted"] == r["toxic"] for r in labels]) >= 0.95
    toxic = [got[r["doc_id"]] for r in labels if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())


@pytest.fixture(scope="module")
def bags():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(200)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(4, 12))).capitalize()
    out = []
    for k in range(240):
        found = [sentence() for _ in range(rng.randint(2, 12))]
        if k % 4 == 0:
            at = rng.randrange(len(found))
            found[at] += rng.choice([" Schlimmen", " schlimmer", " schlimmes", " rotten"])
        out.append((k, ". ".join(found) + ".", int(k % 4 == 0)))
    return out


def test_toxicity_learns_sentences_from_documents(spark, bags):
    texts, labels = [t.encode() for _, t, _ in bags], np.array([y for _, _, y in bags])
    model = toxicity.fit(texts[:180], labels[:180])
    for text, y in zip(texts[180:], labels[180:]):
        found, p = model.sentences(text)
        assert (model.score(p) >= 0.5) == y
        assert [text[b:e] for (b, e, _), x in zip(found, p) if x >= 0.5] == [text[b:e] for b, e, w in found if any(re.match(rb"(?i)schlimm|rotten", x) for x in w)]
    docs = spark.createDataFrame([(900, "Naïve öd. Ein schlimmes Wort! Gut", "c"), (901, None, "c"), (902, "", "c"), (903, "fine words. " * 30_000, "c"), (903, "fine words. " * 30_000, "c")], "doc_id bigint, text string, begin string")
    assert [(r["doc_id"], r["begin"], r["end"], r["sentence"]) for r in toxicity.offending(docs, model).collect()] == [(900, 9, 28, " Ein schlimmes Wort")]
    scores = {r["doc_id"]: (r["score"] >= 0.5, r["n_sentences"], r["n_offending"]) for r in toxicity.score(docs, model).collect()}
    assert scores[900] == (True, 3, 1) and scores[901] == scores[902] == (False, 0, 0) and scores[903][1] == 30_000
    assert toxicity.score(docs, model).count() == 5 and toxicity.score(docs.where("false"), model).count() == 0


def test_toxicity_gradient_rises_to_the_likelihood(bags):
    texts, labels = [t.encode() for _, t, _ in bags[:80]], np.array([y for _, _, y in bags[:80]])

    def likelihood(m):
        p = np.array([m.score(m.sentences(t)[1]) for t in texts])
        return np.log(np.where(labels == 1, np.maximum(p, 1e-300), 1 - np.minimum(p, 1 - 1e-12))).sum()

    found = [likelihood(toxicity.fit(texts, labels, epochs=n)) for n in (1, 10, 40, 150)]
    assert found == sorted(found) and found[-1] > -12


def test_toxicity_of_one_class_or_none(spark, bags):
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in bags[:12]] + [(5, bags[5][1], "x")], "doc_id bigint, text string, score string")
    one = spark.createDataFrame([(k, 1) for k in range(6)] + [(7, None)], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, one)).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, one.where("false"))).collect()} == {0.5}


def test_samples_leave_out_only_texts_that_do_not_fit(spark):
    ids = sorted(range(200), key=lambda i: spark.range(1).select(F.xxhash64(F.lit(i).cast("bigint"))).first()[0])
    texts = {i: f"Some good words of a text, line {i}.\n" * 5 if i % 2 else f"BAD | bad {i} ** ## \n" * 5 for i in ids}
    texts[ids[0]] = "long text " * 1_050_000
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    got = labelled(docs, labels, "quality", 1000, 10_000_000)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == set(ids[1:])
    model, field = quality.train(docs, labels, max_bytes=10_000_000), rules.train(docs, labels)
    assert model.slope > 0 and (field.emit[1] != field.emit[0] + 1).any()
    assert labelled(docs, labels, "quality", 20, 10_000_000).count() == 19
    assert labelled(docs, labels, "quality", 1000, 0).count() == 0


def test_trees_agree_with_hidden_rules_on_suffixes_of_both_kinds(spark, sf_dir):
    pages = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/pages.parquet").select("page_id", "url")
    ruled = urls.by_rule(pages, queries.URL_RULES).withColumn("truth", F.col("decided")).withColumn("decided", F.when(F.crc32("url") % 2 == 0, F.col("decided")))
    told = urls.with_suffixes(ruled)
    trees = urls.train(told)
    hidden = told.where("decided is null and truth is not null").collect()
    assert {(r["suffix"], r["truth"]) for r in hidden} >= {("com", "allow"), ("com", "block")}
    x = np.array([urls.lexical(r["url"], r["suffix_blocked"], r["suffix_decided"]) for r in hidden], float)
    assert ((trees.margin(x) >= 0) == [r["truth"] == "block" for r in hidden]).mean() >= 0.95


def test_shares_decide_where_urls_look_alike(spark):
    rng = random.Random(3)
    found = [(k, f"https://h{rng.randrange(1000)}.{s}/p/{rng.randrange(10**6)}") for k, s in enumerate(rng.choices(["aa", "bb"], k=900))]
    pages = spark.createDataFrame(found, "page_id bigint, url string")
    blocked = (F.col("url").contains(".aa/") & (F.crc32("url") % 10 < 9)) | (F.col("url").contains(".bb/") & (F.crc32("url") % 10 == 0))
    ruled = urls.by_rule(pages, []).withColumn("decided", F.when(F.col("page_id") % 3 > 0, F.when(blocked, "block").otherwise("allow")))
    told = urls.with_suffixes(ruled)
    trees = urls.train(told)
    rest = told.where("decided is null").collect()
    x = np.array([urls.lexical(r["url"], r["suffix_blocked"], r["suffix_decided"]) for r in rest], float)
    assert ((trees.margin(x) >= 0) == [r["suffix"] == "aa" for r in rest]).mean() >= 0.9
