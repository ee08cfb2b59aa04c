"""The engine's steps on literal cases."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from gleaner.functions import routing
from gleaner.functions import text as T
from gleaner.operators import answering, evaluation, hybrid, index, offerings, router, rows, search, sidecars, state, tiers
from gleaner.operators import ask as asking
from gleaner.operators import manifest as M
from gleaner.sources import extract, files, office, peeks
from gleaner.streaming.ingest import current, ingest

PEEK = "path string, name string, ext string, size_bytes bigint, page_count bigint, text_density bigint, extractable boolean, image_ratio double, row_count bigint, width bigint, height bigint, peek_text string, peek_error string, accuracy string, visual string, budget_gb double, gpu boolean, used_mb double"
SENSITIVE = "Total $1.00 Balance €2.50 £3.20 acct ****1234"


def peek(ext, size=1000, pages=0, density=500, ok=True, ratio=0.0, rows_=None, dims=(None, None), text="plain words", error=None, accuracy=None, visual=None, gpu=False, used=0.0, name=None):
    return (f"/x{ext}", name or f"x{ext}", ext, size, pages, density, ok, ratio, rows_, *dims, text, error, accuracy, visual, None, gpu, used)


@pytest.mark.parametrize(
    "found, routes, skip",
    [
        (peek(".md"), ["T1"], None), (peek(".txt", 250 * 1024), ["T0"], None), (peek(".py"), ["T1"], None), (peek(".js", 1 << 20), ["T0"], None), (peek(".csv", rows_=500), ["T1"], None), (peek(".csv", rows_=150_000), ["T1"], None),
        (peek(".csv", 30 << 20, rows_=100_000), ["T2"], None), (peek(".csv", 30 << 20, rows_=100_001), ["T0"], None), (peek(".pdf", pages=3), ["T3"], None), (peek(".pdf", pages=40), ["T2"], None), (peek(".pdf", pages=10, density=0, ok=False, gpu=True), ["T4"], None),
        (peek(".pdf", pages=10, density=0, ok=False), ["T3"], None), (peek(".pdf", pages=300, density=0, ok=False, gpu=True), ["T3"], None), (peek(".pdf", pages=10, density=0, ok=False, gpu=True, used=5 * 1024 - 0.5), ["T3"], None),
        (peek(".jpg", 90_000, 1, dims=(1200, 900), gpu=True), ["T4"], None), (peek(".png", 1000, 1, dims=(64, 64)), [], "thumbnail"), (peek(".docx", pages=1), ["T2"], None), (peek(".docx", pages=1, ratio=5 / 3, gpu=True), ["T4"], None), (peek(".zzz"), [], "unsupported extension: .zzz"),
        (peek(".pdf", pages=10, text=SENSITIVE), ["T3", "T2"], None), (peek(".pdf", pages=10, density=0, ok=False, gpu=True, accuracy="critical"), ["T3", "T4"], None), (peek(".pdf", pages=10, density=0, ok=False, gpu=True, visual="never"), ["T3"], None),
        (peek(".pdf", pages=3, density=0, ok=False, gpu=True, visual="always"), ["T4"], None), (peek(".pdf", pages=0, error="locked"), [], "pdf empty or unreadable: locked"), (peek("", name=".bashrc"), ["T1"], None), (peek(".html", ok=False), [], "html extracted empty — likely JS-only SPA"),
        (peek(".pptx", pages=9, ratio=0.5, gpu=True), ["T2", "T4"], None), (peek(".xlsx", 11 << 20), ["T0"], None), (peek(".ipynb", pages=0), [], "ipynb has no cells"), (peek(".docx", error="damaged"), [], "peek failed: damaged"),
    ],
)
def test_routes(spark, found, routes, skip):
    got = router.decided(spark.createDataFrame([found], PEEK)).first()
    assert (got["routes"], got["skip_reason"]) == (routes, skip)


def test_a_corpus_keeps_within_the_visual_budget(spark):
    found = [(*peek(".pdf", pages=n, density=0, ok=False, gpu=True), k) for k, n in enumerate((15, 30, 20, 5))]
    frame = spark.createDataFrame(found, PEEK + ", id bigint").withColumn("visual", F.lit("always")).drop("used_mb")
    got = {r["id"]: r["routes"] for r in router.within_budget(frame, "id", 8.0).collect()}
    assert got == {0: ["T4"], 1: ["T3"], 2: ["T4"], 3: ["T4"]}  # 3, 6, 4 and 1 MB
    tally = {r["tier"]: r["files"] for r in router.tally(router.decided(frame.withColumn("used_mb", F.lit(0.0)).withColumn("accuracy", F.lit("critical")))).collect()}
    assert tally == {"T3": 4, "T4": 4, "several": 4}


def test_the_nearest_config_counts(spark):
    found = spark.createDataFrame([("/a/b/c/x.txt",), ("/a/y.txt",), ("/z.txt",)], "path string")
    configs = spark.createDataFrame([("/a", "casual"), ("/a/b", "critical")], "dir string, accuracy string")
    assert {r["path"]: r["accuracy"] for r in router.nearest_config(found, configs).collect()} == {"/a/b/c/x.txt": "critical", "/a/y.txt": "casual", "/z.txt": None}


def test_manifest_of_roots_and_mark_of_unknown_paths(spark):
    roots = spark.createDataFrame([("/a", True), ("/b/", True), ("/c", False)], "path string, enabled boolean")
    rows_ = spark.createDataFrame([(p,) for p in ("/a/x", "/ab/x", "/b/x/y", "/c/x", "/a")], "path string")
    assert sorted(r["path"] for r in M.within_roots(rows_, roots).collect()) == ["/a", "/a/x", "/b/x/y"]
    assert {r["path"] for r in M.with_root(roots, "/a/deep").collect()} == {"/a", "/b/", "/c"}
    assert {r["path"] for r in M.with_root(roots, "/c/deep").collect()} == {"/a", "/b/", "/c", "/c/deep"}
    empty = spark.createDataFrame([], M.SCHEMA)
    event = spark.createDataFrame([("/n", 5)], "path string, size bigint").withColumns({"at": F.current_timestamp(), "summary_file": F.lit("s.md")})
    assert M.mark(empty, event, "ingested").count() == 0 and M.unknown(empty, event).count() == 1
    made = M.mark(empty, event, "summarized").first()
    assert (made["size"], made["routes"], made["level"], made["ingested_at"]) == (5, [], "normal", None)
    assert M.relative(F.lit("/a/b"), "/a") is not None
    shown = spark.range(1).select(M.relative(F.lit("/r/b/c"), "/r"), M.relative(F.lit("/rb"), "/r"), M.summary_name(F.lit("ab"), F.lit("T3")), M.covers(F.lit(True), F.array(F.lit("/q")), F.lit("/p"), F.lit("/q")), M.covers(F.lit(True), F.lit(None).cast("array<string>"), F.lit("/p"), F.lit("/q"))).first()
    assert tuple(shown) == ("b/c", "/rb", "ab_t3.md", True, False)


# ---- rows as text


def table_of(spark, n, path="t.csv", value="r{}"):
    return spark.createDataFrame([(path, i, ["id", "name"], {"id": str(i), "name": value.format(i)}) for i in range(n)], "path string, row_idx bigint, headers array<string>, fields map<string,string>")


@pytest.mark.parametrize(
    "n, hits, islands",
    [(50, [10], [(8, 13)]), (10, [0], [(0, 3)]), (10, [9], [(7, 10)]), (50, [5, 6], [(3, 9)]), (100, [5, 47], [(3, 8), (45, 50)]), (100, [5, 6, 47], [(3, 9), (45, 50)]), (50, [5, 9], [(3, 12)]), (50, [10, 10, 10], [(8, 13)]), (50, [5, 10], [(3, 13)]), (5, [], None), (5, [400], None)],
)
def test_row_windows(spark, n, hits, islands):
    got = rows.window_blocks(table_of(spark, n), spark.createDataFrame([("t.csv", h) for h in hits], "path string, row_idx bigint")).collect()
    line = lambda i: f"{i},r{i}" + (rows.MARK if i in hits else "")
    want = rows.BETWEEN.join("\n".join(["id,name", *map(line, range(a, b))]) for a, b in islands or [])
    assert [r["block"] for r in got] == ([want] if islands else [])


def test_rows_are_quoted_and_sampled(spark):
    got = rows.sample_blocks(table_of(spark, 3, value='Hello, "{}"')).first()["block"]
    assert got == 'id,name\n0,"Hello, ""0"""\n1,"Hello, ""1"""\n2,"Hello, ""2"""'
    assert rows.sample_blocks(table_of(spark, 50)).first()["block"].count("\n") == 5
    one = spark.range(1).select(rows.csv_line(F.array(F.lit(""))), rows.csv_line(F.array(F.lit(""), F.lit("a\nb"))), rows.labelled_row(F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit("x")))).first()
    assert tuple(one) == ('""', ',"a\nb"', "b: x")
    assert rows.expanded_hits(table_of(spark, 3), spark.createDataFrame([("t.csv", 0), ("t.csv", 9)], "path string, row_idx bigint")).collect()[0]["snippet"] == "[row 0 (match)] id: 0 | name: r0\n[row 1] id: 1 | name: r1\n[row 2] id: 2 | name: r2"


# ---- search


def fused(spark, hits, k=5):
    frame = spark.createDataFrame([(1, *h) for h in hits], "question_id bigint, list string, rank int, path string, chunk_index int, summary string")
    return search.fuse(frame, k, 1, 60, ("question_id",)).orderBy("rank").collect()


def test_fusion_of_chunks_and_files(spark):
    assert {r["chunk_index"] for r in fused(spark, [("summary", i + 1, "f.csv", c, "s") for i, c in enumerate((5, 6, 47))])} == {5, 6, 47}
    both = fused(spark, [("summary", 1, "foo.csv", 0, "s"), ("fast", 1, "foo.csv", 0, "f")])
    assert [(r["tier"], round(r["score"], 6)) for r in both] == [("both", round(2 / 61, 6))]
    assert len(fused(spark, [("summary", i + 1, "a.csv", i, "s") for i in range(20)])) == 5
    twice = fused(spark, [("summary", 1, "foo.csv", 5, "first"), ("summary", 2, "foo.csv", 5, "second")])
    assert [(r["summary"], round(r["score"], 6)) for r in twice] == [("second", round(1 / 61 + 1 / 62, 6))]


def test_plans_widen_and_never_narrow(spark):
    asked = spark.createDataFrame([(1, "list all receipts"), (2, "what is the hamiltonian"), (3, "  "), (4, None)], "question_id bigint, question string")
    plan = lambda **k: {r["question_id"]: (r["top_k"], r["rerank"], r["fetch"]) for r in hybrid.planned(asked, **k).collect()}
    assert plan() == {1: (30, False, 30), 2: (5, False, 5), 3: (5, False, 5), 4: (5, False, 5)}
    assert plan(rerank=True)[1] == (30, False, 30) and plan(rerank=True)[2] == (5, True, 10) and plan(rerank=True, top_k=8)[2] == (8, True, 16)
    assert plan(local=True)[1] == (12, False, 12) and plan(top_k=50)[1][0] == 50 and plan(lists=False)[1][0] == 5


def test_rerank_orders_by_the_model_and_leaves_single_hits(spark):
    hits = spark.createDataFrame([(1, "a", 0.3, 1, "x0.1"), (1, "b", 0.2, 2, "x0.9"), (1, "c", 0.1, 3, "x0.5"), (2, "only", 0.7, 1, "x0.0"), (3, "0.8", 0.1, 1, ""), (3, "d", 0.05, 2, "x0.2")], "question_id bigint, path string, score double, rank int, t string")
    plan = spark.createDataFrame([(q, "q", 5, True) for q in (1, 2, 3)], "question_id bigint, question string, top_k int, rerank boolean")
    model = lambda q, text: F.regexp_extract(text, r"(\d\.\d)", 1).cast("double")
    got = [(r["question_id"], r["path"], r["score"]) for r in hybrid.reranked(hits, plan, F.col("t"), model).orderBy("question_id", "rank").collect()]
    assert got == [(1, "b", 0.9), (1, "c", 0.5), (1, "a", 0.1), (2, "only", 0.7), (3, "0.8", 0.8), (3, "d", 0.2)]


def test_many_queries_are_dealt_in_groups(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "vec_id bigint, embedding array<float>")
    few = sorted(map(tuple, search.dense(v, v.where("vec_id < 20"), 4).collect()))
    monkeypatch.setattr(search, "GROUP", 6)
    monkeypatch.setattr(search, "PART", 25)
    assert sorted(map(tuple, search.dense(v, v.where("vec_id < 20"), 4).collect())) == few and len(few) == 80
    docs = spark.createDataFrame([(i, f"apple{i % 5} pear plum{i % 2} " * (1 + i % 3)) for i in range(30)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, f"pear plum{i % 2} apple{i}") for i in range(6)] + [(9, ""), (10, None)], "item_id bigint, text string")
    one = sorted(map(tuple, search.bm25(docs, items, "doc_id", "item_id", 3).collect()))
    assert sorted(map(tuple, search.bm25(docs, items, "doc_id", "item_id", 3, most=2).collect())) == one and len(one) == 18


# ---- answers


def test_replies_are_repaired(spark):
    cases = [
        ('{"answer": "a", "sources_used": ["x"]}', ("a", ["x"])), ('```json\n{"answer": "a", "sources_used": []}\n```', ("a", [])), ('Sure: {"answer": "b", "sources_used": ["y"]} done', ("b", ["y"])), ('{"courses": ["p", "q"], "sources_used": ["x"]}', ("- p\n- q", ["x"])),
        ('{"result": "text", "sources_used": []}', ("text", [])), ('{"n": 3, "sources_used": []}', ("3", [])), ('{"a": 1, "b": 2, "sources_used": []}', ("none", [])), ('{"a": {"b": 1}, "sources_used": []}', ("none", [])), ("no json", ("none", [])), ('{"answer": "a"}', ("none", [])), (None, ("none", [])),
    ]
    frame = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string").select("i", answering.repaired_answer(F.col("raw"), "none").alias("a")).orderBy("i")
    assert [(r["a"]["answer"], r["a"]["sources_used"]) for r in frame.collect()] == [want for _, want in cases]


def test_paths_are_compared_loosely(spark):
    cases = {"/home/me/textbook.pdf  [book pp. 254-258 / PDF pp. 269-273]": "/home/me/textbook.pdf", "/path.pdf  [pages around §7.3]": "/path.pdf", "/home/me/101  mus/file.pdf  [book pp. 1-3]": "/home/me/101 mus/file.pdf", "/a%20b+c.txt": "/a b+c.txt", "/100%.txt": "/100%.txt"}
    got = spark.createDataFrame([(p,) for p in cases], "p string").select("p", answering.matching_path(F.col("p"))).collect()
    assert {r[0]: r[1] for r in got} == cases
    shown = spark.range(1).select(answering.source_path(F.lit("v.alt#scene:00:20")), answering.shown_path(F.lit("/r/a/b.txt#x"), "/r"), answering.shown_path(F.lit("/ra/b"), "/r")).first()
    assert tuple(shown) == ("v.alt", "a/b.txt", "/ra/b")


def test_words_of_models_are_coerced(spark):
    got = spark.range(1).select(answering.content_type(F.lit(" CSV ")), answering.content_type(F.lit("audio")), answering.names(F.array(F.lit("plain"), F.lit('{"name": " Club ", "type": "x"}'), F.lit('{"name": "", "value": "v"}'), F.lit('"quoted"'), F.lit("7")))).first()
    assert tuple(got) == ("csv", "other", ["plain", "Club", "v", "quoted", "7"])
    parts = spark.range(1).select(answering.highlighted(F.lit("The cat, concat and Cat a.b!"), F.array(F.lit("cat"), F.lit("a.b"), F.lit("")))).first()[0]
    assert [(p["text"], p["highlight"]) for p in parts] == [("The ", False), ("cat", True), (", concat and ", False), ("Cat", True), (" ", False), ("a.b", True), ("!", False)]
    assert spark.range(1).select(answering.highlighted(F.lit("x"), F.array().cast("array<string>"))).first()[0][0]["text"] == "x"


def test_telling_tokens_and_hits(spark):
    got = spark.range(1).select(T.telling_tokens(F.lit("what is the total amount on May 4 2026")), T.telling_tokens(F.lit("$170.45 R2NDSL")), T.telling_tokens(F.lit("what is the"))).first()
    assert tuple(got) == (["total", "amount", "May", "2026"], ["$170.45", "R2NDSL"], [])
    docs = spark.createDataFrame([("/a/f.txt", "x\n  total 5 \ny\ntotal 7"), ("/b", "none"), ("/c", "total\n" * 100), ("/d", None)], "path string, text string")
    asked = spark.createDataFrame([(1, "the total"), (2, "what is")], "question_id bigint, question string")
    hits = answering.line_hits(docs, asked, 7)
    assert sorted((r["path"], r["line_number"]) for r in hits.collect()) == [("/a/f.txt", 2), ("/a/f.txt", 4), *(("/c", i) for i in range(1, 8))]
    assert answering.hits_block(hits).where("path = '/a/f.txt'").first()["block"] == "Ripgrep hits from f.txt (line: content):\n  2: total 5\n  4: total 7"


def test_from_questions_to_cited_answers(spark):
    texts = {"/t.csv": ("id: 1 | name: apple", 1), "/big.log": ("fruit log of plums", None), "/note.md": ("pears and figs", None)}
    points = spark.createDataFrame([(k, p, c, [1.0, float(k)], t) for k, (p, (t, c)) in enumerate(texts.items())], "vec_id bigint, path string, chunk_index int, embedding array<float>, text string")
    asked = spark.createDataFrame([(1, "where are apple plums pears", "apple plums pears", [1.0, 0.0])], "question_id bigint, question string, search string, embedding array<float>")
    tables = table_of(spark, 4, "/t.csv")
    content = spark.createDataFrame([("/big.log", "nothing\nsome plums here"), ("/note.md", "pears and figs")], "path string, text string")
    known = spark.createDataFrame([("/big.log", ["T0"], None), ("/note.md", ["T1"], "  a note  ")], "path string, routes array<string>, summary string")
    seen = []

    def agent(prompts):
        return [json.dumps({"answer": p.count("--- File"), "sources_used": ["/note.md [p. 1]", "/made/up"]}).replace("3,", '"3",') for p in prompts]

    hits = hybrid.run_search(points, asked)
    assert hits.count() == 3
    wanted = hybrid.rows_of_hits(hits)
    blocks = {r["path"]: (r["kind"], r["block"]) for r in answering.file_blocks(wanted, tables, content, known, asked).collect()}
    assert {p: k for p, (k, _) in blocks.items()} == {"/t.csv": "row-windows", "/big.log": "line-hits", "/note.md": "content"}
    assert "1,r1" + rows.MARK in blocks["/t.csv"][1] and "2: some plums here" in blocks["/big.log"][1] and blocks["/note.md"][1].startswith("Content type: llm-summary") and blocks["/note.md"][1].endswith("pears and figs")
    prompt = answering.prompts(answering.file_blocks(wanted, tables, content, known, asked), asked).first()["prompt"]
    best = wanted.orderBy("rank").first()["path"]
    assert prompt.index(f"--- File 3: {best} ---") > prompt.index("--- File 1:") and prompt.endswith("Now answer this question: where are apple plums pears")
    got = asking.ask(points, asked, tables, content, known, agent).first()
    assert (got["answer"], got["sources"], got["dropped"]) == ("3", ["/note.md"], ["/made/up"]) and not seen
    failed = asking.ask(points, asked, tables, content, known, lambda prompts: 1 / 0).first()
    assert failed["answer"].startswith("The answer could not") and failed["sources"] == []


def test_rewriting_and_its_prompt(spark):
    history = F.array(F.struct(F.lit("q1").alias("q"), F.lit("a1").alias("a")))
    none = F.lit(None).cast("array<struct<q:string,a:string>>")
    got = spark.range(1).select(hybrid.rewritten(F.lit("q"), F.lit(""), F.array(F.lit("k"))), hybrid.rewritten(F.lit("q"), F.lit("r"), F.array().cast("array<string>")), hybrid.rewrite_prompt(F.lit("now"), history), hybrid.rewrite_prompt(F.lit("now"), none)).first()
    assert tuple(got) == ("q k", "r", "Previous conversation turns:\n[Turn 1] Q: q1\n[Turn 1] A: a1\n\nCurrent question: now", "now")


def test_pages_have_anchors_and_supplements_are_cut(spark):
    pages = spark.createDataFrame([("d", 3, "254\ntext"), ("d", 4, "no label here\nmore words\nand\nmore")], "path string, page int, text string")
    got = answering.page_blocks(pages, pages.select("path", "page"), routing.page_label(F.col("text"))).first()["block"]
    assert got == "## PDF page 4 (book p. 254)\n254\ntext\n\n## PDF page 5\nno label here\nmore words\nand\nmore"
    cut = spark.range(1).select(answering.supplement(F.lit(" " + "x" * 12), 10), answering.supplement(F.lit("  "), 10)).first()
    assert cut[0].endswith("\n---\n" + "x" * 10 + "\n…(supplement truncated)") and cut[1] is None


def test_failures_of_known_types_come_before_words_in_their_message(spark):
    cases = [("LlamaServerBinaryError", "/home/rate/collection", 503, "not set up"), ("LlamaServerCrashError", "429", 503, "not started"), ("ValueError", "Rate limit", 503, "busy"), ("ValueError", "qdrant is down", 503, "starting"), ("TimeoutError", "", 503, "network"), ("ValueError", None, 500, "unknown")]
    frame = spark.createDataFrame([c[:2] for c in cases], "name string, message string").select(routing.failure(F.col("name"), F.col("message")).alias("f"))
    assert [(r["f"]["status"], r["f"]["kind"]) for r in frame.collect()] == [c[2:] for c in cases]


# ---- readers


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, body in parts.items():
            book.writestr(name.replace("__", "/"), body)
    return out.getvalue()


BOOK = archive(**{
    "xl__workbook.xml": '<w xmlns:r="urn:r"><sheets><sheet name="Second" r:id="r2"/><sheet name="First" r:id="r1"/></sheets></w>',
    "xl___rels__workbook.xml.rels": '<R><Relationship Id="r1" Type="t/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="t/worksheet" Target="worksheets/sheet2.xml"/></R>',
    "xl__worksheets__sheet1.xml": "<s><row><c><v>1</v></c><c><v>2</v></c></row></s>", "xl__worksheets__sheet2.xml": "<s><row><c t='inlineStr'><is><t>x</t></is></c></row></s>",
})
PAGE = b"<html><header>top<nav>menu</nav>LEFT OVER</header>main <b>text</b> of the page</html>"
NOTES = json.dumps({"cells": [{"cell_type": "code", "source": ["import x\n", "y"]}, {"cell_type": "markdown", "source": " "}]}).encode()
WORDS = archive(**{"word__document.xml": "<d><p><t>One line</t></p><p><t>Two</t></p></d>", "word___rels__document.xml.rels": '<R><Relationship Id="a" Type="u/image" Target="m.png"/></R>'})
DECK = archive(**{"ppt__slides__slide1.xml": "<s><sp><p><t>Title</t></p></sp><pic/><pic/></s>"})
PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 64, 48)
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 900, 1200) + b"\x03"
GIF = b"GIF89a" + struct.pack("<HH", 5, 6)
WEBP = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")


@pytest.fixture(scope="module")
def contents(spark):
    found = {"/a/book.xlsx": BOOK, "/a/p.html": PAGE, "/a/n.ipynb": NOTES, "/a/w.docx": WORDS, "/a/d.pptx": DECK, "/a/i.png": PNG, "/a/j.jpg": JPEG, "/a/bad.docx": b"PK no", "/a/bad.ipynb": b"{", "/a/t.csv": b'h1,h2\r\n1,"a\r\nb"\r\n3,4', "/a/u.md": b"caf\xc3\xa9 words \xff end", "/a/.bashrc": b"alias ll='ls -l' # words", "/a/x.zzz": b"?", "/a/f.pdf": b"%PDF"}
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in found.items()], "path string, size bigint, content binary")


def test_peeks_of_all_kinds(contents):
    got = {r["path"][3:]: r for r in peeks.peeked(contents).collect()}
    of = lambda name, *cols: tuple(got[name][c] for c in cols)
    assert of("book.xlsx", "page_count", "peek_text", "text_density") == (2, "x\n1,2", 5)
    assert of("p.html", "page_count", "peek_text", "extractable") == (1, "main text of the page", True)
    assert of("n.ipynb", "page_count", "peek_text", "text_density") == (2, "import x\ny", 5)
    assert of("w.docx", "page_count", "image_ratio", "peek_text") == (1, 0.5, "One line\nTwo")
    assert of("d.pptx", "page_count", "image_ratio", "text_density") == (1, 2.0, 5)
    assert of("i.png", "width", "height", "extractable", "page_count") == (64, 48, False, 1) and of("j.jpg", "width", "height") == (1200, 900)
    assert of("t.csv", "row_count", "extractable") == (3, True) and of("u.md", "peek_text") == ("café words  end",)
    assert of(".bashrc", "ext", "extractable", "peek_error") == ("", True, None)
    assert all(got[n]["peek_error"] for n in ("bad.docx", "bad.ipynb", "x.zzz", "f.pdf")) and not got["w.docx"]["peek_error"]
    assert (peeks.image_size(GIF), peeks.image_size(WEBP), peeks.image_size(b"?")) == ((5, 6), (100, 50), None)


def test_texts_of_all_kinds(contents, spark):
    got = {r["path"][3:]: (r["text"], r["error"]) for r in extract.extracted(contents, lambda data: (["page one", "page two"], [(1, "Part"), (2, "Chapter")])).collect()}
    assert got["book.xlsx"] == ("## Sheet: Second\nx\n\n## Sheet: First\n1, 2", None) and got["p.html"] == ("main text of the page", None)
    assert got["f.pdf"] == ("## Table of Contents\n- Part\n  - Chapter\n\npage one\n\npage two", None) and got["x.zzz"] == (None, "unsupported")
    assert got["bad.docx"][1] and got["n.ipynb"][0].startswith("# Cell 1 (code)\nimport x\ny") and len(got) == 14
    broken = extract.extracted(contents.where("path like '%.pdf'"), lambda data: 1 / 0).first()
    assert broken["error"].startswith("ZeroDivisionError") and extract.extracted(contents.where("path like '%.pdf'")).first()["error"] == "no reader of this kind"


def test_damaged_archives_are_told(spark):
    torn = bytearray(archive(**{"word__document.xml": "<d><p><t>" + "x" * 5000 + "</t></p></d>"}))
    locked = bytearray(torn)
    locked[6] |= 1  # marked as encrypted
    at = locked.rindex(b"PK\x01\x02")
    locked[at + 8] |= 1
    for data in (locked, torn[:60], b""):
        assert office.extract("/a.docx", bytes(data))[1]


def test_pages_are_peeked_at_three_places(spark):
    pages = spark.createDataFrame([("d", i, f"page {i} words here") for i in range(10)] + [("e", 0, None)], "path string, page bigint, text string")
    got = {r["path"]: r for r in peeks.peeked_pages(pages).collect()}
    assert got["d"]["peek_text"] == "page 0 words here\npage 5 words here\npage 9 words here" and (got["d"]["page_count"], got["d"]["text_density"]) == (10, 17)
    assert (got["e"]["page_count"], got["e"]["extractable"]) == (1, False)


def test_discovery_below_a_hidden_folder_and_of_one_file(spark, tmp_path):
    root = tmp_path / ".hidden" / "root"
    for p in ("a.txt", "b/c.csv", ".git/x.txt", "b/.bashrc", "b/.secret"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x")
    names = lambda **k: sorted(r["path"].rpartition("/")[2] for r in files.discover(spark, str(root), **k).collect())
    assert names() == ["a.txt", "c.csv"] and names(data=False) == ["a.txt"]
    assert names(unlisted=True) == [".bashrc", "a.txt", "c.csv"] and len(names(hidden=True, unlisted=True)) == 5
    assert [r["ext"] for r in files.discover(spark, str(root / "a.txt")).collect()] == [".txt"]
    assert [r["ext"] for r in files.of_kinds(files.discover(spark, str(root)), ".csv").collect()] == [".csv"]


def test_tables_of_great_cells_and_of_latin_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1," + "x" * 200_000 + "\n")
    (tmp_path / "b.csv").write_bytes(b"id,v\n1,caf\xe9\n")
    got = {r["path"][-5:]: r for r in files.csv_rows(spark, str(tmp_path), latin=True).collect()}
    assert len(got["a.csv"]["fields"]["v"]) == 200_000 and got["b.csv"]["fields"]["v"] == "café" and not got["a.csv"]["error"]
    shown = {r["path"][-5:]: (r["n_rows"], r["text"]) for r in files.csv_preview(files.csv_rows(spark, str(tmp_path), latin=True), 1).collect()}
    assert shown["b.csv"] == (1, "id,v\n1,café")
    assert peeks.decoded(F.lit(bytearray(b"caf\xe9"))) is not None and spark.range(1).select(peeks.decoded(F.lit(bytearray(b"caf\xe9"))), files.head_text(F.lit(bytearray(b"ab\xffcd")))).first() == ("café", "abcd")


def test_documents_of_json_and_folders_configs(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"/a": {"size": 1, "more": 2}, "/b": {"size": 2}}))
    (tmp_path / "l.json").write_text(json.dumps([{"q": "x", "n": 1}, {"q": "y", "n": "bad"}]))
    assert sorted(map(tuple, files.json_entries(spark, str(tmp_path / "m.json"), "size:bigint").collect())) == [("/a", 1), ("/b", 2)]
    assert [tuple(r) for r in files.json_rows(spark, str(tmp_path / "l.json"), "q string, n bigint").collect()] == [("x", 1)]
    found = spark.createDataFrame([("/r/c.yaml", bytearray(b"accuracy: critical\nt4_budget_gb_override: 2\ninclude_dotfiles: true")), ("/r/s/c.yaml", bytearray(b": : bad"))], "path string, content binary")
    assert sorted(map(tuple, files.configs(found).collect())) == [("/r", "critical", None, 2.0, True), ("/r/s", None, None, None, False)]
    assert files.html_texts(spark.createDataFrame([("/e", bytearray(b"<script>x</script>"))], "path string, content binary")).first()["error"]


def test_summaries_round_trip(spark):
    said = answering.summary_markdown(F.lit("/a/b.pdf"), F.lit("Title"), F.lit("first\nsecond"), F.lit("pdf"), F.array(F.lit("x"), F.lit("y")), F.array().cast("array<string>"), F.array(F.lit("id")))
    got = files.parse_summaries(spark.range(1).select(said.alias("value"))).first()
    assert tuple(got) == ("/a/b.pdf", "Title", "first second", "pdf", ["x", "y"], [], ["id"])


def test_ingest_rewrites_only_parts_that_are_touched(spark, tmp_path):
    source, target, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    batches = [[(k, 1, "a") for k in range(40)], [(3, 2, "b")], [(3, 3, "c"), (99, 1, "new")]]
    written = []
    for batch in batches:
        spark.createDataFrame(batch, "k bigint, t bigint, v string").coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema("k bigint, t bigint, v string").parquet(source), target, "k", "t", at, parts=8).awaitTermination()
        written.append(len([p for p in (tmp_path / "out").glob("v*/part=*")]))
    got = {r["k"]: r["v"] for r in current(spark, target).collect()}
    assert got == {**{k: "a" for k in range(40)}, 3: "c", 99: "new"} and written[0] == 8 and written[1] == 9


# ---- sidecars, offerings, tiers, index

ALT = b"""
alt_version: 1
type: home_video
source: {filename: v.mp4, local_path: /v.mp4, file_hash_sha256: abc}
technical: {duration_human: 3 min}
recorded: {date: "2024-05-01"}
summary: {one_line: "A day.", full: "We walk."}
scenes:
  - {timecode: "00:20", description: A tree, mood: calm}
context: {place: Rome, n: 3}
themes: [b, a]
search_tokens: [a, c]
"""


def test_sidecars_give_a_summary_of_their_own_and_one_of_each_scene(spark):
    bad = {"/b.alt": b"alt_version: 1\nsource: {}\n", "/c.alt": b"- x", "/d.alt": b"alt_version: 1\nsource: {}\nsummary: {}\nscenes: [{timecode: 1}]", "/e.alt": b"\xff", "/f.alt": b"alt_version: 1\nsource: {}\nsummary: {}\nthemes: x"}
    frame = spark.createDataFrame([(p, bytearray(c)) for p, c in {"/a.alt": ALT, **bad}.items()], "path string, content binary")
    found = sidecars.parsed(frame)
    errors = {r["path"]: r["error"] for r in found.collect()}
    assert errors["/a.alt"] is None and "'summary'" in errors["/b.alt"] and "scenes[0].description" in errors["/d.alt"] and "'themes' must be a list" in errors["/f.alt"] and errors["/c.alt"] and errors["/e.alt"]
    got = {r["source"]: r for r in sidecars.summaries(found).collect()}
    assert set(got) == {"/a.alt", "/a.alt#scene:00:20"} and got["/a.alt#scene:00:20"]["kind"] == "s_00_20"
    whole = files.parse_summaries(spark.createDataFrame([(got["/a.alt"]["markdown"],)], "value string")).first()
    assert (whole["title"], whole["summary"], whole["keywords"], whole["entities"]) == ("A day", "A day. We walk. At 00:20: A tree.", ["a", "b", "c"], ["Rome", "v.mp4"])
    assert whole["identifiers"] == ["abc", "/v.mp4", "v.mp4", "2024-05-01", "3 min"]
    assert "At timecode 00:20: A tree Mood: calm Parent video: A day." in got["/a.alt#scene:00:20"]["markdown"]
    known = spark.createDataFrame([("/a.alt",), ("/a.alt#scene:00:99",), ("/gone.alt",), ("/x.pdf",)], "path string")
    assert sorted(r["path"] for r in sidecars.left_over(known, sidecars.summaries(found)).collect()) == ["/a.alt#scene:00:99", "/gone.alt"]


LISTING = (
    'x <div title="CSC 121-01 - Intro">CSC 121-01 - Intro</div><div>Open</div><div>Ada L</div><div>In-Person</div><div>22/24</div><div>Section Details</div><i data-automation-label="RM-1 | MWF | 8:30 AM - 9:20 AM"></i>'
    '<div>CSC 121-02 - Intro</div><div>Closed</div><div></div><div>Online</div><div>0/10</div>Section Details'
)


def test_offerings_of_a_listing(spark):
    found = offerings.sections(spark.createDataFrame([(1, LISTING)], "page_id bigint, html string"))
    got = [tuple(r)[2:] for r in found.orderBy("n").collect()]
    assert [(g[0], g[1], g[2], g[3], g[4], g[5]) for g in got] == [("CSC-121", "01", "Open", "Ada L", "In-Person", "22/24"), ("CSC-121", "02", "Closed", "TBA", "Online", "0/10")]
    line = offerings.offerings(found).first()["offering"]
    assert line == "Section 01: Professor Ada L, MWF 8:30 AM - 9:20 AM, RM-1 (Open 22/24) | Section 02: TBA, TBA (Closed 0/10)"
    courses = spark.createDataFrame([("CSC-121 ", "a"), ("X-1", "b")], "code string, t string")
    assert [r["fall_2026"] for r in offerings.enriched(courses, offerings.offerings(found), offerings.term_column("Fall 2026")).orderBy("t").collect()] == [line, "not offered"]
    assert offerings.by_category(courses, F.array(F.lit("A"), F.lit("B"))).count() == 4


def test_previews_and_contents_shared(spark):
    big = spark.createDataFrame([("/my_big-file.log", 3000, bytearray(b"words " * 500)), ("/t.csv", 9, bytearray(b"")), ("/e.log", 0, bytearray(b""))], "path string, size bigint, content binary")
    shown = spark.createDataFrame([("/t.csv", 7, "a,b\n1,2")], "path string, n_rows bigint, text string")
    got = {r["path"]: files.parse_summaries(spark.createDataFrame([(r["markdown"],)], "value string")).first() for r in tiers.previewed(big, shown).collect()}
    assert (got["/my_big-file.log"]["title"], got["/t.csv"]["title"], got["/t.csv"]["identifiers"]) == ("my big file — 2 KB preview", "t — CSV, 7 rows", ["t.csv", "7 rows", "9 bytes"])
    assert got["/e.log"]["summary"].startswith("(could not preview")
    calls = spark.createDataFrame([("/a", "h"), ("/b", "h"), ("/c", "g")], "path string, content_hash string")
    made = tiers.once_a_content(calls, lambda first: first.select("content_hash", F.col("path").alias("by")))
    assert sorted(map(tuple, made.select("path", "by").collect())) == [("/a", "/a"), ("/b", "/a"), ("/c", "/c")]
    stub = answering.summaries_or_stub(spark.createDataFrame([("/my_t.csv", 3, ["a"]), ("/u.csv", 1, ["b"])], "path string, n_rows bigint, columns array<string>"), spark.createDataFrame([("/u.csv", "T", "S")], "path string, title string, summary string"))
    assert sorted(map(tuple, stub.collect())) == [("/my_t.csv", "my t", "CSV with 3 rows and columns a"), ("/u.csv", "T", "S")]
    noted = tiers.table_markdown(spark.createDataFrame([("t.csv", "x")], "path string, markdown string"), table_of(spark, 27)).first()["markdown"]
    assert "**Rows:** 27" in noted and "**Columns (2):** id, name" in noted


def test_the_index_is_built_incrementally(spark):
    rows_ = table_of(spark, 3, "/t.csv")
    known = spark.createDataFrame([("/a.md", 1, "a.md", None), ("/t.csv", 1, "t.md", 3), ("/d.md", 1, "d.md", None)], "path string, size bigint, summary_file string, row_count bigint")
    known = M.mark(M.mark(spark.createDataFrame([], M.SCHEMA), known.withColumn("at", F.current_timestamp()), "summarized").drop("row_count").join(known.select("path", "row_count"), "path").select([c.split()[0] for c in M.SCHEMA.split(", ")]), spark.createDataFrame([("/d.md",)], "path string").withColumn("at", F.current_timestamp()), "ingested")
    none = F.array().cast("array<string>")
    said = spark.createDataFrame([("/a.md", "A", "about a"), ("/t.csv", "T", "a table"), ("/d.md", "D", "done")], "source string, title string, summary string").withColumns({"keywords": none, "entities": none, "identifiers": none})
    old = spark.createDataFrame([("stray", "/gone", None, "x", [0.0])], "point_id string, path string, chunk_index bigint, text string, dense array<float>")
    points, marked = index.incremental(old, known, said, rows_, F.current_timestamp())
    got = sorted((r["path"], r["chunk_index"] if r["chunk_index"] is not None else -1, r["text"]) for r in points.collect())
    assert got == [("/a.md", -1, "A about a"), ("/t.csv", -1, "T a table"), ("/t.csv", 0, "id: 0 | name: r0"), ("/t.csv", 1, "id: 1 | name: r1"), ("/t.csv", 2, "id: 2 | name: r2")]
    assert marked.where("ingested_at is null").count() == 0
    again, _ = index.incremental(points, marked, said, rows_, F.current_timestamp())
    assert sorted(r["point_id"] for r in again.collect()) == sorted(r["point_id"] for r in points.collect())
    kept, _ = index.incremental(old, known, said, rows_, F.current_timestamp(), sweep=False)
    assert kept.count() == 6 and {r["kind"]: r["n"] for r in index.drift(points, marked).collect()} == {"orphans": 0, "missing": 1, "waiting": 0}
    assert index.checked_size(points).select(F.size("dense")).distinct().first()[0] == index.SIZE
    with pytest.raises(Exception, match="vectors of 384, the model gives 5"):
        index.checked_size(points, 5).select("dense").collect()
    assert index.without(points, paths=spark.createDataFrame([("/a.md",)], "path string")).count() == 4
    assert [x.count() for x in index.rebuilt(points, marked, "/t.csv")] == [1, 2] and [x.count() for x in index.rebuilt(points, marked, "")] == [0, 0]
    assert spark.range(1).select(index.pooled(F.array(*(F.array(F.lit(float(k)), F.lit(1.0)) for k in range(3))), F.lit(2))).first()[0] == [[0.5, 1.0], [2.0, 1.0]]
    assert index.suggestion_sample(said, 1, 2, 5).count() == 2


def test_scores_of_answers(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "question_id bigint, expected string")
    hits = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (2, "b", 2)], "question_id bigint, path string, rank int")
    ranks = evaluation.hit_ranks(asked, hits)
    assert {r["question_id"]: r["hit_rank"] for r in ranks.collect()} == {1: 1, 2: 2, 3: None}
    got = evaluation.recall_at(ranks, 1, 5).first()
    assert (got["n"], got["hits_at_1"], got["hits_at_5"], got["mean_reciprocal_rank"]) == (3, 1, 2, 0.5)
    told = spark.createDataFrame([("easy", True, ["a"], ["a", "a"], ["d"]), ("easy", True, ["a", "b"], ["a", "d"], ["d"]), ("hard", False, ["a"], ["a"], [])], "difficulty string, ok boolean, expected array<string>, used array<string>, distractors array<string>")
    by = {r["difficulty"]: r for r in evaluation.by_difficulty(told).collect()}
    assert (by["easy"]["perfect"], by["easy"]["distractors_cited"], by["easy"]["recall"], by[None]["n"], by["hard"]["succeeded"]) == (1, 1, round(2 / 3, 6), 3, 0)
    assert evaluation.report(evaluation.by_difficulty(told).select("difficulty", "n"), "Scores").startswith("# Scores\n\n| difficulty | n |\n| --- | --- |\n| all | 3 |")
    assert spark.range(1).select(evaluation.cited_as(F.lit("d"), F.array(F.lit("a")), F.array(F.lit("d")))).first()[0] == "distractor"


def test_exchanges_and_layers(spark):
    log = spark.createDataFrame([(1, "request", 1, "q"), (1, "response", 3, "r"), (2, "request", 5, "s")], "request_id int, kind string, at bigint, body string")
    assert sorted(map(tuple, state.exchanges(log).collect()), key=str) == [(1, "q", "r", 2.0), (2, "s", None, None)]
    stock = [(1, "d", i) for i in range(20)]
    found = spark.createDataFrame([(f"f{i}", "stock", ".png") for _, _, i in stock] + [("x", "mix", ".png")] * 20 + [("y", "mix", ".pdf"), ("z", "stock/sub", ".pdf"), ("n", "stock", ".txt")], "path string, parent string, ext string")
    left = state.without_assets(found, (".png",), (".pdf",))
    assert left.where("parent = 'stock'").count() == 1 and left.count() == 23


def test_exchanges_at_one_time_go_by_their_order_whatever_the_order_of_rows(spark):
    rows = [(1, "request", 1, 0, "q"), (1, "response", 3, 1, "z"), (1, "response", 3, 2, "a"), (2, "request", 5, 3, "s"), (2, "response", None, 4, "t"), (2, "response", 6, 5, None), (2, "response", 7, 6, "u"), (3, "request", None, 7, "v")]
    log = "request_id int, kind string, at bigint, n int, body string"
    for own in (rows, rows[::-1]):
        got = state.exchanges(spark.createDataFrame(own, log).coalesce(1), "n").collect()
        assert sorted(map(tuple, got)) == [(1, "q", "z", 2.0), (2, "s", "u", 1.0)]
