"""Main text and its fall-backs; pages chosen for questions against a count page by page."""

import random

from gleaner.functions import html
from gleaner.operators import pages


def test_main_text_and_what_stands_in_for_it(spark):
    prose = "This is a paragraph with more than enough words to speak for all that stands around it."
    links = "".join(f"<li><a href='/{k}'>Menu entry {k}</a></li>" for k in range(20))
    found = {
        "article": (f"<html><head><title>T</title></head><body><div><ul>{links}</ul></div><h2>A &amp; B</h2><p>{prose}</p><p>Short.</p><p>{prose} <a href='x'>more</a></p><div><ul>{links}</ul></div><p>Imprint</p></body></html>", f"A & B\n{prose}\nShort.\n{prose} more", None),
        "scripts": ("<html><body><script>draw('<p>x</p>')</script><div id=root></div></body></html>", "<html><body><script>draw('<p>x</p>')</script><div id=root></div></body></html>", None),
        "only links": (f"<ul>{links}</ul>", f"<ul>{links}</ul>", None), "empty": ("", None, "html extracted empty text"), "blank": ("  ", None, "html extracted empty text"), "null": (None, None, "html extracted empty text"),
        "unclosed": (f"<p>{prose}<p>{prose}<nav><p>{prose}</p></nav>", f"{prose}\n{prose}", None), "long": (f"<p>{prose}</p>" * 3000, "\n".join([prose] * 3000), None),
        "links between": (f"<p>{prose}</p><p><a>one two three</a></p><p>{prose}</p>", f"{prose}\n{prose}", None),
    }
    df = spark.createDataFrame([(k, h, "clash") for k, (h, *_) in found.items()], "name string, html string, words string")
    got = {r["name"]: (r["text"], r["error"]) for r in html.main_text(df).collect()}
    assert got == {k: (t, e) for k, (_, t, e) in found.items()}
    assert html.main_text(df.where("false")).count() == 0


def book(spark, texts):
    return spark.createDataFrame([("b", k, t, "clash") for k, t in enumerate(texts, 1)], "doc string, page bigint, text string, hits string")


def ask(spark, *questions):
    return spark.createDataFrame([(q, "b", k) for q, k in questions], "question_id int, doc string, keywords array<string>")


CONTENTS = "\n".join(f"{k}.1 The Lever of it {k * 10}" for k in range(1, 9))


def test_pages_of_a_book(spark):
    texts = [f"page {k} of plain words" for k in range(1, 31)]
    texts[1], texts[9], texts[19] = CONTENTS, "254\nThe LEVER is a lever.\nend", "one lever"
    b = book(spark, texts)
    got = pages.chosen(b, ask(spark, (1, ["lever"]), (2, ["", "  "]), (3, ["absent"]), (4, ["PLAIN"])), top=2).orderBy("question_id", "page").collect()
    assert [(r["question_id"], r["page"], r["hits"]) for r in got] == [(1, 9, 0), (1, 10, 2), (1, 11, 0), (1, 19, 0), (1, 20, 1), (1, 21, 0), (4, 1, 1), (4, 2, 0), (4, 3, 1), (4, 4, 1)]
    assert got[1]["block"] == "## PDF page 10 (book p. 254)\n254\nThe LEVER is a lever.\nend" and got[0]["block"].startswith("## PDF page 9\npage 9")
    assert "The Lever" in got[7]["block"]  # beside a page that is read, contents are too
    one = pages.excerpts(pages.chosen(b, ask(spark, (1, ["lever"])), top=1, around=0)).collect()
    assert [(r["question_id"], r["doc"], r["text"]) for r in one] == [(1, "b", got[1]["block"])]
    few = pages.chosen(b, ask(spark, (1, ["lever"])), top=2, budget=60).orderBy("page").collect()
    assert [r["page"] for r in few] == [9, 10]  # the page that gets to the budget is the last
    assert pages.chosen(b.where("false"), ask(spark, (1, ["lever"]))).count() == pages.chosen(b, ask(spark, (2, [" "]))).count() == 0


def test_hits_equal_counts_word_by_word(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(pages, "MOST", 12)  # several automata
    texts = ["".join(rng.choices("abA ", k=rng.randint(0, 60))) for _ in range(40)] + [None]
    questions = [(q, ["".join(rng.choices("abB", k=rng.randint(1, 4))) for _ in range(5)]) for q in range(4)]
    got = {(r["question_id"], r["page"]): r["hits"] for r in pages.chosen(book(spark, texts), ask(spark, *questions), top=100, around=0, budget=1 << 30).collect()}
    want = {(q, p): n for q, keys in questions for p, t in enumerate(texts, 1) if (n := sum((t or "").lower().count(k.lower()) for k in keys))}
    assert got == want
