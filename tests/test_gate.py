import re
import zipfile

import pytest
from gleaner.functions import answers
from gleaner.operators import gate
from gleaner.sources import office, sinks
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("line", "path", "fits"),
    [
        ("*.pyc", "a/b.pyc", True), ("*.pyc", "b.pyc/x", True), ("*.pyc", "b.pyco", False), ("/x", "x/y", True), ("/x", "a/x", False), ("a/b", "a/b", True), ("a/b", "c/a/b", False),
        ("build/", "build/x", True), ("build/", "build", False), ("build/", "a/build/x", True), ("**/d", "q/d", True), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("a/**", "a/b", True), ("a/**", "a", False),
        ("f?o", "foo", True), ("f?o", "f/o", False), ("[ab].x", "b.x", True), ("[!ab].x", "b.x", False), ("*.{a,b}", "x.{a,b}", True), ("*.{a,b}", "x.a", False), (r"\#x", "#x", True),
    ],
)
def test_ignore_lines(line, path, fits):
    assert bool(re.search(gate.glob_regex(line)[0].replace(r"\z", r"\Z"), path)) == fits


def test_the_last_line_that_fits_decides(spark):
    rows = spark.createDataFrame([("a.log",), ("keep.log",), ("x",)], "p string")
    got = rows.select(gate.ignored(F.col("p"), ("# all logs", "*.log", "!keep.log"))).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_reasons_come_in_order(spark):
    rules = gate.Rules(roots=(gate.Root("/r"), gate.Root("/r/deep", include=("*.log",))), files=("/r/x/a.log",), excluded=("/r/x",), dirs=("r",), extensions=(".log",), max_mb=1)
    cases = {"/r/x/a.log": "explicitly included file: /r/x/a.log", "/r/x/b": "explicitly excluded: /r/x", "/rx/b": "not under any included folder", "/r/r/b": "default exclude: dir 'r'",
             "/r/a.log": "default exclude: extension '.log'", "/r/deep/a.log": "folder rule include in /r/deep", "/r/.b": "hidden file", "/r/big": "exceeds max file size", "/r/b": "ok", None: "not under any included folder"}
    rows = spark.createDataFrame([(p, 2_000_000 if p == "/r/big" else 5) for p in cases], "path string, size bigint")
    assert {r[0]: r[1] for r in rows.select("path", gate.reason(F.col("path"), F.col("size"), rules)).collect()} == cases


def test_the_deepest_rule_file_speaks(spark):
    lines = spark.createDataFrame([("/r", ".ignore", 0, "*.md"), ("/r/a", ".ignore", 0, "*.md"), ("/r/a", ".keep", 0, "x.md"), ("/", ".ignore", 0, "*")], "dir string, kind string, pos int, line string")
    files = spark.createDataFrame([(f"/r/{p}", "/r") for p in ("x.md", "a/x.md", "a/b/y.md", "z")], "path string, root string")
    got = {r[0]: r[1] for r in gate.inline_verdicts(files, lines, ((".keep", True), (".ignore", False))).collect()}
    assert got == {"/r/x.md": "excluded by .ignore in /r", "/r/a/x.md": "included by .keep in /r/a", "/r/a/b/y.md": "excluded by .ignore in /r/a"}


def _zip(path, **parts):
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)


def test_office_documents(spark, tmp_path):
    w, a = 'xmlns:w="w"', 'xmlns:a="a"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    _zip(tmp_path / "a.docx", **{"word/document.xml": f"<w:d {w}>{p('one')}<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>{p('two')}</w:d>"})
    slide = lambda t: f"<s {a}><a:p><a:r><a:t>{t}</a:t></a:r></a:p></s>"
    _zip(tmp_path / "b.pptx", **{"ppt/slides/slide10.xml": slide("last"), "ppt/slides/slide2.xml": slide("first"), "ppt/notesSlides/notesSlide2.xml": slide("said")})
    sheet = '<w><row><c t="s"><v>1</v></c><c><v>5</v></c></row><row><c/></row><row><c t="inlineStr"><is><t>in</t></is></c></row></w>'
    _zip(tmp_path / "c.xlsx", **{"xl/workbook.xml": '<w><sheet name="S"/></w>', "xl/sharedStrings.xml": "<s><si><t>p</t></si><si><t>q</t></si></s>", "xl/worksheets/sheet1.xml": sheet})
    (tmp_path / "d.docx").write_bytes(b"no zip")
    got = {r["path"].rpartition("/")[2]: (r["text"], r["error"] is None) for r in office.read(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("one\ntwo\nx\ty", True), "b.pptx": ("## Slide 1\nfirst\n[notes] said\n\n## Slide 2\nlast", True), "c.xlsx": ("## Sheet: S\nq, 5\nin", True), "d.docx": (None, False)}


def test_snapshots_do_not_lose_a_full_one_to_an_empty_one(spark, tmp_path):
    target, full = str(tmp_path / "s"), spark.range(3)
    assert sinks.restore(spark, target) == {}
    assert sinks.snapshot(spark, {"t": full}, target)
    assert not sinks.snapshot(spark, {"t": full.limit(0)}, target)
    assert sinks.restore(spark, target)["t"].count() == 3
    assert sinks.snapshot(spark, {"t": full.limit(0)}, target, force=True)
    assert sinks.restore(spark, target)["t"].count() == 0


def test_files_by_key_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "x" * 30), ("b", 1, "y"), ("a", 1, None)], "k string, n int, t string")
    sinks.write_by(rows, "k", "n", str(tmp_path / "by"))
    assert sorted((r["k"], r["n"]) for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "by")).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    for _ in range(2):
        sinks.append_log(rows, str(tmp_path / "log"), limit=10)
    got = [r["t"] for r in spark.read.json(str(tmp_path / "log")).where("n = 2").collect()]
    assert got == ["xxxxx\n... [20 characters left out] ...\nxxxxx"] * 2


def test_replies(spark):
    raw = ['{"a": 1}', 'Sure:\n```json\n{"a": 2}\n```', 'so {"a": 3} it is', "none", None, "[1]"]
    frame = spark.createDataFrame([(x,) for x in raw], "r string")
    assert [r[0] and r[0]["a"] for r in frame.select(answers.repaired(F.col("r"), "a int")).collect()] == [1, 2, 3, None, None, None]
    one = spark.createDataFrame([("[2] and [1], [9], [2]", 3, "<t>hm</t> yes", "BIO (AB) CS(x)", "see (AB) (AB)")], "a string, n int, t string, c string, d string")
    cited = answers.citations(F.col("a"), F.col("n"))
    got = one.select(cited["cited"], cited["orphans"], answers.after_thinking(F.col("t"), "</t>"), answers.category_codes(F.col("c")), answers.category_codes(F.col("d"))).first()
    assert list(got) == [[2, 1], [9], "yes", ["BIO", "CS"], ["AB"]]
