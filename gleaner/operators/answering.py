"""What an answer is made from, and what is kept of it: contents of files, prompts, cited sources, highlights."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import rows as R
from gleaner.operators import search
from gleaner.staging import written
from gleaner.workers import pieces, with_package

#: Lines of a line search, characters of a summary beside a file.
MOST_LINES, SUPPLEMENT = 30, 10_000

# The kinds of content that a model may name.
CONTENT_TYPES = ("image", "pdf", "docx", "xlsx", "csv", "text", "code", "markdown", "other")
NAME_KEYS = ("name", "value", "label", "text", "title", "id")

# What is worth a highlight in an answer.
HIGHLIGHTS = (
    r"[\$€£]\s?\d{1,6}(?:[.,]\d{2})?",
    r"\b[A-Z]{2,4}[- ]\d{3}(?:-\d{2}L?)?\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2}(?:,?\s+\d{2,4})?\b",
    r"\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?(?:\s+\d{2,4})?\b",
    r"\b\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)\b",
    r'"[^"]{2,50}"',
)

# How files are shown before they are opened.
PREVIEWS = {
    "image": (".png", ".jpg", ".jpeg", ".webp", ".gif"),
    "pdf": (".pdf",),
    "csv": (".csv",),
    "text": (".md", ".markdown", ".txt", ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".swift", ".kt", ".sh", ".sql", ".json", ".yaml", ".yml", ".toml"),
}


def line_hits(files: DataFrame, questions: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """question_id, path, line_number and line: the first lines of each file (path, text) that hold a telling token.

    Questions (question_id, question) are a stated set, of which each task gets at most search.GROUP; more are asked in
    parts. All their tokens make one automaton, run once over each line, so a text is read once for all questions of a part and
    only hits leave the task. A null text has no lines.
    """
    asked = questions.select("question_id", T.telling_tokens(F.col("question")).alias("tokens")).where(F.size("tokens") > 0)
    got, out = asked.collect(), None
    types = {"question_id": asked.schema["question_id"].dataType.simpleString(), "path": files.schema["path"].dataType.simpleString()}
    for begin in range(0, max(1, len(got)), search.GROUP):
        some = got[begin : begin + search.GROUP]
        of: dict[str, list[int]] = {}
        for k, r in enumerate(some):
            for token in r["tokens"]:
                of.setdefault(token, []).append(k)
        sent = files.sparkSession.sparkContext.broadcast(of)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            tokens = ahocorasick.Automaton()
            for token, asks in sent.value.items():
                tokens.add_word(token, asks)
            tokens.make_automaton()
            for batch in pieces(batches, "text"):
                row, question, number, lines = [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    told: dict[int, int] = {}
                    for n, line in enumerate((text or "").split("\n") if sent.value else (), 1):
                        for k in sorted({k for _, asks in tokens.iter(line) for k in asks if told.get(k, 0) < most}):
                            told[k] = told.get(k, 0) + 1
                            row.append(i)
                            question.append(k)
                            number.append(n)
                            lines.append(line)
                yield pa.RecordBatch.from_arrays([pa.array(question, pa.int32()), batch.column("path").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(lines, pa.string())], names=["q", "path", "line_number", "line"])

        found = with_package(files.select("path", "text")).mapInArrow(run, f"q int, path {types['path']}, line_number int, line string")
        names = files.sparkSession.createDataFrame([(k, r["question_id"]) for k, r in enumerate(some)], f"q int, question_id {types['question_id']}")
        found = found.join(F.broadcast(names), "q").select("question_id", "path", "line_number", "line")
        out = found if out is None else out.unionByName(found)
    return out


def hits_block(hits: DataFrame) -> DataFrame:
    """question_id, path and block: the hit lines of a file under its name."""
    line = F.concat(F.lit("  "), F.col("line_number").cast("string"), F.lit(": "), F.trim(F.col("line"), F.lit(" \t\r")))
    told = F.transform(F.array_sort(F.collect_list(F.struct("line_number", line.alias("t")))), lambda x: x["t"])
    head = F.concat(F.lit("Ripgrep hits from "), F.element_at(F.split("path", "/"), -1), F.lit(" (line: content):\n"))
    return hits.groupBy("question_id", "path").agg(F.array_join(told, "\n").alias("_b")).select("question_id", "path", F.concat(head, "_b").alias("block"))


def page_blocks(pages: DataFrame, chosen: DataFrame, label: Column) -> DataFrame:
    """path and block: chosen pages (path, page from 0) in order, each under its number and, if it has one, its printed number."""
    number = F.concat(F.lit("## PDF page "), (F.col("page") + 1).cast("string"), F.when(label.isNotNull(), F.concat(F.lit(" (book p. "), label, F.lit(")"))).otherwise(""))
    told = F.transform(F.array_sort(F.collect_list(F.struct("page", F.concat(number, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"])
    return pages.join(chosen.select("path", "page"), ["path", "page"]).groupBy("path").agg(F.array_join(told, "\n\n").alias("block"))


def supplement(summary: Column, most: int = SUPPLEMENT) -> Column:
    """A file's summary as it stands beside the file's own content, cut with a note; null where there is none."""
    body = F.trim(summary, F.lit(" \t\r\n"))
    head = F.lit("Content type: llm-summary (distilled overview of the file)\n\n---\n")
    return F.when(body != "", F.concat(head, F.left(body, F.lit(most)), F.when(F.length(body) > most, "\n…(supplement truncated)").otherwise("")))


def file_blocks(wanted: DataFrame, table_rows: DataFrame, contents: DataFrame, manifest: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, path, rank, kind and block: what a prompt shows of each file.

    wanted: question_id, path, rank, rows (hit rows of the table, or null). Tables show their hit rows with those
    around them, or else their first rows; files of the preview tier the lines that a question's tokens hit; other files
    their content (contents: path, text). Files that have nothing of the kind say so. A summary, if the manifest (path,
    routes, summary) has one, comes before.
    """
    is_table, has_rows = F.lower("path").endswith(".csv"), F.coalesce(F.size("rows"), F.lit(0)) > 0
    told = wanted.join(manifest.select("path", "routes", "summary"), "path", "left")
    previewed = F.coalesce(F.array_contains("routes", "T0"), F.lit(False))
    kind = F.when(is_table & has_rows, "row-windows").when(is_table, "sample").when(previewed, "line-hits").otherwise("content")
    told = written(told.withColumn("kind", kind), "wanted")
    keyed = F.concat_ws("\x00", F.col("question_id").cast("string"), "path")
    # each question has windows of its own: its id is part of the table's name here
    windows_of = told.where("kind = 'row-windows'").select(keyed.alias("k"), "path", F.explode("rows").alias("row_idx"))
    asked_rows = table_rows.join(windows_of.select("k", "path").distinct(), "path").drop("path").withColumnRenamed("k", "path")
    blocks = R.window_blocks(asked_rows, windows_of.select(F.col("k").alias("path"), "row_idx")).select(F.col("path").alias("k"), "block")
    sampled = R.sample_blocks(table_rows.join(told.where("kind = 'sample'").select("path").distinct(), "path", "left_semi"))
    asked = questions.join(told.where("kind = 'line-hits'").select("question_id").distinct(), "question_id", "left_semi")
    grepped = hits_block(line_hits(contents.join(told.where("kind = 'line-hits'").select("path").distinct(), "path", "left_semi"), asked))
    out = told.withColumn("k", keyed).join(blocks.select("k", F.col("block").alias("_w")), "k", "left").join(sampled.select("path", F.col("block").alias("_s")), "path", "left")
    out = out.join(grepped.select("question_id", "path", F.col("block").alias("_g")), ["question_id", "path"], "left").join(contents.select("path", F.col("text").alias("_t")), "path", "left")
    block = F.when(F.col("kind") == "row-windows", F.col("_w")).when(F.col("kind") == "sample", F.col("_s")).when(F.col("kind") == "line-hits", F.col("_g")).otherwise(F.col("_t"))
    body = F.concat(F.lit("Content type: "), "kind", F.lit("\n\n---\n"), F.coalesce(block, F.lit("(nothing to show)")))
    return out.select("question_id", "path", "rank", "kind", F.concat_ws("\n", supplement(F.col("summary")), body).alias("block"))


def prompts(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id and prompt: the question, its files from the last to the best, and the question again.

    The best file comes last, next to what is generated.
    """
    files = F.reverse(F.array_sort(F.collect_list(F.struct("rank", "path", "block"))))
    shown = F.transform(files, lambda x, i: F.concat(F.lit("\n--- File "), (i + 1).cast("string"), F.lit(": "), x["path"], F.lit(" ---\n"), x["block"]))
    told = blocks.groupBy("question_id").agg(F.array_join(shown, "\n").alias("_files"))
    every = F.when(T.question_class(F.col("question")) == "LIST_ALL", "\nENUMERATION MODE: include every file that fits.\n").otherwise("")
    return told.join(questions.select("question_id", "question"), "question_id").select("question_id", F.concat(F.lit("Current question: "), "question", F.lit("\n"), every, "_files", F.lit("\n\nNow answer this question: "), "question").alias("prompt"))


def prompt_parts(prompts_: DataFrame) -> DataFrame:
    """question_id, question and files (array of struct<path, text>) read back from prompts under `--- File n: path ---` heads.

    The question is what follows `Question:`, or else the first line that holds anything.
    """
    head = r"^\s*---\s*File\s+\d+:\s*(.+?)\s*---\s*$"
    lines = prompts_.select("question_id", F.posexplode(F.split("prompt", "\r?\n")).alias("pos", "line")).withColumn("_head", F.regexp_extract("line", head, 1))
    run = Window.partitionBy("question_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("part", F.count(F.when(F.col("_head") != "", 1)).over(run))
    ordered = F.array_sort(F.collect_list(F.when(F.col("_head") == "", F.struct("pos", "line"))))
    text = F.trim(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit(" \t\r\n"))
    asked = F.when(F.col("line").startswith("Question:") & (F.col("part") == 0), F.struct("pos", "line"))
    any_line = F.when((F.trim("line") != "") & (F.col("_head") == ""), F.struct("pos", "line"))
    parts = lines.groupBy("question_id", "part").agg(F.max("_head").alias("path"), text.alias("text"), F.max(asked).alias("a"), F.min(any_line).alias("b"))
    files = F.transform(F.array_sort(F.collect_list(F.when(F.col("part") > 0, F.struct("part", "path", "text")))), lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text")))
    said = F.trim(F.substring(F.max("a")["line"], 10, 1 << 20))
    return parts.groupBy("question_id").agg(F.coalesce(F.when(said != "", said), F.trim(F.min("b")["line"]), F.lit("")).alias("question"), files.alias("files"))


def source_path(path: Column) -> Column:
    """A path without what follows a `#`."""
    return F.split_part(path, F.lit("#"), F.lit(1))


def shown_path(path: Column, root: str) -> Column:
    """A path from the root on, where it lies below it."""
    plain, head = source_path(path), root.rstrip("/") + "/"
    return F.when(plain.startswith(head), F.substring(plain, len(head) + 1, 1 << 20)).otherwise(plain)


def matching_path(path: Column) -> Column:
    """A path as it is compared: percent codes read (all or none of them), a bracket at its end and double blanks gone."""
    read = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.trim(F.regexp_replace(F.regexp_replace(read, r"\s*\[[^\]]*\]\s*$", ""), r"\s+", " "))


def kept_sources(answers: DataFrame, files: DataFrame) -> DataFrame:
    """question_id, sources (the cited files that the question was given, as they are written there, in order) and dropped.

    answers: question_id, not_found, sources_used. files: question_id, path. An answer that was not found has no sources.
    """
    cited = answers.select("question_id", F.posexplode(F.when(F.coalesce("not_found", F.lit(False)), F.array().cast("array<string>")).otherwise(F.col("sources_used"))).alias("pos", "cited"))
    cited = cited.withColumn("_key", matching_path(F.col("cited")))
    given = files.select("question_id", "path", matching_path(F.col("path")).alias("_key")).groupBy("question_id", "_key").agg(F.min("path").alias("path"))
    exact = files.select("question_id", F.col("path").alias("cited"), F.lit(True).alias("_same")).distinct()
    told = cited.join(given, ["question_id", "_key"], "left").join(exact, ["question_id", "cited"], "left").withColumn("path", F.when(F.col("_same"), F.col("cited")).otherwise(F.col("path")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("pos", c.alias("x"))))), lambda s: s["x"])
    found = told.groupBy("question_id").agg(in_order(F.col("path")).alias("sources"), in_order(F.when(F.col("path").isNull(), F.col("cited"))).alias("dropped"))
    none = F.array().cast("array<string>")
    return answers.select("question_id").join(found, "question_id", "left").select("question_id", F.coalesce("sources", none).alias("sources"), F.coalesce("dropped", none).alias("dropped"))


def repaired_answer(raw: Column, fallback: str | None = None) -> Column:
    """struct<answer, sources_used> of a reply: itself, without its fence, its outermost braces, or with its one other
    field for the answer; else the fallback answer without sources, or null."""
    schema = "answer string, sources_used array<string>"
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw, F.lit(" \t\r\n")), r"(?i)^\s*```(?:json)?\s*\n?", ""), r"\n?\s*```\s*$", "")
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)

    def read(text: Column) -> Column:
        parsed = F.from_json(text, "answer string, sources_used array<string>, not_found boolean")
        keys = F.json_object_keys(F.when(F.try_parse_json(text).isNotNull(), text))
        is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.answer", "variant")) == "STRING"
        fits = F.array_contains(keys, "answer") & is_text & parsed["sources_used"].isNotNull()
        return F.when(fits, F.struct(parsed["answer"].alias("answer"), parsed["sources_used"].alias("sources_used")))

    fields = F.from_json(F.when(F.try_parse_json(braces).isNotNull(), braces), "map<string,string>")
    others = F.filter(F.map_keys(fields), lambda k: k != "sources_used")
    value = F.try_element_at(fields, F.get(others, F.lit(0)))
    listed = F.from_json(value, "array<string>")
    bullets = F.array_join(F.transform(listed, lambda x: F.concat(F.lit("- "), x)), "\n")
    sources = F.from_json(braces, "sources_used array<string>")["sources_used"]
    rescued = (F.size(others) == 1) & F.map_contains_key(fields, F.lit("sources_used")) & sources.isNotNull() & value.isNotNull() & ~F.ltrim(value).startswith("{")
    drift = F.when(rescued, F.struct(F.when(F.ltrim(value).startswith("["), F.coalesce(bullets, value)).otherwise(value).alias("answer"), sources.alias("sources_used")))
    last = F.lit(None).cast(f"struct<{schema.replace(' ', ':').replace(',:', ',')}>") if fallback is None else F.struct(F.lit(fallback).alias("answer"), F.array().cast("array<string>").alias("sources_used"))
    return F.coalesce(read(raw), read(bare), read(braces), drift, last)


def content_type(said: Column) -> Column:
    """A model's word for a kind of content, in lower case; `other` for what is none."""
    low = F.trim(F.lower(said))
    return F.when(said.isNotNull(), F.when(low.isin(*CONTENT_TYPES), low).otherwise("other"))


def names(items: Column) -> Column:
    """Texts of a list (array of JSON values) that a model filled: texts as they are, of objects the first field that
    names them, anything else as it is written."""

    def name(x: Column) -> Column:
        v = F.try_parse_json(x)
        field = lambda k: F.trim(F.try_variant_get(v, f"$.{k}", "string"))
        found = F.coalesce(*(F.when(field(k) != "", field(k)) for k in NAME_KEYS), x)
        return F.when(F.ltrim(x).startswith("{"), found).when(F.ltrim(x).startswith('"'), F.try_variant_get(v, "$", "string")).otherwise(x)

    return F.transform(items, name)


def highlights(answer: Column) -> Column:
    """What is worth a highlight in an answer, each once."""
    found = [F.transform(F.regexp_extract_all(answer, F.lit(p), F.lit(0)), lambda x: F.trim(x)) for p in HIGHLIGHTS]
    return F.array_distinct(F.concat(*found))


def highlighted(text: Column, tokens: Column, begin: str = "\x02", end: str = "\x03") -> Column:
    """The text in parts, struct<text, highlight>, cut at the tokens, whatever their case, longer ones first.

    Tokens of word characters only match as whole words. The two signs must not be in the text.
    """
    ordered = F.array_sort(F.array_distinct(F.filter(tokens, lambda t: F.coalesce(t, F.lit("")) != "")), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    safe = lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    either = F.array_join(F.transform(ordered, lambda t: F.when(t.rlike(r"^\w[\w-]*$"), F.concat(F.lit("\\b"), safe(t), F.lit("\\b"))).otherwise(safe(t))), "|")
    marked = F.when(F.size(ordered) > 0, F.regexp_replace(text, F.concat(F.lit("(?i)("), either, F.lit(")")), F.lit(f"{begin}$1{end}"))).otherwise(text)
    pieces = F.filter(F.split(marked, f"(?={begin})|(?<={end})"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(F.translate(x, begin + end, "").alias("text"), x.startswith(begin).alias("highlight")))


def summary_markdown(source: Column, title: Column, body: Column, kind: Column, keywords: Column, entities: Column, identifiers: Column) -> Column:
    """A summary as it is stored, lists without members as a dash."""
    listed = lambda x: F.when(F.coalesce(F.size(x), F.lit(0)) > 0, F.array_join(x, ", ")).otherwise("—")
    parts = [("Source: ", source), ("\n\n# ", title), ("\n\n", body), ("\n\n**Content type:** ", kind), ("\n\n**Keywords:** ", listed(keywords)), ("\n\n**Key entities:** ", listed(entities)), ("\n\n**Identifiers:** ", listed(identifiers))]
    return F.concat(*(x for head, value in parts for x in (F.lit(head), F.coalesce(value, F.lit("")))), F.lit("\n"))


def preview_kind(path: Column) -> Column:
    """How a file is shown."""
    ext, out = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)), None
    for kind, exts in PREVIEWS.items():
        out = F.when(ext.isin(*exts), kind) if out is None else out.when(ext.isin(*exts), kind)
    return out.otherwise("unsupported")


def summaries_or_stub(files: DataFrame, replies: DataFrame) -> DataFrame:
    """path, title and summary: what a model said of a table, or, where it failed, a stub of name, rows and columns.

    files: path, n_rows, columns (array). replies: path, title, summary; null or empty where the model failed.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    stub = F.concat(F.lit("CSV with "), F.col("n_rows").cast("string"), F.lit(" rows and columns "), F.array_join("columns", ", "))
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return files.join(replies, "path", "left").select("path", F.coalesce(full("title"), T.title(stem)).alias("title"), F.coalesce(full("summary"), stub).alias("summary"))
