"""The main text of web pages: blocks between block tags, weighed by their words and links; the best run of them is the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T

#: Parts without text to read, and tags that end a block.
SILENT = ("script", "style", "noscript", "template", "nav", "header", "footer", "aside", "title", "form")
BLOCKS = "p|div|li|ul|ol|dl|dt|dd|table|thead|tbody|tr|td|th|h[1-6]|section|article|main|blockquote|pre|br|hr|html|head|body|figure|figcaption"
#: Words from which a block without links speaks for the text around it, and the share of a block's words that links may be.
WORDS, LINKS = 10, 3
#: What a short block counts against the text around it, at most.
SHORT = 3


def _words(text: Column) -> Column:
    """Number of words of a folded text."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def main_text(pages: DataFrame, html: str = "html", text: str = "text", error: str = "error") -> DataFrame:
    """Adds the main text of each page, and an error where there is none.

    A block counts its words less WORDS (and not below -SHORT), a heading its words, and one of which over a LINKS-th is links
    its words less than nothing; the text is the run of blocks with the greatest sum (the first, and its shortest), without blocks of links. A page without such
    a run gives all its blocks but those of links, one without these its html as it is; without anything in that, an error and a null text. A null page is an empty one.
    """
    t = F.coalesce(F.col(html).cast("string"), F.lit(""))
    for tag in SILENT:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = F.regexp_replace(F.translate(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), "\x01\x02", ""), r"(?i)<h[1-6]\b[^>]*>", "\x01\x02")
    cut = F.split(F.regexp_replace(t, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\x01"), "\x01")
    out = pages.withColumn("_blocks", F.transform(cut, lambda raw: F.struct(
        T.without_tags(F.translate(raw, "\x02", " ")).alias("text"), raw.startswith("\x02").alias("heading"),
        _words(T.without_tags(F.array_join(F.regexp_extract_all(raw, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), " "))).alias("links"),
    )))
    weigh = lambda b: F.when(b["words"] == 0, 0).when(b["links"] * LINKS > b["words"], -b["words"]).when(b["heading"], b["words"]).otherwise(F.greatest(b["words"] - WORDS, F.lit(-SHORT)))
    out = out.withColumn("_blocks", F.transform("_blocks", lambda b: b.withField("words", _words(b["text"]))))
    out = out.withColumn("_blocks", F.filter(F.transform("_blocks", lambda b: b.withField("score", weigh(b))), lambda b: b["words"] > 0))
    n = lambda x: F.lit(x).cast("int")
    zero = F.struct(n(0).alias("best"), n(0).alias("begin"), n(-1).alias("end"), n(0).alias("run"), n(0).alias("start"), n(0).alias("at"))

    def step(s: Column, b: Column) -> Column:
        on = s["run"] > 0
        run, start = F.when(on, s["run"] + b["score"]).otherwise(b["score"]), F.when(on, s["start"]).otherwise(s["at"])
        better = run > s["best"]
        pick = lambda now, c: F.when(better, now).otherwise(s[c]).alias(c)
        return F.struct(pick(run, "best"), pick(start, "begin"), pick(s["at"], "end"), run.alias("run"), start.alias("start"), (s["at"] + 1).alias("at"))

    out = out.withColumn("_run", F.aggregate("_blocks", zero, step))
    near = F.when(F.col("_run.best") > 0, F.slice("_blocks", F.col("_run.begin") + 1, F.col("_run.end") - F.col("_run.begin") + 1)).otherwise(F.col("_blocks"))
    chosen = F.filter(near, lambda b: b["links"] * LINKS <= b["words"])
    found = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    raw = F.trim(F.coalesce(F.col(html).cast("string"), F.lit("")))
    out = out.withColumn(text, F.nullif(F.when(found != "", found).otherwise(raw), F.lit("")))
    return out.withColumn(error, F.when(F.col(text).isNull(), "html extracted empty text")).drop("_blocks", "_run")
