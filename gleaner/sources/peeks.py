"""Peeks: what routing needs to know of files, from their first part or their structure.

Texts, tables, pages and notebooks are peeked at with column expressions; archives and images by a small helper, which
gets the contents of those kinds only. PDFs come as a table of pages, from whatever reader there is.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.router import kind_of
from gleaner.sources import office
from gleaner.workers import with_package

#: Bytes read of a text, characters kept of any peek.
HEAD, KEPT = 10_000, 5000
PROBED = "page_count bigint, text string, image_ratio double, width bigint, height bigint, error string"


def lossy(content: Column) -> Column:
    """Bytes as UTF-8 text without what is none."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, or as Latin-1 where they are none."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a PNG, GIF, JPEG or WebP file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        wide, high = struct.unpack("<HH", data[26:30])
        return wide & 0x3FFF, high & 0x3FFF
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:  # padding
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            high, wide = struct.unpack(">HH", data[at + 5 : at + 9])
            return wide, high
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _archive(kind: str, content: bytes) -> tuple:
    """page_count, text, image_ratio of an office document."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        if kind == "docx":
            lines, images = office.paragraphs(book), office.related_images(book, "word/_rels/document.xml.rels")
            return max(len(lines) // 30, 1), "\n".join(lines), images / len(lines) if lines else float(images > 0)
        if kind == "xlsx":
            seen, lines, size = 0, [], 0
            for _, rows in office.sheet_rows(book):
                seen += 1
                for row in rows:
                    if any(row):
                        lines.append(",".join(row))
                        size += len(lines[-1])
                    if size >= KEPT:
                        break
                if size >= KEPT:
                    break
            return seen, "\n".join(lines), 0.0
        slides = office.slide_shapes(book)
        texts, images = [t for s in slides for t in s.texts], sum(s.images for s in slides)
        return len(slides), "\n".join(texts), images / len(texts) if texts else float(images > 0)


def probe(kind: str | None, content: bytes | None) -> tuple:
    """The fields of PROBED for an archive or an image; errors are told, never raised."""
    if content is None:
        return (None,) * 6
    if kind == "image":
        size = image_size(content)
        return (1, "", 1.0, *(size or (None, None)), None if size else "image open failed: unknown head")
    try:
        pages, text, ratio = _archive(kind, content)
        return pages, text[:KEPT], ratio, None, None, None
    except office.BROKEN as e:
        return 0, "", 0.0, None, None, f"{kind} open failed: {type(e).__name__}: {e}"


def probed(kind: Column, content: Column) -> Column:
    """``probe`` of each file, in batches."""

    @F.pandas_udf(PROBED)
    def run(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in PROBED.split(", ")]
        found = pd.DataFrame([probe(k, None if c is None else bytes(c)) for k, c in zip(kinds, contents)], columns=names)
        return found.astype({"page_count": "Int64", "width": "Int64", "height": "Int64", "image_ratio": "float64"})

    return run(kind, content)


def cells(content: Column) -> Column:
    """The sources of a notebook's cells, whether a text or a list of lines; null for what is no notebook."""
    parsed = F.from_json(lossy(content), "cells array<struct<source string>>")["cells"]
    return F.transform(parsed, lambda c: F.coalesce(F.array_join(F.from_json(c["source"], "array<string>"), ""), c["source"]))


def peeked(files: DataFrame) -> DataFrame:
    """A peek of each file (path, size, content); PDFs have an error unless ``peeked_pages`` gives theirs."""
    files = with_package(files)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    out = files.select("path", name.alias("name"), ext.alias("ext"), F.col("size").alias("size_bytes"), "content").withColumn("kind", kind_of(F.col("ext"), F.col("name")))
    kind, content = F.col("kind"), F.col("content")
    whole = F.regexp_replace(lossy(content), "\r\n?", "\n")
    lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + F.when((whole != "") & ~whole.endswith("\n"), 1).otherwise(0)
    out = out.withColumn("p", probed(kind, F.when(kind.isin("docx", "xlsx", "pptx", "image"), content)))
    out = out.withColumn("head", F.when(kind.isin("text", "code", "config", "dotfile"), lossy(F.substring(content, 1, HEAD))))
    out = out.withColumn("cells", F.when(kind == "ipynb", cells(content)))
    told = F.array_join(F.filter("cells", lambda c: F.trim(c) != ""), "\n")
    out = out.withColumn("text", F.coalesce("head", F.when(kind == "csv", whole).when(kind == "html", T.plain_html(lossy(content))).when(kind == "ipynb", told), "p.text", F.lit("")))
    out = out.withColumn("peek_text", F.left("text", F.lit(KEPT)))
    pages = F.when(kind == "html", 1).when(kind == "ipynb", F.coalesce(F.size("cells"), F.lit(0))).otherwise(F.coalesce("p.page_count", F.lit(0)))
    size = F.length("peek_text")
    density = F.when(kind.isin("pptx", "ipynb"), F.floor(size / F.greatest(pages, F.lit(1)))).otherwise(size)
    error = (
        F.when(kind.isNull(), F.concat(F.lit("unsupported extension: "), F.when(F.col("ext") != "", F.col("ext")).otherwise("(none)")))
        .when(kind == "pdf", "no reader of this kind").when((kind == "ipynb") & F.col("cells").isNull(), "ipynb is not valid JSON").otherwise(F.col("p.error"))
    )
    return out.select(
        "path", "name", "ext", "size_bytes", pages.cast("bigint").alias("page_count"), density.cast("bigint").alias("text_density"),
        F.when(kind == "csv", F.col("peek_text") != "").when(kind == "image", False).otherwise(T.extractable(F.when(F.col("head").isNotNull(), F.col("head")).otherwise(F.col("peek_text")))).alias("extractable"),
        F.coalesce("p.image_ratio", F.lit(0.0)).alias("image_ratio"), F.when(kind == "csv", F.greatest(lines - 1, F.lit(0))).cast("bigint").alias("row_count"),
        F.col("p.width").alias("width"), F.col("p.height").alias("height"), "peek_text", error.alias("peek_error"),
    )


def peeked_pages(pages: DataFrame) -> DataFrame:
    """path, page_count, text_density, extractable and peek_text of documents given as pages (path, page from 0, text).

    The first, the middle and the last page are looked at, or all of three and fewer. Pages must be complete.
    """
    counts = pages.groupBy("path").agg(F.count("*").alias("page_count"))
    n, page = F.col("page_count"), F.col("page")
    looked = pages.join(counts, "path").where((n <= 3) | page.isin(0) | (page == F.floor(n / 2)) | (page == n - 1))
    text = F.coalesce("text", F.lit(""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", text.alias("t")))), lambda x: x["t"])
    found = looked.groupBy("path", "page_count").agg(F.floor(F.sum(F.length(text)) / F.count("*")).alias("text_density"), F.left(F.array_join(ordered, "\n"), F.lit(KEPT)).alias("peek_text"))
    return found.select("path", "page_count", "text_density", T.extractable(F.col("peek_text")).alias("extractable"), "peek_text")


Parser = Callable[[bytes], tuple[list[str], list[tuple[int, str]]]]


def document_pages(files: DataFrame, parser: Parser) -> DataFrame:
    """path, page (from 0, -1: the file itself), text, toc (of the file: lines by level) and error, by a reader that is given.

    parser: the texts of a document's pages, and the levels (from 1) and titles of its bookmarks. Its errors are told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    texts, marks = parser(content.as_py() or b"")
                    rows = [(path, -1, None, "\n".join(["## Table of Contents", *("  " * max(level - 1, 0) + f"- {title}" for level, title in marks)]) if marks else "", None)]
                    rows += [(path, k, t, None, None) for k, t in enumerate(texts)]
                except Exception as e:  # noqa: BLE001  a reader that is given may fail in any way; the row tells how
                    rows = [(path, -1, None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["path", "page", "text", "toc", "error"])

    return with_package(files.select("path", "content")).mapInArrow(run, "path string, page bigint, text string, toc string, error string")


def document_text(pages: DataFrame, most: int) -> DataFrame:
    """path and text of ``document_pages``: the bookmarks, then pages in order until there are ``most`` characters."""
    part = F.coalesce(F.when(F.col("page") < 0, F.col("toc")).otherwise(F.col("text")), F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("page", F.left(part, F.lit(most)).alias("t"))))
    kept = F.filter(F.transform(ordered, lambda x: x["t"]), lambda t: t != "")
    return pages.where("error is null").groupBy("path").agg(F.left(F.array_join(kept, "\n\n"), F.lit(most)).alias("text"))
