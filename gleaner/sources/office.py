"""Readers of office documents: texts, slides and sheets, one row per file."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.workers import with_package

Element = ElementTree.Element
#: What a damaged, encrypted or foreign archive may raise.
BROKEN = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, KeyError, IndexError, ValueError, ElementTree.ParseError)


def _named(node: Element, name: str) -> list[Element]:
    """Descendants of the name, whatever their namespace, in order."""
    return [x for x in node.iter() if x.tag.rpartition("}")[2] == name]


def _text(node: Element) -> str:
    return "".join(x.text or "" for x in _named(node, "t"))


def _part(book: zipfile.ZipFile, name: str) -> Element:
    return ElementTree.fromstring(book.read(name))


def _numbered(book: zipfile.ZipFile, pattern: str) -> list[str]:
    return sorted((n for n in book.namelist() if re.fullmatch(pattern, n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def _targets(book: zipfile.ZipFile, name: str) -> dict[str, tuple[str, str]]:
    """Kind and target of each relation in a part of relations, by its id."""
    if name not in book.namelist():
        return {}
    return {x.get("Id", ""): (x.get("Type", "").rpartition("/")[2].lower(), x.get("Target", "")) for x in _named(_part(book, name), "Relationship")}


def related_images(book: zipfile.ZipFile, name: str) -> int:
    return sum("image" in kind for kind, _ in _targets(book, name).values())


def paragraphs(book: zipfile.ZipFile) -> list[str]:
    """The paragraphs outside tables that hold text."""
    body = _part(book, "word/document.xml")
    inside = {id(p) for t in _named(body, "tbl") for p in _named(t, "p")}
    return [t for p in _named(body, "p") if id(p) not in inside and (t := _text(p).strip())]


def text_document(book: zipfile.ZipFile) -> str:
    """Paragraphs that hold text, then the rows of tables, cells between tabs."""
    tables = _named(_part(book, "word/document.xml"), "tbl")
    rows = ["\t".join(_text(c).strip() for c in _named(r, "tc")) for t in tables for r in _named(t, "tr")]
    return "\n".join(paragraphs(book) + [r for r in rows if r.strip()])


@dataclass(frozen=True)
class Slide:
    texts: list[str]  # of its shapes that hold any
    images: int


def slide_shapes(book: zipfile.ZipFile) -> list[Slide]:
    out = []
    for name in _numbered(book, r"ppt/slides/slide\d+\.xml"):
        slide = _part(book, name)
        texts = ["\n".join(_text(p) for p in _named(x, "p")) for x in _named(slide, "sp")]
        out.append(Slide([t for t in texts if t.strip()], len(_named(slide, "pic"))))
    return out


def slides(book: zipfile.ZipFile) -> str:
    """Slides under `## Slide N`, their notes behind `[notes]`."""
    out = []
    for i, name in enumerate(_numbered(book, r"ppt/slides/slide\d+\.xml"), 1):
        lines = [t for p in _named(_part(book, name), "p") if (t := _text(p).strip())]
        notes = name.replace("slides/slide", "notesSlides/notesSlide")
        spoken = " ".join(t for p in _named(_part(book, notes), "p") if (t := _text(p).strip())) if notes in book.namelist() else ""
        out.append("\n".join([f"## Slide {i}", *lines, *([f"[notes] {spoken}"] if spoken else [])]))
    return "\n\n".join(out)


def sheet_rows(book: zipfile.ZipFile) -> Iterator[tuple[str, list[list[str]]]]:
    """Title and rows of each sheet, in the workbook's order, found through the workbook's relations."""
    shared = [_text(x) for x in _named(_part(book, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in book.namelist() else []
    targets, numbered = _targets(book, "xl/_rels/workbook.xml.rels"), _numbered(book, r"xl/worksheets/sheet\d+\.xml")

    def value(cell: Element) -> str:
        if cell.get("t") == "inlineStr":
            return _text(cell)
        raw = next((v.text or "" for v in _named(cell, "v")), "")
        return shared[int(raw)] if cell.get("t") == "s" and raw else raw

    for k, sheet in enumerate(_named(_part(book, "xl/workbook.xml"), "sheet")):
        relation = next((v for key, v in sheet.attrib.items() if key.rpartition("}")[2] == "id"), "")
        target = targets.get(relation, ("", ""))[1]
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}" if target else numbered[k]
        yield sheet.get("name", ""), [[value(c) for c in _named(r, "c")] for r in _named(_part(book, name), "row")]


def sheets(book: zipfile.ZipFile) -> str:
    """Sheets under `## Sheet: name`, the cells of rows that hold any between commas."""
    return "\n\n".join("\n".join([f"## Sheet: {title}", *(", ".join(r) for r in rows if any(r))]) for title, rows in sheet_rows(book))


KINDS: dict[str, Callable[[zipfile.ZipFile], str]] = {".docx": text_document, ".pptx": slides, ".xlsx": sheets}


def extract(path: str, content: bytes | None) -> tuple[str | None, str | None]:
    """The text of a file and null, or null and what is wrong with it."""
    kind = KINDS.get("." + path.rpartition(".")[2].lower())
    if kind is None:
        return None, "unsupported"
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as book:
            return kind(book), None
    except BROKEN as e:
        return None, f"{type(e).__name__}: {e}"


def texts(files: DataFrame) -> DataFrame:
    """path, text and error of files (path, content); a broken file gives its error and stops no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                text, error = extract(path, content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (path, text, error)], names=["path", "text", "error"])

    return with_package(files).select("path", "content").mapInArrow(run, "path string, text string, error string")


def read(spark: SparkSession, root: str) -> DataFrame:
    """The office documents below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,pptx,xlsx}").load(root)
    return texts(found.select("path", F.col("content")))
