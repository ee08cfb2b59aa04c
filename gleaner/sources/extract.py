"""Texts of files of all kinds: one row a file, with its text or what is wrong with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.operators.router import kind_of
from gleaner.sources import office, peeks
from gleaner.sources.files import notebook_text
from gleaner.staging import written


def extracted(files: DataFrame, parser: peeks.Parser | None = None, most: int = 25_000) -> DataFrame:
    """path, kind, text and error of files (path, content). PDFs need a reader (``peeks.document_pages``)."""
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select("path", "content", kind_of(F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)), name).alias("kind"))
    plain, kind = peeks.lossy(F.col("content")), F.col("kind")
    text = F.when(kind.isin("text", "code", "config", "dotfile", "csv"), plain).when(kind == "ipynb", notebook_text(plain))
    error = F.when(kind.isNull(), "unsupported").when(kind == "image", "an image has no text").when((kind == "ipynb") & text.isNull(), "no notebook")
    packed = kind.isin("docx", "xlsx", "pptx")
    pages = H.main_text(files.where(kind == "html").select("path", "kind", plain.alias("html")))
    out = files.where(~F.coalesce(packed, F.lit(False)) & (kind.isNull() | ~kind.isin("pdf", "html"))).select("path", "kind", F.when(error.isNull(), text).alias("text"), error.alias("error"))
    out = out.unionByName(pages.select("path", "kind", "text", "error"))
    kinds = files.select("path", "kind")
    out = out.unionByName(office.texts(files.where(packed).select("path", "content")).join(kinds, "path").select("path", "kind", "text", "error"))
    pdfs = files.where(kind == "pdf")
    if parser is None:
        return out.unionByName(pdfs.select("path", "kind", F.lit(None).cast("string").alias("text"), F.lit("no reader of this kind").alias("error")))
    read_pages = written(peeks.document_pages(pdfs, parser), "document_pages")  # a reader is asked once
    read = peeks.document_text(read_pages, most).select("path", "text", F.lit(None).cast("string").alias("error"))
    failed = read_pages.where("error is not null").select("path", F.lit(None).cast("string").alias("text"), "error")
    return out.unionByName(read.unionByName(failed).withColumn("kind", F.lit("pdf")))
