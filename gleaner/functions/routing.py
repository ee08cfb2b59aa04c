"""Column expressions that route files and sort out failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: least width and height of an image that is no thumbnail.
THUMBNAIL = 600
#: Fixed value: sensitivity from which a file is critical without being told.
CRITICAL = 4


# Types of failures of a local model's server.
NOT_SET_UP, NOT_STARTED = ("LlamaServerBinaryError",), ("LlamaServerSpawnError", "LlamaServerCrashError")


def visual_score(ext: Column, density: Column, extractable: Column, image_ratio: Column, width: Column, height: Column) -> Column:
    """0 to 10: how much a file needs to be seen rather than read. Unknown sizes of images add nothing.

    Its bounds and points are fixed values.
    """
    is_pdf, is_image = ext == ".pdf", ext.isin(".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".tiff", ".heic")
    sparse = F.when(density < 50, 5).when(density < 500, 2).otherwise(0) + F.when(~extractable, 3).otherwise(0)
    aspect = F.coalesce(F.try_divide(width, height), F.when(width.isNotNull() & height.isNotNull(), 1.0))
    seen = F.when((width >= THUMBNAIL) & (height >= THUMBNAIL), 4).otherwise(0) + F.when((aspect < 0.65) | (aspect > 1.6), 1).otherwise(0)
    return F.least(F.lit(10), F.when(is_pdf, sparse).when(ext == ".docx", F.when(image_ratio > 0.3, 2).otherwise(0)).when(is_image, seen).otherwise(0))


def criticality(sensitivity: Column, wish: Column) -> Column:
    """level and origin: the user's `critical`, then signs of content, then the user's other wishes, then normal."""
    wish = F.coalesce(F.lower(wish), F.lit(""))
    pair = lambda level, origin: F.struct(F.lit(level).alias("level"), F.lit(origin).alias("origin"))
    return (
        F.when(wish == "critical", pair("critical", "user")).when(sensitivity >= CRITICAL, pair("critical", "auto"))
        .when(wish == "casual", pair("casual", "user")).when(wish == "normal", pair("normal", "user")).otherwise(pair("normal", "default"))
    )


def page_label(text: Column) -> Column:
    """The printed number of a page: a line of its own among the first three, else among the last three, from below."""
    lines = F.split(text, "\n")
    near = F.concat(F.slice(lines, 1, 3), F.reverse(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 2), F.lit(3))))
    found = F.transform(near, lambda x: F.regexp_extract(x, r"^[ \t\r\f]*([0-9]{1,4}|[IVXLCDM]+|[ivxlcdm]+)[ \t\r\f]*$", 1))
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))


def failure(name: Column, message: Column) -> Column:
    """status and kind of a failure: a few types' names first, as a path in a message may hold any word, then its message."""
    low = F.coalesce(F.lower(message), F.lit(""))
    has = lambda *parts: low.rlike("|".join(parts))
    pair = lambda status, kind: F.struct(F.lit(status).alias("status"), F.lit(kind).alias("kind"))
    return (
        F.when(name.isin(*NOT_SET_UP), pair(503, "not set up")).when(name.isin(*NOT_STARTED), pair(503, "not started")).when(has("429", "rate", "quota"), pair(503, "busy")).when(has("401", "403", "unauthor", "api key"), pair(401, "account"))
        .when(name.isin("ConnectionError", "TimeoutError") | has("connection"), pair(503, "network"))
        .when((name == "FileNotFoundError") | has("no such file"), pair(404, "missing")).when(has("qdrant", "collection"), pair(503, "starting")).otherwise(pair(500, "unknown"))
    )


def table_stats(n_rows: Column, columns: Column) -> Column:
    """What a summary says of a table: rows and columns, or that there is no header."""
    named = F.concat(F.lit("- **Rows:** "), n_rows.cast("string"), F.lit("\n- **Columns ("), F.size(columns).cast("string"), F.lit("):** "), F.array_join(columns, ", "), F.lit("\n"))
    return F.concat(F.lit("\n## File statistics\n\n"), F.when(F.size(columns) > 0, named).otherwise("_CSV has no header row_\n"))
