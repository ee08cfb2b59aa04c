"""The gate of the index: which files enter it, and the reason for each."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from gleaner.workers import with_package


def glob_regex(line: str) -> tuple[str, bool] | None:
    """An ignore line as an expression over relative paths, and whether it keeps (``!``) what earlier lines leave out.

    A slash within or before a pattern ties it to the folder; one behind it asks for what lies below. Braces stand
    for themselves. None for comments and empty lines.
    """
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    body = line[1:] if keeps else line
    below, body = body.endswith("/"), body.rstrip("/")
    out, body, i = "" if "/" in body else "(?:.*/)?", body.removeprefix("/"), 0
    while i < len(body):
        starts = i == 0 or body[i - 1] == "/"
        if starts and body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif starts and body[i:] == "**":
            out, i = out + ".+", i + 2
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            inner = re.sub(r"([\\\[&~|])", r"\\\1", body[i + 1 : end])
            out, i = out + ("[^" + inner[1:] if inner[0] in "!^" else "[" + inner) + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i])), i + 1
    return rf"(?s)^{out}{'/.*' if below else '(?:/.*)?'}\z", keeps


def ignored(path: Column, lines: tuple[str, ...]) -> Column:
    """Whether the last line that fits the relative path leaves it out."""
    found: Column | None = None
    for regex, keeps in reversed([g for g in map(glob_regex, lines) if g]):
        found = F.when(path.rlike(regex), not keeps) if found is None else found.when(path.rlike(regex), not keeps)
    return F.lit(False) if found is None else found.otherwise(False)


def under(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root.rstrip("/") + "/")


@dataclass(frozen=True)
class Root:
    """An included folder with its own rules; what it does not set is the common rule's."""

    path: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    off: frozenset[str] | None = None
    max_mb: float | None = None


@dataclass(frozen=True)
class Rules:
    """files and excluded: whole paths. dirs, extensions, patterns: left out by default. categories: of extensions."""

    roots: tuple[Root, ...]
    files: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    dirs: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    categories: tuple[tuple[str, str], ...] = ()
    off: frozenset[str] = frozenset()
    max_mb: float = 100.0
    hidden: bool = True


def _most_specific(rules: Rules) -> list[Root]:
    return sorted(rules.roots, key=lambda r: -len(r.path))


def root_of(path: Column, rules: Rules) -> Column:
    """The longest included folder that holds the path, else null."""
    return F.coalesce(*(F.when(under(path, r.path), r.path) for r in _most_specific(rules)), F.lit(None).cast("string"))


def _below(path: Column, size: Column, inline: Column, root: Root, rules: Rules) -> Column:
    """The reason for files of one root."""
    rel = F.substring(path, len(root.path.rstrip("/")) + 2, 1 << 30)
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    ext = F.lower(F.regexp_extract(name, r"(?s)[^.](\.[^.]+)\z", 1))
    category = F.coalesce(*(F.when(ext == e, c) for e, c in rules.categories), F.lit(None).cast("string"))
    off = sorted(rules.off if root.off is None else root.off)
    limit = rules.max_mb if root.max_mb is None else root.max_mb
    folder = F.get(F.filter(parts, lambda p: p.isin(*rules.dirs)), F.lit(0))
    return (
        F.when(ignored(rel, root.exclude), f"folder rule exclude in {root.path}")
        .when(ignored(rel, root.include), f"folder rule include in {root.path}")
        .when(ignored(rel, rules.exclude), "global exclude pattern")
        .when(folder.isNotNull(), F.concat(F.lit("default exclude: dir '"), folder, F.lit("'")))
        .when(ext.isin(*rules.extensions), F.concat(F.lit("default exclude: extension '"), ext, F.lit("'")))
        .when(ignored(rel, rules.patterns), "default exclude pattern")
        .when(inline.isNotNull(), inline)
        .when(F.lit(rules.hidden) & name.startswith("."), "hidden file")
        .when(category.isin(*off), F.concat(F.lit("category disabled: "), category))
        .when(size.isNull(), "cannot stat file")
        .when(size > limit * 1024 * 1024, "exceeds max file size")
        .otherwise("ok")
    )


def reason(path: Column, size: Column, rules: Rules, inline: Column | None = None) -> Column:
    """Why a file enters the index or does not; the first rule that speaks decides. A null path is under no folder.

    inline: what rule files beside the file say (``inline_verdicts``), or null.
    """
    inline = F.lit(None).cast("string") if inline is None else inline
    chain = F.when(path.isin(*rules.files), F.concat(F.lit("explicitly included file: "), path))
    for out in rules.excluded:
        chain = chain.when(under(path, out), f"explicitly excluded: {out}")
    for root in _most_specific(rules):
        chain = chain.when(under(path, root.path), _below(path, size, inline, root, rules))
    return chain.otherwise("not under any included folder")


def allowed(why: Column) -> Column:
    return (why == "ok") | why.startswith("explicitly included file") | why.startswith("folder rule include") | why.startswith("included by ")


@F.pandas_udf(StructType().add("regex", StringType()).add("keeps", BooleanType()))
def _compiled(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([glob_regex(x or "") or (None, None) for x in lines], columns=["regex", "keeps"])


def inline_verdicts(files: DataFrame, lines: DataFrame, kinds: tuple[tuple[str, bool], ...]) -> DataFrame:
    """path and inline, the verdict of the deepest rule file that speaks, for files (path, root).

    lines: dir, kind (a rule file's name), pos and line. kinds: names in the order in which they speak within a
    folder, and whether they include. Files meet the rule files of their folders up to the root by an equal join.
    """
    rules = with_package(lines).select("dir", "kind", "pos", _compiled("line").alias("c")).select("dir", "kind", "pos", "c.regex", "c.keeps").where("regex is not null")
    parts = F.split("path", "/")
    top, bottom = F.size(F.split("root", "/")), F.size(parts) - 1
    up = files.where(top <= bottom).select("path", F.explode(F.sequence(top, bottom)).alias("depth"))
    up = up.withColumn("dir", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/"))
    met = up.join(rules, "dir").where("rlike(substring(path, length(dir) + 2), regex)")
    spoken = met.groupBy("path", "depth", "dir", "kind").agg(F.max_by("keeps", "pos").alias("keeps")).where("not keeps")
    place = F.coalesce(*(F.when(F.col("kind") == k, i) for i, (k, _) in enumerate(kinds)))
    includes = F.col("kind").isin(*(k for k, i in kinds if i))
    said = F.concat(F.when(includes, "included by ").otherwise("excluded by "), "kind", F.lit(" in "), "dir")
    return spoken.where(place.isNotNull()).groupBy("path").agg(F.min_by(said, F.struct(-F.col("depth"), place)).alias("inline"))


def gated(files: DataFrame, rules: Rules, lines: DataFrame, kinds: tuple[tuple[str, bool], ...]) -> DataFrame:
    """The files with reason and allowed; paths are distinct."""
    own = files.select("path", root_of(F.col("path"), rules).alias("root")).where("root is not null")
    found = files.join(inline_verdicts(own, lines, kinds), "path", "left")
    why = reason(F.col("path"), F.col("size"), rules, F.col("inline"))
    return found.withColumn("reason", why).withColumn("allowed", allowed(F.col("reason"))).drop("inline")
