"""Sidecars: YAML files that describe what is too large to read. Each gives a summary of its own and one of each scene."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.answering import summary_markdown
from gleaner.workers import with_package

SCHEMA = (
    "path string, alt_version bigint, type string, filename string, local_path string, hash string, one_line string, full string, "
    "scenes array<struct<timecode:string,description:string,setting:string,mood:string>>, themes array<string>, search_tokens array<string>, "
    "context array<string>, duration string, date string, time_utc string, error string"
)
_SCENE = pa.struct([(n, pa.string()) for n in ("timecode", "description", "setting", "mood")])
_TEXTS = pa.list_(pa.string())
_KINDS = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.list_(_SCENE), _TEXTS, _TEXTS, _TEXTS, *[pa.string()] * 4]


class Wrong(ValueError):
    """What is wrong with a sidecar."""


def _part(data: dict, name: str, kind: type, needed: bool = False):
    if name not in data and needed:
        raise Wrong(f"missing required field '{name}'")
    value = data.get(name)
    if value is None and not needed:
        return kind()
    if not isinstance(value, kind):
        raise Wrong(f"'{name}' must be a {kind.__name__}, got {type(value).__name__}")
    return value


def parse(path: str, content: bytes | None) -> tuple:
    """The fields of SCHEMA; of a file that is wrong, its path and an error that names the place."""
    import yaml

    try:
        data = yaml.safe_load((content or b"").decode("utf-8"))
        if not isinstance(data, dict):
            raise Wrong(f"top level must be a mapping, got {type(data).__name__}")
        version = _part(data, "alt_version", int, True)
        source, summary = _part(data, "source", dict, True), _part(data, "summary", dict, True)
        text = lambda of, name: str(of.get(name) or "")
        scenes = []
        for i, scene in enumerate(_part(data, "scenes", list)):
            if not isinstance(scene, dict):
                raise Wrong(f"scenes[{i}] must be a mapping")
            if lacking := [n for n in ("timecode", "description") if n not in scene]:
                raise Wrong(f"missing required field 'scenes[{i}].{lacking[0]}'")
            scenes.append({"timecode": str(scene["timecode"]), "description": str(scene["description"]), "setting": text(scene, "setting"), "mood": text(scene, "mood")})
        lists = [[str(x) for x in _part(data, n, list)] for n in ("themes", "search_tokens")]
        context, technical, recorded = (data[n] if isinstance(data.get(n), dict) else {} for n in ("context", "technical", "recorded"))
        entities = [v.strip() for v in context.values() if isinstance(v, str) and v.strip()]
        return (
            path, version, text(data, "type") or "unknown", text(source, "filename"), text(source, "local_path"), text(source, "file_hash_sha256"), text(summary, "one_line"), text(summary, "full").strip(),
            scenes, *lists, entities, text(technical, "duration_human"), text(recorded, "date"), text(recorded, "time_utc"), None,
        )
    except (Wrong, yaml.YAMLError, UnicodeDecodeError) as e:
        return (path, *[None] * (len(_KINDS) - 2), f"{path}: {e}")


def parsed(files: DataFrame) -> DataFrame:
    """The sidecars (path, content) in columns; a wrong one has its error and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(p, c.as_py()) for p, c in zip(batch.column("path").to_pylist(), batch.column("content"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)] if rows else [pa.array([], k) for k in _KINDS], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return with_package(files.select("path", "content")).mapInArrow(run, SCHEMA)


def summaries(sidecars: DataFrame) -> DataFrame:
    """source (the path, or path#scene:timecode), kind and markdown: of each sidecar one of its own and one of each scene."""
    c, full = F.col, lambda x: F.when(x != "", x)
    well = sidecars.where("error is null")
    keywords = F.array_sort(F.array_distinct(F.concat("themes", "search_tokens")))
    entities = F.concat("context", F.filter(F.array("filename"), lambda x: x != ""))
    present = lambda *cols: F.filter(F.array(*cols), lambda x: x != "")
    named = F.when(c("one_line") != "", F.left(F.rtrim(F.trim("one_line"), F.lit(".")), F.lit(80))).when(c("filename") != "", c("filename")).otherwise(F.element_at(F.split("path", "/"), -1))
    told = F.array_join(F.transform("scenes", lambda s: F.concat(F.lit("At "), s["timecode"], F.lit(": "), s["description"], F.lit("."))), " ")
    prose = F.concat_ws(" ", *(full(F.trim(x)) for x in (c("one_line"), c("full"), told)))
    whole = well.select(c("path").alias("source"), F.lit("video").alias("kind"), summary_markdown(c("path"), named, prose, F.lit("alt"), keywords, entities, present("hash", "local_path", "filename", "date", "time_utc", "duration")).alias("markdown"))
    scenes = well.withColumn("s", F.explode("scenes")).withColumn("at", c("s.timecode"))
    source = F.concat("path", F.lit("#scene:"), "at")
    bit = lambda head, x: F.when(x != "", F.concat(F.lit(head), x))
    scene_prose = F.concat_ws(" ", F.concat(F.lit("At timecode "), "at", F.lit(": "), "s.description"), bit("Setting: ", c("s.setting")), bit("Mood: ", c("s.mood")), bit("Parent video: ", c("one_line")))
    title = F.concat(F.lit("Scene "), "at", F.lit(" — "), F.left("s.description", F.lit(60)))
    each = scenes.select(source.alias("source"), F.concat(F.lit("s_"), F.translate("at", ":/", "__")).alias("kind"), summary_markdown(source, title, scene_prose, F.lit("alt-scene"), keywords, entities, present("at", "filename", "hash")).alias("markdown"))
    return whole.unionByName(each)


def left_over(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of the manifest that a sidecar once gave and gives no more: files ending in `.alt`, and their scenes."""
    ours = manifest.where(F.col("path").rlike(r"\.alt(#scene:.*)?$"))
    return ours.join(sources.select(F.col("source").alias("path")), "path", "left_anti")
