"""Set-up files in YAML: clip manifest, model registry, tracker settings, thresholds.

People edit these files, they are a few kilobytes, so the driver parses their
text; manifest and registry become tables. Text is read by Spark, from
whatever store the path names.
"""

from __future__ import annotations

import re

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.track import TrackOptions

# Fields of the files and the patterns that names must fit.
CLIPS = (
    "id string, source_sha256 string, start_s double, frames long, fps double, width int, height int, proxy_width int, proxy_height int, projection string, "
    "annotator string, annotated_on string, ground_truth_sha256 string"
)
MODELS = "name string, family string, version string, file string, url string, sha256 string, size_bytes long, classes array<string>, train_imgsz int, min_memory_gib double, licence string, source string"
CLIP_ID = r"^[a-z0-9][a-z0-9_-]{0,63}$"
PATTERNS = {"name": r"^[a-z0-9][a-z0-9._-]*$", "file": r"^[^/\\]+$", "sha256": r"^[0-9a-f]{64}$"}
OPTIONAL = ("annotator", "annotated_on", "ground_truth_sha256", "url", "size_bytes", "source")
TRACKER = ("tracker_type", "gate", "gate_cap", "large_gate", "context", "fb_error", "min_size", "track_buffer")


def text_of(spark: SparkSession, path: str) -> str | None:
    """The text of one file, None where there is none."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row[0] if row else ""


def _table(spark: SparkSession, entries: list[dict], schema: str, what: str) -> DataFrame:
    kinds = dict(part.split(" ") for part in schema.split(", "))
    for entry in entries:
        if unknown := sorted(set(entry) - set(kinds)):
            raise ValueError(f"{what}: unknown fields {unknown}")
        if missing := sorted(k for k in kinds if entry.get(k) is None and k not in OPTIONAL):
            raise ValueError(f"{what}: fields {missing} are missing")
    convert = {"double": float, "long": int, "int": int, "string": str, "array<string>": lambda v: [str(x) for x in v]}
    rows = [tuple(convert[kind](entry[k]) if entry.get(k) is not None else None for k, kind in kinds.items()) for entry in entries]
    return spark.createDataFrame(rows, schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The clips of a manifest; a file that is missing or empty has none."""
    data = yaml.safe_load(text_of(spark, path) or "") or {}
    if data.get("version", 1) != 1:
        raise ValueError(f"manifest: unknown version {data['version']!r}")
    entries = data.get("clips") or []
    if bad := [e.get("id") for e in entries if not re.match(CLIP_ID, str(e.get("id")))]:
        raise ValueError(f"manifest: clip ids {bad} are not 1 to 64 lower-case letters, digits, '-' or '_'")
    return _table(spark, entries, CLIPS, "manifest")


def put(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the rows of ``changes``, which replace those with the same key."""
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes)


def manifest_text(clips: DataFrame) -> str:
    """The YAML text of a manifest, clips in order of their ids."""
    entries = [row.asDict() for row in clips.orderBy("id").toLocalIterator()]
    return yaml.safe_dump({"version": 1, "clips": entries}, sort_keys=False, allow_unicode=True)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The models of a registry with their ``tag``; names and the classes of a model are unique and every model has a pinned address."""
    text = text_of(spark, path)
    data = yaml.safe_load(text or "") or {}
    entries = data.get("models") or []
    if data.get("schema_version") != 1 or not entries:
        raise ValueError("registry: schema_version must be 1 and models must not be empty")
    names = [str(e.get("name")) for e in entries]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"registry: names {twice} occur twice")
    for name, e in zip(names, entries, strict=True):
        if bad := [k for k, pattern in PATTERNS.items() if not re.match(pattern, str(e.get(k)))]:
            raise ValueError(f"registry: {bad} of {name!r} don't fit")
        classes = e.get("classes") or []
        if not classes or len(set(classes)) != len(classes):
            raise ValueError(f"registry: classes of {name!r} are none or occur twice")
        if not re.match(r"^https?://[^/]+", str(e.get("url"))):
            raise ValueError(f"registry: {name!r} has no pinned url")
    return _table(spark, entries, MODELS, "registry").withColumn("tag", F.concat_ws("/", "name", "version"))


def tracker(spark: SparkSession, path: str, fps: float, wrap_width: float | None = None) -> TrackOptions:
    """Settings of the tracker; a life in seconds becomes frames of ``fps``; unknown keys are refused, since a misspelt one would keep its default."""
    data = dict(yaml.safe_load(text_of(spark, path) or "") or {})
    if "tracker_type" not in data:
        raise ValueError("tracker: tracker_type is missing")
    if data["tracker_type"] != "flow":
        raise ValueError(f"tracker: unknown tracker_type {data['tracker_type']!r}")
    if (seconds := data.pop("track_buffer_s", None)) is not None:
        data["track_buffer"] = max(1, round(float(seconds) * fps))
    if unknown := sorted(set(data) - set(TRACKER)):
        raise ValueError(f"tracker: unknown keys {unknown}")
    given = {k: float(data[k]) for k in ("gate", "gate_cap", "large_gate", "min_size") if k in data}
    if "track_buffer" in data:
        given["max_missed"] = int(data["track_buffer"])
    return TrackOptions(**given, wrap_width=wrap_width)


def thresholds(spark: SparkSession, path: str, section: str = "annotated_dataset") -> dict[str, float]:
    """Named limits of one section of a thresholds file."""
    data = yaml.safe_load(text_of(spark, path) or "") or {}
    if section not in data:
        raise ValueError(f"thresholds: no section {section!r}")
    return {str(k): float(v) for k, v in data[section].items()}
