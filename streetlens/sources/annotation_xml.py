"""Annotated tracks as XML: one ``track`` element an object, with ``box`` elements for its key frames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import round_half_even

ATTRIBUTE = "array<struct<_VALUE:string,_name:string>>"
BOX = f"struct<_frame:bigint,_outside:int,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:{ATTRIBUTE}>"
SHAPES = ("polygon", "polyline", "points", "ellipse", "mask")
TRACK = f"_id bigint, _label string, box array<{BOX}>, " + ", ".join(f"{s} array<struct<_frame:bigint>>" for s in SHAPES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Track elements below ``path``, by a fixed schema; a malformed one is an error."""
    return spark.read.format("xml").option("rowTag", "track").option("mode", "FAILFAST").schema(TRACK).load(path)


def keys(tracks: DataFrame, clip_id, labels: tuple[str, ...], sx: float = 1.0, sy: float = 1.0) -> DataFrame:
    """Key frames (clip_id, track, cls, frame, seq, outside, readable, x1..y2) of the labels known, scaled from proxy to clip."""
    each = tracks.where(F.col("_label").isin(*labels)).select("_id", "_label", F.posexplode("box").alias("seq", "b"))
    readable = F.exists(F.coalesce("b.attribute", F.array()), lambda a: (a["_name"] == "readable") & (F.lower(F.trim(a["_VALUE"])) == "true"))
    sides = [(F.coalesce(f"b._{n}", F.lit(0.0)) * s).alias(c) for n, c, s in (("xtl", "x1", sx), ("ytl", "y1", sy), ("xbr", "x2", sx), ("ybr", "y2", sy))]
    track = F.concat("_label", F.lit(":"), F.col("_id").cast("string"))
    return each.select(F.lit(clip_id).cast("long").alias("clip_id"), track.alias("track"), F.col("_label").alias("cls"), F.coalesce("b._frame", F.lit(0)).alias("frame"), "seq", (F.coalesce("b._outside", F.lit(0)) == 1).alias("outside"), F.coalesce(readable, F.lit(False)).alias("readable"), *sides)


def skipped(tracks: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(reason, n): tracks of other labels and shapes that are no boxes."""
    other = tracks.where(~F.col("_label").isin(*labels)).select(F.concat(F.lit("label:"), "_label").alias("reason"), F.lit(1).alias("n"))
    shapes = tracks.where(F.col("_label").isin(*labels)).select(F.explode(F.array(*(F.struct(F.lit(f"shape:{s}").alias("reason"), F.coalesce(F.size(s), F.lit(0)).alias("n")) for s in SHAPES))).alias("s")).select("s.*")
    return other.unionByName(shapes).groupBy("reason").agg(F.sum("n").alias("n")).where("n > 0")


def _label(name: str) -> str:
    flag = "<attribute><name>readable</name><mutable>True</mutable><input_type>checkbox</input_type><default_value>false</default_value><values>false</values></attribute>"
    return f"<label><name>{name}</name><type>rectangle</type><attributes>{flag}</attributes></label>"


def head(labels: tuple[str, ...], frames: int, width: int, height: int) -> str:
    """The version and ``meta`` element that tell an annotation tool the labels, frames and size of the task."""
    task = f"<size>{frames}</size><mode>interpolation</mode><start_frame>0</start_frame><stop_frame>{frames - 1}</stop_frame><labels>{''.join(map(_label, labels))}</labels>"
    return f"<version>1.1</version><meta><task>{task}<original_size><width>{width}</width><height>{height}</height></original_size></task></meta>"


def document(found: DataFrame, labels: tuple[str, ...], frames: int, width: int, height: int) -> DataFrame:
    """(clip_id, body): the XML of each clip's key frames (clip_id, track, cls, frame, outside, x1..y2), tracks numbered in order of their names.

    ``labels`` and the size hold for all clips; a track outside ``labels`` is an error,
    since the tool would leave it out. Labels are words, so nothing needs to be escaped.
    """
    if bad := [name for name in labels if not re.fullmatch(r"[\w -]+", name)]:
        raise ValueError(f"labels {bad} are not made of letters, digits, blanks, '-' and '_'")
    sides = [F.concat(F.lit(f'{n}="'), F.format_string("%.2f", round_half_even(F.col(c), 2)), F.lit('" ')) for n, c in (("xtl", "x1"), ("ytl", "y1"), ("xbr", "x2"), ("ybr", "y2"))]
    box = F.concat(F.format_string('<box frame="%d" keyframe="1" outside="%d" occluded="0" ', "frame", F.col("outside").cast("int")), *sides, F.lit('z_order="0"><attribute name="readable">false</attribute></box>'))
    each = found.groupBy("clip_id", "track").agg(F.first("cls").alias("cls"), F.array_sort(F.collect_list(F.struct("frame", "outside", box.alias("b")))).alias("b"))
    known = F.when(F.col("cls").isin(*labels), F.col("cls")).otherwise(F.raise_error(F.concat(F.lit("no label for "), F.col("cls"))))
    listed = each.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("track", known.alias("cls"), F.array_join(F.transform("b", lambda x: x["b"]), "").alias("b")))).alias("t"))
    tracks = F.transform("t", lambda t, i: F.concat(F.format_string('<track id="%d" label="%s" source="auto">', i, t["cls"]), t["b"], F.lit("</track>")))
    return listed.select("clip_id", F.concat(F.lit(f'<?xml version="1.0" encoding="utf-8"?><annotations>{head(labels, frames, width, height)}'), F.array_join(tracks, ""), F.lit("</annotations>")).alias("body"))


def write(documents: DataFrame, path: str) -> None:
    """Documents (clip_id, body) as one file a clip, in a folder ``clip_id=<id>`` each."""
    documents.repartition("clip_id").select("clip_id", F.col("body").alias("value")).write.partitionBy("clip_id").text(path)
