"""Ground truth of annotated clips: one JSON object a clip, its tracks with a box a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.box import SIDES

# The version and fields of a file.
VERSION = 1
BOXES = "array<struct<frame:bigint,box:array<double>,readable:boolean>>"
CLIP = f"version int, clip_id string, frames bigint, width int, height int, tracks array<struct<id:string,cls:string,boxes:{BOXES}>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, frames, width, height, tracks) of the files below ``path``, each one JSON object over any number of lines; another version, a box without four sides or malformed JSON is an error."""
    found = spark.read.schema(CLIP).json(path, multiLine=True, mode="FAILFAST")
    sound = F.coalesce(F.col("version"), F.lit(VERSION)) == VERSION
    sound &= F.forall(F.coalesce("tracks", F.array()), lambda t: F.forall(F.coalesce(t["boxes"], F.array()), lambda b: F.coalesce(F.size(b["box"]) == 4, F.lit(False))))
    name = F.when(sound & F.col("clip_id").isNotNull(), F.col("clip_id")).otherwise(F.raise_error(F.concat(F.lit("bad ground truth of clip "), F.coalesce("clip_id", F.lit("without a name")))))
    return found.select(name.alias("clip_id"), "frames", "width", "height", F.coalesce("tracks", F.array().cast(f"array<struct<id:string,cls:string,boxes:{BOXES}>>")).alias("tracks"))


def boxes(clips: DataFrame) -> DataFrame:
    """(clip_id, track, cls, frame, seq, readable, x1..y2): one row a box; ``seq`` is its place in the clip, a box that doesn't say is not readable."""
    tracks = clips.select("clip_id", F.posexplode("tracks").alias("t", "track"))
    each = tracks.select("clip_id", "t", F.col("track.id").alias("track"), "track.cls", F.posexplode("track.boxes").alias("b", "box"))
    seq = F.col("t").cast("long") * F.lit(1 << 32) + F.col("b")
    return each.select("clip_id", "track", "cls", "box.frame", seq.alias("seq"), F.coalesce("box.readable", F.lit(False)).alias("readable"), *(F.col("box.box")[i].alias(s) for i, s in enumerate(SIDES)))


def clips_of(truth: DataFrame, clips: DataFrame) -> DataFrame:
    """The inverse of ``boxes``: (clip_id, frames, width, height) with the tracks of ``truth`` in order of their names, boxes in order of frames; a clip without boxes has no tracks."""
    box = F.struct("frame", F.array(*SIDES).alias("box"), "readable")
    tracks = truth.groupBy("clip_id", "track").agg(F.first("cls").alias("cls"), F.array_sort(F.collect_list(F.struct("frame", "seq", box.alias("b")))).alias("b"))
    named = tracks.select("clip_id", F.struct(F.col("track").alias("id"), "cls", F.transform("b", lambda x: x["b"]).alias("boxes")).alias("t"))
    listed = named.groupBy("clip_id").agg(F.array_sort(F.collect_list("t")).alias("tracks"))
    none = F.array().cast(f"array<struct<id:string,cls:string,boxes:{BOXES}>>")
    return clips.join(listed, "clip_id", "left").select(F.lit(VERSION).alias("version"), F.col("clip_id").cast("string").alias("clip_id"), "frames", "width", "height", F.coalesce("tracks", none).alias("tracks"))


def write(clips: DataFrame, path: str) -> None:
    """One folder a clip below ``path`` with its object in one file."""
    body = clips.select(F.col("clip_id").alias("clip"), F.to_json(F.struct(*clips.columns)).alias("value"))
    body.repartition("clip").write.partitionBy("clip").text(path)
