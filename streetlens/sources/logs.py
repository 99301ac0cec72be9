"""Detection logs: one JSON object a line, a header, frames in order, a footer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_half_even

# The schema name and version of a log.
NAME, VERSION = "detections", 1
DETECTION = "array<struct<`class`:string,score:double,box:array<double>,track_id:string,seq:bigint>>"
LINE = f"type string, `schema` string, version int, `index` bigint, time double, frames bigint, complete boolean, video struct<width:int,height:int>, detections {DETECTION}"


def to_lines(detections: DataFrame, frames: int, fps: float, size: tuple[int, int] = (1920, 1080)) -> DataFrame:
    """(clip_id, at, line): the log of each clip; frames without detections have a line too. Boxes keep one decimal, scores three."""
    item = F.struct(F.col("cls").alias("class"), round_half_even(F.col("score"), 3).alias("score"), F.array(*(round_half_even(F.col(c), 1) for c in ("x1", "y1", "x2", "y2"))).alias("box"), "track_id", "seq")
    each = detections.groupBy("clip_id", "frame").agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("d")))).alias("d"))
    clips = detections.select("clip_id").distinct()
    grid = clips.select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))).alias("frame"))
    body = grid.join(each, ["clip_id", "frame"], "left").select(
        "clip_id", F.col("frame").alias("at"), F.to_json(F.struct(F.lit("frame").alias("type"), F.col("frame").alias("index"), (F.col("frame") / fps).alias("time"), F.coalesce(F.transform("d", lambda x: x["d"]), F.array()).alias("detections"))).alias("line")
    )
    head = clips.select("clip_id", F.lit(-1).cast("long").alias("at"), F.to_json(F.struct(F.lit("header").alias("type"), F.lit(NAME).alias("schema"), F.lit(VERSION).alias("version"), F.struct(F.lit(size[0]).alias("width"), F.lit(size[1]).alias("height")).alias("video"))).alias("line"))
    foot = clips.select("clip_id", F.lit(frames).cast("long").alias("at"), F.to_json(F.struct(F.lit("footer").alias("type"), F.lit(frames).alias("frames"), F.lit(True).alias("complete"))).alias("line"))
    return head.unionByName(body).unionByName(foot)


def parse(lines: DataFrame) -> DataFrame:
    """Lines (clip_id, at, line) parsed by the fixed schema; blank lines are skipped and a bad one is an error."""
    parsed = lines.where(F.trim("line") != "").withColumn("p", F.from_json("line", LINE))
    kind = F.when(F.col("p.type").isin("header", "frame", "footer"), F.col("p.type")).otherwise(F.raise_error(F.concat(F.lit("bad line "), F.col("at").cast("string"), F.lit(" of clip "), F.col("clip_id").cast("string"))))
    return parsed.select("clip_id", "at", kind.alias("type"), "p.schema", "p.version", "p.index", "p.time", "p.frames", "p.complete", "p.video", "p.detections")


def check(parsed: DataFrame) -> DataFrame:
    """(clip_id, problem) per clip: null where the header is first and known, frames are 0..n-1 in order and nothing follows the footer; a missing footer is no problem."""
    w = Window.partitionBy("clip_id").orderBy("at")
    numbered = parsed.withColumns({"n": F.row_number().over(w), "of_kind": F.row_number().over(Window.partitionBy("clip_id", "type").orderBy("at"))})
    frame, head = F.col("type") == "frame", F.col("type") == "header"
    found = numbered.groupBy("clip_id").agg(
        F.count_if((F.col("n") == 1) != head).alias("bad_header"), F.count_if(head & ((F.col("schema") != NAME) | (F.col("version") != VERSION))).alias("unknown"),
        F.count_if(frame & (F.col("index") != F.col("of_kind") - 1)).alias("order"), F.max(F.when(F.col("type") == "footer", F.col("n"))).alias("foot"), F.max("n").alias("last"),
    )
    return found.select("clip_id", F.when(F.col("bad_header") > 0, "header").when(F.col("unknown") > 0, "schema").when(F.col("order") > 0, "order").when(F.col("foot") < F.col("last"), "content after footer").alias("problem"))


def owned(parsed: DataFrame, videos: DataFrame, allow_partial: bool = False) -> DataFrame:
    """(clip_id, problem) of each clip of ``videos`` (clip_id, width, height): ``incomplete`` without a footer that says complete, ``size`` where the header names another frame size, else null."""
    seen = parsed.groupBy("clip_id").agg(F.max(F.when(F.col("type") == "footer", F.col("complete"))).alias("complete"), F.max("video.width").alias("w"), F.max("video.height").alias("h"))
    partial = F.lit(False) if allow_partial else ~F.coalesce("complete", F.lit(False))
    other = ~(F.col("w").eqNullSafe(F.col("width")) & F.col("h").eqNullSafe(F.col("height")))
    return videos.join(seen, "clip_id", "left").select("clip_id", F.when(partial, "incomplete").when(other, "size").alias("problem"))


def write(lines: DataFrame, path: str) -> None:
    """Lines (clip_id, at, line) as text files, one folder a clip, in order: a clip is written by one task."""
    ordered = lines.repartition("clip_id").sortWithinPartitions("clip_id", "at")
    ordered.select("clip_id", F.col("line").alias("value")).write.partitionBy("clip_id").text(path)


def detections(parsed: DataFrame) -> DataFrame:
    """The detections of a parsed log, one row each."""
    each = parsed.where("type = 'frame'").select("clip_id", F.col("index").alias("frame"), F.explode("detections").alias("d"))
    return each.select("clip_id", "frame", "d.seq", F.col("d.class").alias("cls"), "d.score", "d.track_id", *(F.col("d.box")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the log files below ``path``: the file names the clip, the line's place in it ``at``.

    Large files are read in blocks, side by side; a block's offset and the order of
    its lines give their places, so only the numbering brings a file together.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("clip_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    at = F.row_number().over(Window.partitionBy("clip_id").orderBy("_block", "_row")) - 1
    return raw.select("clip_id", at.alias("at"), "line")
