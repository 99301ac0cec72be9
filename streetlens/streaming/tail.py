"""Detection logs as a stream: lines of files that keep arriving become detections and ends of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import LINE


def lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of (clip_id, p) from text files below ``folder``, named ``<clip>-<part>.jsonl`` and written whole."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    clip = F.regexp_extract(F.input_file_name(), r"([^/]+)-\d+\.jsonl$", 1)
    return raw.where(F.trim("value") != "").select(clip.alias("clip_id"), F.from_json("value", LINE).alias("p"), "value")


def arriving(parsed: DataFrame) -> DataFrame:
    """(clip_id, frame, seq, cls, score, track_id, x1..y2): one row a detection; a footer gives a row whose ``seq`` is null.

    A line that is neither header, frame nor footer is an error.
    """
    kind = F.when(F.col("p.type").isin("header", "frame", "footer"), F.col("p.type")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.left("value", F.lit(80)))))
    known = parsed.select("clip_id", kind.alias("type"), "p.index", "p.frames", "p.detections")
    rows = F.when(F.col("type") == "footer", F.array(F.lit(None).cast("struct<class:string,score:double,box:array<double>,track_id:string,seq:bigint>"))).otherwise(F.col("detections"))
    each = known.where("type <> 'header'").select("clip_id", F.coalesce("index", "frames").alias("frame"), F.explode(rows).alias("d"))
    return each.select("clip_id", "frame", "d.seq", F.col("d.class").alias("cls"), "d.score", "d.track_id", *(F.col("d.box")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))
