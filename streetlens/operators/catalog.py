"""Joins around a plan: kept regions, overlay labels, sweeps, model choice, seam parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.box import Box


def kept_regions(plan: DataFrame, scores: DataFrame, below: float) -> DataFrame:
    """Shapes of chains that are unsure: a chain without a score counts as sure."""
    joined = plan.join(scores, ["clip_id", "chain_id"], "left").withColumn("score", F.coalesce("score", F.lit(1.0)))
    return joined.where(F.col("score") < below)


def overlay(plan: DataFrame, detections: DataFrame) -> DataFrame:
    """For each shape the score of the detection of its class and frame that it overlaps best, if any by half of the smaller."""
    p, d = plan.alias("p"), detections.alias("d")
    a, b = Box.of("p."), Box.of("d.")
    on = [F.col(f"p.{c}") == F.col(f"d.{c}") for c in ("clip_id", "frame", "cls")] + [a.iomin(b) >= 0.5]
    rank = F.struct(a.iou(b).alias("iou"), -F.col("d.seq"))
    key = [F.col(f"p.{c}").alias(c) for c in ("clip_id", "chain_id", "segment", "frame")]
    return p.join(d, on).groupBy(*key).agg(F.max_by("d.score", rank).alias("score"))


def annotated(clips: DataFrame, truth: DataFrame) -> DataFrame:
    """The clips of a manifest (clip_id, ...) that have ground truth, with their number of ``boxes``; clips without are not evaluated."""
    return clips.join(truth.groupBy("clip_id").agg(F.count(F.lit(1)).alias("boxes")), "clip_id")


def sweep(spark, axes: dict[str, list[float]]) -> DataFrame:
    """Every combination of parameter values: the axes are literals, so their product is as small as it is written."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


def select_models(models: DataFrame, available: float | None) -> DataFrame:
    """Per family (family, name, min_memory) the heaviest model that fits, else the lightest; null memory: the lightest."""
    light = F.struct(F.col("min_memory"), F.col("name"))
    fits = F.lit(False) if available is None else F.col("min_memory") <= available
    best = models.groupBy("family").agg(F.max(F.when(fits, light)).alias("heavy"), F.min(light).alias("light"))
    return best.select("family", F.coalesce("heavy.name", "light.name").alias("name"))


def seam_copies(boxes: DataFrame, width: float) -> DataFrame:
    """Boxes of a frame that closes at ``width`` with ``turn``: each once in the frame, and once a turn to either side."""
    turned = boxes.withColumn("_copy", F.explode(Box.of().copies(width)))
    return turned.withColumns({"turn": F.col("_copy.turn"), "x1": F.col("_copy.x1"), "x2": F.col("_copy.x2")}).drop("_copy")


def seam_parts(boxes: DataFrame, width: float) -> DataFrame:
    """The one or two visible parts of boxes in a frame that closes at ``width``, as ``part``, ``left`` and ``right``."""
    return boxes.select("*", F.posexplode(Box.of().split(width)).alias("part", "span")).select("*", "span.left", "span.right").drop("span")
