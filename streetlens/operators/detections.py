"""Detections as a flat table, and what is counted on them.

Columns: clip_id, frame, seq (ties), cls, grp, score, x1, y1, x2, y2, track_id (null: orphan), pass_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.box import Box
from ..options import Options


def from_events(events: DataFrame) -> DataFrame:
    """A deterministic detections table made of an events table, in integer arithmetic."""
    frame = ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("long")
    kind = F.col("event_type")
    cls = F.when(kind.isin("click", "error"), "face").when(kind == "view", "plate").when(kind == "purchase", "sign").otherwise("direction")
    base = events.select(F.col("user_id").alias("clip_id"), frame.alias("frame"), F.col("event_id").alias("seq"), cls.alias("cls"))
    grp = F.when(F.col("cls").isin("face", "plate"), F.col("cls")).otherwise("signage")
    x1 = ((F.col("clip_id") * 53 + F.col("frame") * 3 + F.col("seq") % 7) % 1900).cast("double")
    y1 = ((F.col("clip_id") * 31 + F.col("frame")) % 1000).cast("double")
    out = base.withColumn("grp", grp).withColumn("score", ((F.col("seq") * 37) % 1000).cast("double") / F.lit(1000).cast("double")).withColumns({"x1": x1, "y1": y1})
    out = out.withColumns({"x2": F.col("x1") + (F.col("seq") % 41 + 20).cast("double"), "y2": F.col("y1") + (F.col("seq") % 23 + 20).cast("double")})
    track = F.when(F.col("seq") % 3 != 0, F.concat("grp", F.lit(":"), F.floor(F.col("frame") / 48).cast("string")))
    return out.withColumn("track_id", track).withColumn("pass_id", F.when(F.col("seq") % 2 == 0, "g1024").otherwise("g2048"))


def counts(detections: DataFrame) -> DataFrame:
    """Detections and orphans per class."""
    return detections.groupBy("cls").agg(F.count(F.lit(1)).alias("detections"), F.count_if(F.col("track_id").isNull()).alias("orphans"))


def fragments(detections: DataFrame) -> DataFrame:
    """One row per track, and per orphan: its frames, size, best score and group (that of its first observation)."""
    key = F.coalesce("track_id", F.concat(F.col("grp"), F.lit(":~"), F.col("seq").cast("string")))
    place = F.struct("frame", "seq")
    return detections.withColumn("fragment", key).groupBy("clip_id", "fragment").agg(
        F.min_by("grp", place).alias("grp"), F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("n"), F.max("score").alias("best_score")
    )


def majority_class(chained: DataFrame) -> DataFrame:
    """The most frequent class of each chain; of equally frequent ones the first seen."""
    each = chained.groupBy("clip_id", "chain_id", "cls").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("frame", "seq")).alias("first"))
    first = F.struct(F.col("n"), -F.col("first.frame"), -F.col("first.seq"))
    return each.groupBy("clip_id", "chain_id").agg(F.max_by("cls", first).alias("cls"))


def tracks_as_chains(detections: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Detections of the given groups, each track and each orphan a chain of its own."""
    orphan = F.concat(F.col("grp"), F.lit(":~"), F.col("seq").cast("string"))
    return detections.where(F.col("grp").isin(*groups)).withColumn("chain_id", F.coalesce("track_id", orphan))


def sure(detections: DataFrame, o: Options) -> DataFrame:
    """What a detector keeps: scores of at least ``conf_detect``."""
    return detections.where(F.col("score") >= o.conf_detect)


def first_frames(rows: DataFrame, max_frames: int | None) -> DataFrame:
    """Rows (frame, ...) of the first ``max_frames`` frames of each clip, or all."""
    return rows if max_frames is None else rows.where(F.col("frame") < max_frames)


def worth_annotating(chained: DataFrame, least_score: float, least_frames: int) -> DataFrame:
    """Observations of chains whose best score and number of distinct frames are high enough for an annotator to see."""
    frames = chained.select("clip_id", "chain_id", "frame").distinct().groupBy("clip_id", "chain_id").agg(F.count(F.lit(1)).alias("_frames"))
    best = chained.groupBy("clip_id", "chain_id").agg(F.max("score").alias("_best")).where(F.col("_best") >= least_score)
    good = best.join(frames.where(F.col("_frames") >= least_frames), ["clip_id", "chain_id"]).select("clip_id", "chain_id")
    return chained.join(good, ["clip_id", "chain_id"], "left_semi")


def from_passes(found: DataFrame, passes: DataFrame) -> DataFrame:
    """Boxes that each pass (clip_id, id, kind, x1, y1, pad) found in its own input, all in the frame's coordinates.

    ``found`` is (clip_id, pass_id, x1..y2, ...). Whole-frame passes of a padded
    frame shift left by the padding, tiles by their corner; a video has few passes.
    """
    tile = F.col("kind") == "tile"
    shift = passes.select("clip_id", F.col("id").alias("pass_id"), F.when(tile, F.col("x1")).otherwise(-F.col("pad")).cast("double").alias("_dx"), F.when(tile, F.col("y1")).otherwise(F.lit(0)).cast("double").alias("_dy"))
    moved = found.join(shift, ["clip_id", "pass_id"])
    box = Box.of().translate(F.col("_dx"), F.col("_dy"))
    return moved.withColumns({"x1": box.x1, "y1": box.y1, "x2": box.x2, "y2": box.y2}).select(*found.columns)


def fragmentation(detections: DataFrame) -> DataFrame:
    """Per group the detections, the share with a track and how many tracks there are, over all clips."""
    track = F.concat("track_id", F.lit("@"), F.col("clip_id").cast("string"))
    return detections.groupBy("grp").agg(F.count(F.lit(1)).alias("detections"), (F.count("track_id") / F.count(F.lit(1))).alias("tracked_share"), F.count_distinct(track).alias("tracks"))


def chain_ratios(chained: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: detections, chains, chains that are blurred, and detections a blurred chain."""
    key = ["clip_id", "chain_id"]
    both = chained.select(*key, F.lit(1).alias("seen"), F.lit(0).alias("blurred")).unionByName(plan.select(*key, F.lit(0).alias("seen"), F.lit(1).alias("blurred")))
    chains = both.groupBy(*key).agg(F.sum("seen").alias("seen"), F.max("blurred").alias("blurred"))
    found = chains.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("detections"), F.count_if(F.col("seen") > 0).alias("chains"), F.count_if(F.col("blurred") > 0).alias("chains_blurred"))
    return found.withColumn("detections_per_blurred_chain", F.when(F.col("chains_blurred") > 0, F.col("detections") / F.col("chains_blurred")).otherwise(0.0))


def overlaps(detections: DataFrame) -> DataFrame:
    """Pairs of boxes of one clip, frame and group with their IoU and IoMin."""
    a, b = detections.alias("a"), detections.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("clip_id", "frame", "grp")]
    p, q = Box.of("a."), Box.of("b.")
    return a.join(b, [*same, F.col("a.seq") < F.col("b.seq")]).select(F.col("a.clip_id"), F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b"), F.round(p.iou(q), 6).alias("iou"), F.round(p.iomin(q), 6).alias("iomin"))


def unwrap(chained: DataFrame, width: float) -> DataFrame:
    """Boxes of each chain shifted by whole turns, each towards the one before it.

    Whole turns add up, so a lag and a running sum replace a sequential fold.
    """
    w = Window.partitionBy("clip_id", "chain_id").orderBy("frame", "seq")
    center = (F.col("x1") + F.col("x2")) / 2
    step = F.coalesce(F.rint((F.lag(center).over(w) - center) / width), F.lit(0.0))
    turned = chained.withColumn("_step", step).withColumn("turns", F.sum("_step").over(w).cast("long")).drop("_step")
    return turned.withColumns({"x1": F.col("x1") + F.col("turns") * width, "x2": F.col("x2") + F.col("turns") * width})
