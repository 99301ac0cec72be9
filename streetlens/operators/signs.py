"""Sign tracks, their best observation, and where each was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.box import Box
from ..functions.rounding import round_half_even
from ..options import Options


# The tag of a traffic sign.
SIGN_KEY, SIGN_VALUE = "osm|traffic_sign", "yes"


def sign_tracks(chained: DataFrame, o: Options) -> DataFrame:
    """One row per track that is long and sure enough, with its best observation (score times area, earliest of equals)."""
    best = F.struct((F.col("score") * Box.of().area).alias("v"), -F.col("frame"), -F.col("seq"))
    rows = F.struct("frame", "seq", "x1", "y1", "x2", "y2", "score")
    found = chained.groupBy("clip_id", "chain_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.max("score").alias("confidence_max"), F.avg("score").alias("confidence_mean"), F.max_by(rows, best).alias("best")
    )
    return found.where((F.col("n") >= o.sign_length) & (F.col("confidence_max") >= o.conf_sign))


def display_shapes(tracks: DataFrame, o: Options, rotation: Column | int = 0) -> DataFrame:
    """Annotations: the best box as the frame is displayed, clipped to it and rounded half-even, at least one pixel wide and high.

    In a frame that closes sideways only the larger visible part of the box
    counts; ``rotation`` are the degrees by which the coded frame is turned.
    """
    degrees = rotation if isinstance(rotation, Column) else F.lit(rotation)
    best = Box.of("best.")
    if o.wrap_width:
        part = F.array_max(F.transform(best.split(o.wrap_width), lambda p, i: F.struct((p["right"] - p["left"]).alias("w"), (-i).alias("i"), p["left"].alias("left"), p["right"].alias("right"))))
        best = Box(part["left"], best.y1, part["right"], best.y2)
    turned = F.pmod(F.rint(degrees / 90).cast("int"), F.lit(2)) == 1
    shown = best.rotate(degrees, o.width, o.height)
    flat, tall = shown.clip(o.width, o.height), shown.clip(o.height, o.width)
    box = Box(*(F.when(turned, t).otherwise(f) for f, t in zip((flat.x1, flat.y1, flat.x2, flat.y2), (tall.x1, tall.y1, tall.x2, tall.y2), strict=True)))
    x1, y1 = F.rint(box.x1).cast("long"), F.rint(box.y1).cast("long")
    sides = x1.alias("x1"), y1.alias("y1"), F.greatest(F.rint(box.x2).cast("long"), x1 + 1).alias("x2"), F.greatest(F.rint(box.y2).cast("long"), y1 + 1).alias("y2")
    facts = ["n", "last_frame", "confidence_max", "confidence_mean"]
    return tracks.select("clip_id", "chain_id", "first_frame", F.col("best.frame").alias("frame"), *sides, (F.col("best.frame") / F.lit(o.fps)).alias("time"), F.col("best.score").alias("score"), *(c for c in facts if c in tracks.columns))


def published(annotations: DataFrame, classes: DataFrame, o: Options, api: str, model: str | None, version: str | None) -> DataFrame:
    """What is said of each annotation: (clip_id, chain_id, cls, first_frame, last_frame, first/last/best times, observations, confidences, and semantic tags as key and value).

    ``classes`` is (clip_id, chain_id, cls); times are three decimals, and so are scores.
    """

    def seconds(frame: str) -> Column:
        return round_half_even(F.col(frame) / F.lit(o.fps), 3)

    tag = F.lit(f"{api}-{model or 'unknown'}/{version or 'unknown'}")
    score = F.format_string("%.3f", round_half_even(F.col("score"), 3))
    sign = f"{SIGN_KEY}={SIGN_VALUE}"
    tags = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in ((SIGN_KEY, F.lit(SIGN_VALUE)), (f"detection_model[{sign}]", tag), (f"detection_confidence[{sign}]", score))))
    return annotations.join(classes, ["clip_id", "chain_id"]).select(
        "clip_id", "chain_id", "cls", "x1", "y1", "x2", "y2", F.col("frame").alias("best_frame"), seconds("frame").alias("best_timestamp"), "first_frame", seconds("first_frame").alias("first_timestamp"),
        "last_frame", seconds("last_frame").alias("last_timestamp"), F.col("n").alias("observations"), round_half_even(F.col("confidence_max"), 3).alias("confidence_max"), round_half_even(F.col("confidence_mean"), 3).alias("confidence_mean"), tags.alias("semantics"),
    )


def best_frames(annotations: DataFrame) -> DataFrame:
    """The frames to extract per clip, each once, with how many annotations want it."""
    return annotations.groupBy("clip_id", "frame").agg(F.count(F.lit(1)).alias("annotations"), F.min("chain_id").alias("first_chain"))


def position_at(times: DataFrame, samples: DataFrame, slack: float = 1.0) -> DataFrame:
    """``times`` (clip_id, time, ...) with lat and lon (and alt, if there) interpolated between samples (clip_id, time, lat, lon).

    Outside the samples the nearest end counts up to ``slack`` seconds, then null.
    One union, one window: samples carry themselves forward and backward to the times between them.
    """
    cols = times.columns
    values = [c for c in ("lat", "lon", "alt") if c in samples.columns]
    sample = F.struct("time", *values)
    both = times.withColumn("_s", F.lit(None).cast("struct<time:double," + ",".join(f"{c}:double" for c in values) + ">")).unionByName(samples.select("clip_id", "time", sample.alias("_s")), allowMissingColumns=True)
    w = Window.partitionBy("clip_id").orderBy("time", F.col("_s").isNull())
    v = Window.partitionBy("clip_id").orderBy("time", F.col("_s").isNotNull())
    near = both.withColumns({"_a": F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first("_s", True).over(v.rowsBetween(0, Window.unboundedFollowing))}).where("_s is null")
    span = F.col("_b.time") - F.col("_a.time")
    t = F.when(span > 0, (F.col("time") - F.col("_a.time")) / span).otherwise(0.0)

    def at(c: str):
        inside = F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * t
        after = F.when(F.col("time") - F.col("_a.time") <= slack, F.col(f"_a.{c}"))
        before = F.when(F.col("_b.time") - F.col("time") <= slack, F.col(f"_b.{c}"))
        return F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), inside).when(F.col("_a").isNotNull(), after).otherwise(before)

    return near.select(*cols, *(at(c).alias(c) for c in values))


def metadata(annotations: DataFrame, videos: DataFrame) -> DataFrame:
    """(clip_id, body): what is published of each clip (clip_id, width, height, duration_s, frame_count, projection) as JSON, fields without value left out.

    Annotations come in order of (first_frame, chain_id), their position where ``lat`` and ``lon`` are known.
    """
    position = F.when(F.col("lat").isNotNull(), F.struct(round_half_even(F.col("lat"), 7).alias("lat"), round_half_even(F.col("lon"), 7).alias("lon")))
    item = F.struct(F.array("x1", "y1", "x2", "y2").alias("shape"), F.struct(F.col("chain_id").alias("track"), F.col("frame").alias("best_frame"), round_half_even(F.col("time"), 3).alias("best_timestamp")).alias("video"), position.alias("position"))
    listed = annotations.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("first_frame", "chain_id", item.alias("a")))).alias("a"))
    facts = F.struct("width", "height", round_half_even(F.col("duration_s"), 3).alias("duration_s"), "frame_count", "projection").alias("video")
    found = F.coalesce(F.transform("a", lambda x: x["a"]), F.array())
    return videos.join(listed, "clip_id", "left").select("clip_id", F.to_json(F.struct(facts, found.alias("annotations"))).alias("body"))
