"""Results kept by key: digests of everything that changes them, and what a request can reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What changes detections, what changes track ids, how many hex digits a key has.
DETECTION = ("conf", "equirect_pad_ratio", "max_frames", "model", "policy", "profile", "projection", "tile_trigger_width")
TRACKING = ("tracker", "width")
DIGITS = 12


def key(*columns: str) -> Column:
    """A key of the values of ``columns`` whatever their order: digest of a JSON object with sorted names, nulls written."""
    value = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(value, 256), 1, DIGITS)


def with_keys(requests: DataFrame) -> DataFrame:
    """``requests`` with ``det_key`` and ``track_key`` of the columns in DETECTION and TRACKING."""
    return requests.withColumns({"det_key": key(*DETECTION), "track_key": key(*TRACKING)})


def reuse(requests: DataFrame, kept: DataFrame) -> DataFrame:
    """(clip_id, det_key, track_key, action, base) of each distinct request.

    ``kept`` (clip_id, det_key, track_key, complete) are results of earlier
    runs; those cut short don't count. ``cached``: the very result is there;
    ``retrack``: detections are there under the track key ``base``, the first by
    name, so only tracking runs; ``detect``: nothing is there.
    """
    whole = kept.where("complete").groupBy("clip_id", "det_key").agg(F.collect_set("track_key").alias("there"))
    wanted = requests.select("clip_id", "det_key", "track_key").distinct()
    joined = wanted.join(whole, ["clip_id", "det_key"], "left")
    hit = F.array_contains("there", F.col("track_key"))
    action = F.when(F.col("there").isNull(), "detect").when(hit, "cached").otherwise("retrack")
    return joined.select("clip_id", "det_key", "track_key", action.alias("action"), F.when(action == "retrack", F.array_min("there")).alias("base"))
