"""Key frames of annotation tracks: expansion to every frame, and thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.box import SIDES, Box
from .link import fold_groups


def expand(keys: DataFrame, frames: int) -> DataFrame:
    """Every visible frame of tracks given by key frames (clip_id, track, frame, seq, outside, readable, x1..y2).

    Of several keys of a frame the last counts. A key with ``outside`` ends
    visibility; between two visible keys boxes are interpolated; the last key
    holds to the end of the clip.
    """
    last = keys.groupBy("clip_id", "track", "frame").agg(F.max_by(F.struct("outside", "readable", *SIDES), "seq").alias("k")).select("clip_id", "track", "frame", "k.*")
    w = Window.partitionBy("clip_id", "track").orderBy("frame")
    ahead = last.withColumns({f"n_{c}": F.lead(c).over(w) for c in ("frame", "outside", *SIDES)})
    stop = F.least(F.coalesce("n_frame", F.lit(frames)), F.lit(frames))
    seen = ahead.where(~F.col("outside") & (F.col("frame") < stop)).withColumn("at", F.explode(F.sequence(F.col("frame"), stop - 1)))
    t = (F.col("at") - F.col("frame")) / (F.col("n_frame") - F.col("frame"))
    moved = Box.of().lerp(Box.of("n_"), t)
    between = F.col("n_outside").isNotNull() & ~F.col("n_outside") & (F.col("at") > F.col("frame"))
    sides = [F.when(between, m).otherwise(F.col(s)).alias(s) for m, s in zip((moved.x1, moved.y1, moved.x2, moved.y2), SIDES, strict=True)]
    return seen.select("clip_id", "track", F.col("at").alias("frame"), "readable", *sides)


def thin(chained: DataFrame, step: int, max_gap: int) -> DataFrame:
    """Key boxes (clip_id, chain_id, segment, frame): one at least ``step`` frames after the last one kept.

    A new segment begins after a gap of more than ``max_gap`` frames; each ends
    with a key on its last frame.
    """

    def fold(rows: list[dict]) -> list[dict]:
        out, segment, kept, last = [], 0, None, None

        def keep(frame: int) -> None:
            out.append({"clip_id": rows[0]["clip_id"], "chain_id": rows[0]["chain_id"], "segment": segment, "frame": frame})

        for frame in [*dict.fromkeys(r["frame"] for r in rows), None]:
            ends = last is not None and (frame is None or frame - last > max_gap)
            if ends and kept != last:
                keep(last)
            if frame is None:
                break
            if ends:
                segment, kept = segment + 1, None
            if kept is None or frame - kept >= step:
                keep(frame)
                kept = frame
            last = frame
        return out

    return fold_groups(chained.select("clip_id", "chain_id", "frame"), ["clip_id", "chain_id"], ["frame"], fold, "clip_id bigint, chain_id string, segment bigint, frame bigint")
