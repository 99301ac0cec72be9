"""The tracker as a stateful stream: tracks of each clip and class group live between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.track import GroupTracker, TrackOptions, track_rows

OUT = "clip_id bigint, grp string, frame bigint, seq bigint, track_id string"


def track_stream(detections: DataFrame, o: TrackOptions, scale: float = 1.0) -> DataFrame:
    """(clip_id, grp, frame, seq, track_id) of a stream of detections whose frames never go back within a clip.

    A row with a null ``seq`` ends its clip's group: the state goes. A frame must
    not be split over two micro-batches; logs are written a whole frame a line.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        ended = rows["seq"].isna().any()
        rows = rows.dropna(subset=["seq"]).astype({"frame": "int64", "seq": "int64"}).sort_values(["frame", "seq"]).to_dict("records")
        tracker = GroupTracker(o, json.loads(state.get[0]) if state.exists else None)
        if rows and tracker.state["frame"] is not None and rows[0]["frame"] <= tracker.state["frame"]:
            raise ValueError(f"frame {rows[0]['frame']} of clip {key[0]} came after frame {tracker.state['frame']}")
        found = track_rows(tracker, rows, scale)
        if not ended:
            state.update((json.dumps(tracker.state),))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame([(key[0], key[1], r["frame"], r["seq"], f"{key[1]}:{r['number']}") for r in found], columns=["clip_id", "grp", "frame", "seq", "track_id"])

    columns = detections.select("clip_id", "grp", F.col("frame").cast("long").alias("frame"), F.col("seq").cast("long").alias("seq"), "x1", "y1", "x2", "y2")
    return columns.groupBy("clip_id", "grp").applyInPandasWithState(run, OUT, "tracks string", "append", "NoTimeout")
