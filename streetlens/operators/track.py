"""Track ids by optimal assignment of boxes from frame to frame.

The state of one class group of a clip is the list of its live tracks. Batch
and stream share it: ``assign_tracks`` folds whole tables, the stream keeps the
same state between micro-batches (``streaming.tracker``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .link import fold_groups

BoxTuple = tuple[float, float, float, float]
FLOW = "array<struct<x:double,y:double,dx:double,dy:double>>"
#: Cost of a pair that must not match; far above the sum of allowed ones.
FORBIDDEN = 1e6


# Defaults that results depend on.
@dataclass(frozen=True)
class TrackOptions:
    max_missed: int = 30
    gate: float = 2.0
    gate_cap: float = 32.0
    large_gate: float = 0.5
    min_size: float = 4.0
    area_ratio: float = 4.0
    context: float = 1.0
    flow_points: int = 3
    wrap_width: float | None = None


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of least total cost, as many as the smaller side has, by shortest augmenting paths."""
    rows, cols = cost.shape
    if rows > cols:
        return sorted((i, j) for j, i in assignment(cost.T))
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    row_of = np.full(cols, -1)
    for start in range(rows):
        # a shortest path tree from the row grows until it meets a free column
        distance, before, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        row, reached, at = start, 0.0, -1
        while True:
            through = reached + cost[row] - row_price[row] - col_price
            closer = ~done & (through < distance)
            distance[closer], before[closer] = through[closer], at
            at = int(np.argmin(np.where(done, np.inf, distance)))
            reached = distance[at]
            done[at] = True
            if row_of[at] < 0:
                break
            row = row_of[at]
        gain = reached - distance[done]
        owners = row_of[done]
        row_price[owners[owners >= 0]] += gain[owners >= 0]
        row_price[start] += reached
        col_price[done] -= gain
        while at >= 0:
            previous = before[at]
            row_of[at] = row_of[previous] if previous >= 0 else start
            at = int(previous)
    return sorted((int(i), j) for j, i in enumerate(row_of) if i >= 0)


class GroupTracker:
    """Live tracks of one clip and class group; ``state`` is plain lists, so a stream can keep it."""

    def __init__(self, o: TrackOptions, state: dict | None = None):
        self.o = o
        self.state = state or {"frame": None, "made": 0, "tracks": []}

    def frame(self, number: int, boxes: list[BoxTuple], flow: np.ndarray | None = None) -> list[int]:
        """The track numbers of the boxes of a frame; frames between this and the last one had none.

        ``flow`` has a row (x, y, dx, dy) for each image point followed from the
        frame before. A track moves by the median of the points around it, and
        by its last motion where they are too few.
        """
        o, state = self.o, self.state
        gap = number - state["frame"] if state["frame"] is not None else 1
        tracks = [{**t, "missed": t["missed"] + gap - 1} for t in state["tracks"]]
        tracks = [t for t in tracks if t["missed"] <= o.max_missed]
        for t in tracks:
            self._move(t, gap, flow)
        out, matched = [0] * len(boxes), set()
        if tracks and boxes:
            cost = np.array([[self._cost(t, b) for b in boxes] for t in tracks])
            for i, j in assignment(cost):
                if cost[i, j] < FORBIDDEN:
                    tracks[i] |= {"box": list(boxes[j]), "missed": -1}
                    out[j] = tracks[i]["id"]
                    matched.add(j)
        for t in tracks:
            t["missed"] += 1
        for j, box in enumerate(boxes):
            if j not in matched:
                state["made"] += 1
                out[j] = state["made"]
                tracks.append({"id": out[j], "box": list(box), "missed": 0, "motion": [0.0, 0.0]})
        state["tracks"] = [t for t in tracks if t["missed"] <= o.max_missed]
        state["frame"] = number
        return out

    def _move(self, track: dict, frames: int, flow: np.ndarray | None) -> None:
        """Shift a track's box over ``frames`` frames, the last of which ``flow`` is for."""
        o = self.o
        shift = [m * (frames - 1) for m in track["motion"]] * 2
        box = [v + m for v, m in zip(track["box"], shift, strict=True)]
        if flow is not None and len(flow):
            cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
            dx = flow[:, 0] - cx
            if o.wrap_width:
                dx = (dx + o.wrap_width / 2) % o.wrap_width - o.wrap_width / 2
            reach = [max(box[k + 2] - box[k], o.min_size) * (0.5 + o.context) for k in (0, 1)]
            near = (np.abs(dx) <= reach[0]) & (np.abs(flow[:, 1] - cy) <= reach[1])
            if near.sum() >= o.flow_points:
                track["motion"] = np.median(flow[near, 2:], axis=0).tolist()
        track["box"] = [v + m for v, m in zip(box, track["motion"] * 2, strict=True)]

    def _cost(self, track: dict, box: BoxTuple) -> float:
        """Distance of the centres in box sizes; forbidden beyond the gate or where the areas are too different."""
        o, there = self.o, track["box"]
        tw, th, bw, bh = (max(b[k + 2] - b[k], o.min_size) for b in (there, box) for k in (0, 1))
        size, ratio = max(tw, th, bw, bh), tw * th / (bw * bh)
        dx, dy = ((box[k] + box[k + 2] - there[k] - there[k + 2]) / 2 for k in (0, 1))
        if o.wrap_width:
            dx = (dx + o.wrap_width / 2) % o.wrap_width - o.wrap_width / 2
        apart = math.hypot(dx, dy)
        gate = max(o.gate * min(size, o.gate_cap), o.large_gate * size) * (1 + 0.5 * track["missed"])
        return apart / size if 1 / o.area_ratio <= ratio <= o.area_ratio and apart <= gate else FORBIDDEN


def track_rows(tracker: GroupTracker, rows: list[dict], scale: float) -> list[dict]:
    """Rows of one group in (frame, seq) order with their track ``number``; a row without ``seq`` holds the ``flow`` of its frame."""
    out, i = [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j]["frame"] == rows[i]["frame"]:
            j += 1
        number, frame, flow = rows[i]["frame"], [r for r in rows[i:j] if r["seq"] is not None], None
        for r in rows[i:j]:
            if r["seq"] is None:
                flow = np.array([(p["x"], p["y"], p["dx"], p["dy"]) for p in r["flow"] or []], float).reshape(-1, 4)
        i = j
        numbers = tracker.frame(number, [tuple(r[c] * scale for c in ("x1", "y1", "x2", "y2")) for r in frame], flow)
        out += [{**r, "number": n} for r, n in zip(frame, numbers, strict=True)]
    return out


def assign_tracks(detections: DataFrame, o: TrackOptions, scale: float = 1.0, flow: DataFrame | None = None) -> DataFrame:
    """(clip_id, grp, frame, seq, track_id) of detections; boxes are compared at ``scale``.

    ``flow`` (clip_id, frame, flow), if given, has one row a frame with the image
    points followed from the frame before, those that came back to where they
    began, at tracking scale; without it tracks stay where they were.

    Tracks die after ``max_missed`` frames without a box, so a longer gap of the
    group begins an epoch: epochs are folded apart, in parallel, and their
    numbers go on from one to the next.
    """
    ready = detections.select("clip_id", "grp", "frame", "seq", "x1", "y1", "x2", "y2", F.lit(None).cast(FLOW).alias("flow"))
    if flow is not None:
        groups = detections.select("clip_id", "grp").distinct()
        ready = ready.unionByName(groups.join(flow.select("clip_id", F.col("frame").cast("long").alias("frame"), F.col("flow").cast(FLOW).alias("flow")), "clip_id"), allowMissingColumns=True)
    w = Window.partitionBy("clip_id", "grp").orderBy("frame", "seq")
    seen = F.when(F.col("seq").isNotNull(), F.col("frame"))
    last = F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(seen.isNotNull() & (last.isNull() | (seen - last > o.max_missed + 1)), 1).otherwise(0)
    # the flow of the frame that begins an epoch sorts before its boxes, into the epoch before, where no track is alive
    ready = ready.withColumn("_new", new).withColumn("epoch", F.sum("_new").over(w)).drop("_new")

    def fold(rows: list[dict]) -> list[dict]:
        return track_rows(GroupTracker(o), rows, scale)

    found = fold_groups(ready, ["clip_id", "grp", "epoch"], ["frame", "seq"], fold, "clip_id bigint, grp string, epoch bigint, frame bigint, seq bigint, number bigint")
    ordered = Window.partitionBy("clip_id", "grp").orderBy("epoch")
    made = found.groupBy("clip_id", "grp", "epoch").agg(F.max("number").alias("made"))
    offset = made.withColumn("offset", F.coalesce(F.sum("made").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("made")
    named = found.join(offset, ["clip_id", "grp", "epoch"])
    return named.select("clip_id", "grp", "frame", "seq", F.concat("grp", F.lit(":"), (F.col("number") + F.col("offset")).cast("string")).alias("track_id"))
