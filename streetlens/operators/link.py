"""Order-dependent steps: merging duplicate boxes and linking fragments to chains.

Both are folds over an ordered group. Groups are brought together by a hash
partitioning and a sort inside the partitions, and streamed through one Python
function; no group needs a task of its own, and only one is held at a time.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import Options

Box = tuple[float, float, float, float]


def fold_groups(df: DataFrame, keys: list[str], order: list, fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Apply ``fold`` to the ordered rows of each group; it returns rows of ``schema``."""
    arranged = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    if group:
                        out += fold(group)
                    at, group = key, []
                group.append(row)
            if out:
                yield table(out)
        if group:
            yield table(fold(group))

    empty = df.sparkSession.createDataFrame([], schema)
    kinds = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in empty.schema.fields])

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.field(n).type) for n in names], schema=kinds)

    return arranged.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _box(row: dict) -> Box:
    return row["x1"], row["y1"], row["x2"], row["y2"]


def _overlap(a: Box, b: Box) -> tuple[float, float, float]:
    """Areas of the intersection and of both boxes."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return max(0.0, w) * max(0.0, h), max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1]), max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def _turned(box: Box, towards: float, width: float | None) -> Box:
    """``box`` shifted by whole turns so that its centre is nearest to ``towards``."""
    if not width:
        return box
    by = round((towards - (box[0] + box[2]) / 2) / width) * width
    return box[0] + by, box[1], box[2] + by, box[3]


def merge_duplicates(detections: DataFrame, o: Options, wrap_width: float | None = None) -> DataFrame:
    """One row per object seen in a frame by several passes: (clip_id, frame, grp, cls, score, n, passes, x1..y2).

    Boxes are taken by falling score and join the first cluster that one of
    its members overlaps enough. A cluster has the class and score of its best
    box; blurred groups get the union of the boxes, signage the best one.
    """

    def fold(rows: list[dict]) -> list[dict]:
        clusters: list[dict] = []
        for row in rows:
            box = _box(row)
            for cluster in clusters:
                first = cluster["members"][0]
                moved = _turned(box, (first[0] + first[2]) / 2, wrap_width)
                if any(duplicate(moved, m) for m in cluster["members"]):
                    cluster["members"].append(moved)
                    if row["pass_id"] not in cluster["passes"]:
                        cluster["passes"].append(row["pass_id"])
                    break
            else:
                clusters.append({"best": row, "members": [box], "passes": [row["pass_id"]]})
        return [finish(c) for c in clusters]

    def duplicate(a: Box, b: Box) -> bool:
        both, one, two = _overlap(a, b)
        union, least = one + two - both, min(one, two)
        return (union > 0 and both / union >= o.merge_iou) or (least > 0 and both / least >= o.merge_iomin)

    def finish(cluster: dict) -> dict:
        best, members = cluster["best"], cluster["members"]
        x1, y1, x2, y2 = members[0]
        if best["grp"] != "signage":
            x1, y1, x2, y2 = min(m[0] for m in members), min(m[1] for m in members), max(m[2] for m in members), max(m[3] for m in members)
        if wrap_width:
            by = math.floor(x1 / wrap_width) * wrap_width
            x1, x2 = x1 - by, x2 - by
        return {k: best[k] for k in ("clip_id", "frame", "grp", "cls", "score")} | {"n": len(members), "passes": cluster["passes"], "x1": x1, "y1": y1, "x2": x2, "y2": y2}

    schema = "clip_id bigint, frame bigint, grp string, cls string, score double, n bigint, passes array<string>, x1 double, y1 double, x2 double, y2 double"
    columns = detections.select("clip_id", "frame", "grp", "seq", "cls", "score", "pass_id", "x1", "y1", "x2", "y2")
    return fold_groups(columns, ["clip_id", "frame", "grp"], [F.desc("score"), "seq"], fold, schema)


class _Chain:
    """What linking needs of a chain: where its last observations were."""

    def __init__(self, number: int, key: str | None, samples: int):
        self.number, self.key, self.tail = number, key, deque(maxlen=samples)

    @property
    def end(self) -> int:
        return self.tail[-1][0]

    def at(self, frame: int) -> Box:
        """Its box carried on to ``frame`` with the mean motion of the last observations."""
        (f0, b0), (f1, b1) = self.tail[0], self.tail[-1]
        if f1 <= f0:
            return b1
        return tuple(v + (v - u) / (f1 - f0) * (frame - f1) for u, v in zip(b0, b1, strict=True))


def _nearness(chain: _Chain, frame: int, box: Box, o: Options, wrap_width: float | None) -> float | None:
    """Distance in box sizes from where the chain would be, null if it can't be the same object."""
    gap = frame - chain.end
    if gap <= 0:
        return None
    there = chain.at(frame)
    box = _turned(box, (there[0] + there[2]) / 2, wrap_width)
    sides = [max(0.0, b[k + 2] - b[k]) for b in (there, box) for k in (0, 1)]
    apart = math.hypot((there[0] + there[2] - box[0] - box[2]) / 2, (there[1] + there[3] - box[1] - box[3]) / 2) / max(*sides, 1.0)
    ratio = max(sides[0] * sides[1], 1.0) / max(sides[2] * sides[3], 1.0)
    return apart if apart <= o.link_distance * (1 + 0.1 * gap) and 1 / o.area_ratio <= ratio <= o.area_ratio else None


def fold_fragments(rows: list[dict], o: Options, wrap_width: float | None = None) -> list[dict]:
    """Rows of one epoch, fragment by fragment in linking order, with the ``number`` and ``key`` of their chain; numbers begin at 0."""
    out: list[dict] = []
    active: list[_Chain] = []
    made, i = 0, 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j]["_key"] == rows[i]["_key"]:
            j += 1
        fragment, i = rows[i:j], j
        start = fragment[0]["frame"]
        active = [c for c in active if start - c.end <= o.link_gap]
        chain = min(((d, c.number, c) for c in active if (d := _nearness(c, start, _box(fragment[0]), o, wrap_width)) is not None), default=(0, 0, None), key=lambda x: x[:2])[2]
        if chain is None:
            chain = _Chain(made, fragment[0]["track_id"], o.velocity_samples)
            made += 1
            active.append(chain)
            before = _box(fragment[0])
        else:
            before = chain.tail[-1][1]
        for row in fragment:
            before = _turned(_box(row), (before[0] + before[2]) / 2, wrap_width)
            chain.tail.append((row["frame"], before))
            out.append({k: row[k] for k in ("clip_id", "epoch", "frame", "seq", "cls", "score", "track_id")} | {"grp": row["_grp"], "number": chain.number, "key": chain.key, "x1": before[0], "y1": before[1], "x2": before[2], "y2": before[3]})
    return out


def link(detections: DataFrame, o: Options, wrap_width: float | None = None) -> DataFrame:
    """``detections`` with ``chain_id``: tracks and orphans of one group linked where one goes on where another ended.

    Fragments come by (start, end), orphans before tracks. Each joins the
    nearest chain of its group that ended at most the link gap before, is near
    enough for the gap and of similar area; the older chain wins ties. A chain
    has the name of its first fragment; if that was an orphan, that of its group
    and its number among all chains of the group. With ``wrap_width`` boxes of a chain are unwrapped across the seam.

    A fragment that starts more than the gap after all earlier ones ended
    begins an epoch of its own: epochs are folded apart, so a long clip is many
    groups, not one.
    """
    key = F.coalesce(F.concat(F.lit("t"), "track_id"), F.concat(F.lit("o"), F.col("seq").cast("string")))
    named = detections.withColumn("_key", key)
    own = Window.partitionBy("clip_id", "_key")
    named = named.withColumns({"_start": F.min("frame").over(own), "_end": F.max("frame").over(own), "_first": F.min(F.struct("frame", "seq")).over(own), "_grp": F.min_by("grp", F.struct("frame", "seq")).over(own)})
    w = Window.partitionBy("clip_id", "_grp").orderBy("_start").rangeBetween(Window.unboundedPreceding, -1)
    # all rows of a start share an epoch: what began before decides
    gone = named.groupBy("clip_id", "_grp", "_start").agg(F.max("_end").alias("_e"))
    v = Window.partitionBy("clip_id", "_grp").orderBy("_start")
    new = F.when(F.col("_start") - F.max("_e").over(w) > o.link_gap, 1).otherwise(0)
    epochs = gone.withColumn("_new", new).withColumn("epoch", F.sum("_new").over(v)).select("clip_id", "_grp", "_start", "epoch")
    ready = named.join(epochs, ["clip_id", "_grp", "_start"])
    order = ["_start", "_end", F.col("track_id").isNotNull(), F.col("_first.frame"), F.col("_first.seq"), "_key", "frame", "seq"]
    ready = ready.select("clip_id", "_grp", "epoch", "_start", "_end", "track_id", "_key", "_first", "frame", "seq", "cls", "score", "x1", "y1", "x2", "y2")

    def fold(rows: list[dict]) -> list[dict]:
        return fold_fragments(rows, o, wrap_width)

    schema = "clip_id bigint, epoch bigint, frame bigint, seq bigint, cls string, score double, track_id string, grp string, number bigint, key string, x1 double, y1 double, x2 double, y2 double"
    found = fold_groups(ready, ["clip_id", "_grp", "epoch"], order, fold, schema)
    # a chain that an orphan began is named by its place among all chains of its clip and group, in the order they were made
    made = F.dense_rank().over(Window.partitionBy("clip_id", "grp").orderBy("epoch", "number"))
    return found.withColumn("chain_id", F.coalesce("key", F.concat("grp", F.lit(":~"), made.cast("string")))).drop("epoch", "number", "key")
