"""Detectors over frames: any model that gives boxes, known by a name, in one step or in two.

A detector is a factory, so that each Python worker builds its model once, at the
first batch. It sees whole batches of frames, of as many rows as Arrow gives it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One box that a pass found: (class, score, x1, y1, x2, y2) in the pass's own input.
Found = tuple[str, float, float, float, float, float]
OUT = "clip_id bigint, frame bigint, pass_id string, seq bigint, cls string, score double, x1 double, y1 double, x2 double, y2 double"
_KINDS = pa.schema([("clip_id", pa.int64()), ("frame", pa.int64()), ("pass_id", pa.string()), ("seq", pa.int64()), ("cls", pa.string()), ("score", pa.float64()), *((s, pa.float64()) for s in ("x1", "y1", "x2", "y2"))])


class Detector(Protocol):
    """``infer`` takes what ``prepare`` made of the inputs (dicts of a row's columns) and gives the boxes of each, in order."""

    classes: tuple[str, ...]

    def prepare(self, inputs: list[dict]) -> list[Any]: ...

    def infer(self, prepared: list[Any]) -> list[list[Found]]: ...


class Simple:
    """A detector made of one function from an input to its boxes."""

    def __init__(self, detect: Callable[[dict], list[Found]], classes: tuple[str, ...]):
        self.detect, self.classes = detect, classes

    def prepare(self, inputs: list[dict]) -> list[dict]:
        return inputs

    def infer(self, prepared: list[dict]) -> list[list[Found]]:
        return [self.detect(x) for x in prepared]


FACTORIES: dict[str, Callable[[], Detector]] = {}


def register(name: str, make: Callable[[], Detector]) -> None:
    """Make a detector known by a name, which may be used once only."""
    if name in FACTORIES:
        raise ValueError(f"a detector named {name!r} is known already")
    FACTORIES[name] = make


def inputs(frames: DataFrame, passes: DataFrame) -> DataFrame:
    """Every frame (clip_id, frame, ...) with each pass (clip_id, id, ...) of its clip, as ``pass_id`` and the struct ``pass``; a video has few passes."""
    each = passes.select("clip_id", F.col("id").alias("pass_id"), F.struct(*(c for c in passes.columns if c != "clip_id")).alias("pass"))
    return frames.join(each, "clip_id")


def detect(frames: DataFrame, detector: str | Callable[[], Detector], batch: int = 8) -> DataFrame:
    """(clip_id, frame, pass_id, seq, cls, score, x1..y2): what a detector finds in rows (clip_id, frame, pass_id, ...).

    ``seq`` numbers the boxes of one input from 0. A model sees at most ``batch``
    inputs at a time. A class that the detector does not name is an error: a box
    of an unknown class would be left unblurred.
    """
    if isinstance(detector, str) and detector not in FACTORIES:
        raise ValueError(f"no detector is named {detector!r}; known are {sorted(FACTORIES)}")
    make = FACTORIES[detector] if isinstance(detector, str) else detector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                model = model or make()
                part = rows.slice(start, batch).to_pylist()
                found = model.infer(model.prepare(part))
                if len(found) != len(part):
                    raise ValueError(f"the detector gave boxes of {len(found)} inputs for {len(part)}")
                out = [(r["clip_id"], r["frame"], r["pass_id"], i, *box) for r, boxes in zip(part, found, strict=True) for i, box in enumerate(boxes)]
                if unknown := sorted({r[4] for r in out} - set(model.classes)):
                    raise ValueError(f"the detector gave classes {unknown} that it does not name")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _KINDS, strict=True)], schema=_KINDS)

    return frames.mapInArrow(run, OUT)


def scripted(script: DataFrame, frames: DataFrame) -> DataFrame:
    """A detector that finds what a table (clip_id, frame, pass_id, seq, cls, score, x1..y2) says, in the frames and passes that are there."""
    return script.join(frames.select("clip_id", "frame", "pass_id").distinct(), ["clip_id", "frame", "pass_id"], "left_semi")


def with_frames(cached: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections kept of an earlier run (clip_id, frame, ...) beside the frames decoded now (clip_id, frame, ...), for tracking again.

    A frame without detections keeps its row, with ``seq`` null. A detection of a
    frame that is not there is an error: the cache is of another video.
    """
    key = ["clip_id", "frame"]
    both = frames.withColumn("_there", F.lit(True)).join(cached, key, "full")
    lost = F.raise_error(F.concat(F.lit("frame "), F.col("frame").cast("string"), F.lit(" of clip "), F.col("clip_id").cast("string"), F.lit(" is not in the video")))
    return both.withColumn("frame", F.when(F.col("_there"), F.col("frame")).otherwise(lost)).drop("_there")
