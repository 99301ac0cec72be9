"""Packets that are copied along with a range of frames, as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "clip_id bigint, stream bigint, seq bigint, time double"


class RangeCopier:
    """Packets of one clip wait until the frames around them are known; ``state`` is plain values, so a stream can keep it.

    ``start`` is the time of the first rendered frame, ``end`` that of the last
    one and its duration. Packets from start to before end are given, with times
    from the start on. What waits is bounded by how far a container puts packets
    ahead of their frames.
    """

    def __init__(self, state: dict | None = None):
        self.state = state or {"start": None, "end": None, "waiting": []}

    def take(self, kind: str, stream: int, seq: int, time: float, duration: float) -> list[tuple[int, int, float]]:
        s = self.state
        if kind == "packet":
            s["waiting"].append((stream, seq, time))
            return [] if s["end"] is None else self._decide(float("inf"))
        if kind == "skipped":  # a frame before the range: what lies before it does, too
            s["waiting"] = [p for p in s["waiting"] if p[2] >= time]
            return []
        if s["start"] is None:
            s["start"] = time
        if kind == "last":
            s["end"] = time + duration
            return self._decide(float("inf"))
        return self._decide(time)

    def _decide(self, before: float) -> list[tuple[int, int, float]]:
        s = self.state
        ready = [p for p in s["waiting"] if p[2] < before]
        s["waiting"] = [p for p in s["waiting"] if p[2] >= before]
        return [(p[0], p[1], p[2] - s["start"]) for p in ready if s["start"] is not None and p[2] >= s["start"] and (s["end"] is None or p[2] < s["end"])]


def copy_stream(events: DataFrame) -> DataFrame:
    """(clip_id, stream, seq, time) of the packets of a clip's range.

    ``events`` (clip_id, seq, kind, stream, time, duration) are in order of
    ``seq``: ``packet`` rows, and frames as ``skipped``, ``rendered`` or ``last``.
    Packets after ``last`` are still decided; a clip's state goes with an ``end`` row.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        copier, out, over = RangeCopier(json.loads(state.get[0]) if state.exists else None), [], False
        for r in rows.itertuples():
            over = over or r.kind == "end"
            if r.kind != "end":
                out += [(key[0], *p) for p in copier.take(r.kind, r.stream, r.seq, r.time, r.duration)]
        if not over:
            state.update((json.dumps(copier.state),))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["clip_id", "stream", "seq", "time"])

    columns = events.select("clip_id", "seq", "kind", F.coalesce("stream", F.lit(-1)).cast("long").alias("stream"), "time", F.coalesce("duration", F.lit(0.0)).alias("duration"))
    return columns.groupBy("clip_id").applyInPandasWithState(run, OUT, "copier string", "append", "NoTimeout")
