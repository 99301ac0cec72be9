"""Linking and planning as a stream: chains leave the state once no later frame can reach them.

A gap longer than the link gap ends every chain of a group, so what came before
it is final: the group's own highest frame is its watermark. A plan of chains that
are final needs nothing of what follows, and so comes late by the link gap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.link import fold_fragments
from ..operators.plan import blur_plan
from ..options import Options

OUT = "clip_id bigint, grp string, chain_id string, frame bigint, seq bigint, cls string, score double, track_id string, x1 double, y1 double, x2 double, y2 double"
_NAMES = [part.split()[0] for part in OUT.split(", ")]
_KEPT = ("frame", "seq", "cls", "score", "track_id", "x1", "y1", "x2", "y2")


class GroupLinker:
    """Rows of one clip and group wait until their epoch is over; ``state`` is plain values, so a stream can keep it."""

    def __init__(self, clip_id: int, grp: str, o: Options, state: dict | None = None):
        self.clip_id, self.grp, self.o = clip_id, grp, o
        self.state = state or {"rows": [], "chains": 0, "frame": None}

    def take(self, rows: list[dict]) -> list[dict]:
        """Rows in order of (frame, seq); the rows that became final."""
        out, s = [], self.state
        for row in rows:
            if s["frame"] is not None and row["frame"] < s["frame"]:
                raise ValueError(f"frame {row['frame']} of clip {self.clip_id} came after frame {s['frame']}")
            if s["frame"] is not None and row["frame"] - s["frame"] > self.o.link_gap:
                out += self.close()
            s["rows"].append({k: row[k] for k in _KEPT})
            s["frame"] = row["frame"]
        return out

    def close(self) -> list[dict]:
        """The rows that wait, linked; chains are numbered on over all epochs of the group."""
        waiting, self.state["rows"] = self.state["rows"], []
        found = fold_fragments(self._in_order(waiting), self.o, self.o.wrap_width)
        before = self.state["chains"]
        self.state["chains"] = before + max((r["number"] + 1 for r in found), default=0)
        return [r | {"chain_id": r["key"] or f"{r['grp']}:~{before + r['number'] + 1}"} for r in found]

    def _in_order(self, rows: list[dict]) -> list[dict]:
        fragments: dict[str, list[dict]] = {}
        for r in rows:
            key = f"o{r['seq']}" if r["track_id"] is None else f"t{r['track_id']}"
            fragments.setdefault(key, []).append(r | {"_key": key, "_grp": self.grp, "clip_id": self.clip_id, "epoch": 0})

        def place(key: str) -> tuple:
            own = fragments[key]
            return own[0]["frame"], own[-1]["frame"], own[0]["track_id"] is not None, own[0]["seq"], key

        return [r for key in sorted(fragments, key=place) for r in fragments[key]]


def link_stream(detections: DataFrame, o: Options) -> DataFrame:
    """``operators.link.link`` for a stream of detections (clip_id, grp, frame, seq, cls, score, track_id, x1..y2) whose frames never go back within a clip.

    A row with a null ``seq`` ends its clip's group: what waits is given and the
    state goes. A track must not pause for longer than the link gap; those of the
    tracker end sooner. The state of a group is what came since the last such gap.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        ended = rows["seq"].isna().any()
        rows = rows.dropna(subset=["seq"]).astype({"frame": "int64", "seq": "int64"}).sort_values(["frame", "seq"])
        rows["track_id"] = rows["track_id"].astype(object).where(rows["track_id"].notna(), None)
        linker = GroupLinker(key[0], key[1], o, json.loads(state.get[0]) if state.exists else None)
        found = linker.take(rows.to_dict("records"))
        if ended:
            found += linker.close()
        if not ended:
            state.update((json.dumps(linker.state),))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame([[r[n] for n in _NAMES] for r in found], columns=_NAMES)

    columns = detections.select("clip_id", "grp", F.col("frame").cast("long").alias("frame"), F.col("seq").cast("long").alias("seq"), "cls", "score", "track_id", "x1", "y1", "x2", "y2")
    return columns.groupBy("clip_id", "grp").applyInPandasWithState(run, OUT, "linker string", "append", "NoTimeout")


def plan_stream(chained: DataFrame, o: Options, frame_count: int, path: str, checkpoint: str) -> StreamingQuery:
    """Plans of a stream of final chains, one folder ``batch=<n>`` a micro-batch, which a repeated micro-batch writes over."""

    def write(batch: DataFrame, number: int) -> None:
        blur_plan(batch, o, frame_count).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chained.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
