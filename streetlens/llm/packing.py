"""Bounded-space online packing of token sequences into windows of fixed length.

Every partition keeps a fixed number of open windows. A document is cut where
it fills windows of its own; what is left goes into the open window where it
fits best. When none fits, the fullest open window is emitted and a new one
opened. What is still open at the end of a partition is merged: the windows of
groups of partitions meet in one task each and are packed again, best fit
first.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slim, tune
from .tokens import encoder

#: Windows that a partition keeps open.
OPEN = 64
#: Open windows that one merging task gets, about.
MERGE = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean, used long"


class Packer:
    """Places piece lengths in at most ``spaces`` open windows of ``size`` tokens; windows get ascending numbers."""

    def __init__(self, size: int, spaces: int, first: int = 0):
        self.size, self.spaces, self.next = size, spaces, first
        self.open: list[tuple[int, int]] = []  # (tokens free, window), ascending

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece of 1 to ``size`` tokens."""
        if length == self.size:
            self.next += 1
            return self.next - 1, 0
        at = bisect_left(self.open, (length, -1))
        if at == len(self.open):
            if len(self.open) == self.spaces:
                self.open.pop(0)  # the fullest
            free, window = self.size, self.next
            self.next += 1
        else:
            free, window = self.open.pop(at)
        if free > length:
            insort(self.open, (free - length, window))
        return window, self.size - free


def pack_partition(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, OPEN, TaskContext.get().partitionId() << 40)
        enc = encoder(path)
        tail: dict[int, list[tuple]] = {}  # pieces in windows that are still open
        for batch in batches:
            done = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                total = len(ids)
                for start in range(0, total, size):
                    piece = ids[start : start + size]
                    window, offset = packer.place(len(piece))
                    row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), total, window, offset)
                    if len(piece) == size:
                        done.append((*row, False, size))
                    else:
                        tail.setdefault(window, []).append(row)
            still = {w for _, w in packer.open}
            for w in [w for w in tail if w not in still]:
                done += [(*r, False, 0) for r in tail.pop(w)]
            yield _rows(done)
        used = {w: size - free for free, w in packer.open}
        yield _rows([(*r, True, used[w]) for w, rows in tail.items() for r in rows])

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "open", "used"]
    kinds = [pa.int64()] * 7 + [pa.bool_(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _merge(size: int):
    """From (part, window, used) of one part: where each open window goes, as (window, to, base)."""

    def run(table: pa.Table) -> pa.Table:
        used, windows = table.column("used").to_pylist(), table.column("window").to_pylist()
        packer, names, rows = Packer(size, len(used) + 1), {}, []
        for u, w in sorted(zip(used, windows, strict=True), key=lambda x: (-x[0], x[1])):
            to, base = packer.place(u)
            rows.append((w, names.setdefault(to, w), base))  # a merged window keeps the name of its first part
        columns = list(zip(*rows, strict=True))
        return pa.table({"window": pa.array(columns[0], pa.int64()), "to": pa.array(columns[1], pa.int64()), "base": pa.array(columns[2], pa.int64())})

    return run


def pack(docs: DataFrame, path: str, end_id: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), all long, for each piece of each row of ``docs``.

    * A document is the ids of its text by the vocabulary file ``path`` plus
      ``end_id``; an empty or null text is the end id alone. Each id lies in
      exactly one piece; a document of more than ``size`` ids is cut every
      ``size`` ids, and no other one is.
    * A sequence has at most ``size`` ids; its pieces lie gapless from offset 0.
    * Repeated rows are packed each; an empty table gives an empty result; null
      ids are kept and other columns ignored. Which sequence a piece is in
      depends on how the input is partitioned, and on nothing else.
    """
    spark = docs.sparkSession
    tune(spark)
    pieces = materialize(slim(docs, id_col, text_col).mapInArrow(pack_partition(path, end_id, size), SCHEMA), "pack-pieces")
    open_windows = pieces.where("open").select("window", "used").distinct()
    parts = max(1, open_windows.count() // MERGE)
    merged = open_windows.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts))).groupBy("part").applyInArrow(_merge(size), "window long, to long, base long")
    moved = pieces.join(merged, "window", "left")
    return moved.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("to", "window").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
