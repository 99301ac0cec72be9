"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Equal texts share a point of the ring. The ring is cut into cells, several
hundred for each shard; a cell goes to the next virtual node clockwise, and on
to the next shard with room when that one is full. Only a *hot* group of equal
texts, one heavier than ``HOT`` of the mean shard, is divided: its rows are
dealt to parts with points of their own.

Units (cells and parts of hot groups) are placed heaviest first. A unit fits a
shard if this then holds at most the greater of ``1 + SLACK`` times the mean
load and of the mean of what is placed so far plus the unit. The least loaded
shard always has that room, so every unit finds a place and the bound holds for
all shards: they end near equal as soon as the last units are small.

Rows are handled by DataFrame operations only. The driver sees one load for a
cell and hot part; their number depends on the shards alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import driver_table, materialize, slim

#: Cells of the ring at least, and for each shard; virtual nodes of a shard; capacity above the mean.
CELLS, CELLS_PER_SHARD = 1 << 15, 512
VIRTUAL = 64
SLACK = 0.001
#: A group of equal texts above this share of the mean shard is divided, into parts of about ``PART`` of it.
HOT, PART = 0.25, 1 / 64
#: Rows of a shard within which slots are counted together, about, and how many such buckets a shard has at least.
SLOT_ROWS, SLOT_BUCKETS = 1_000_000, 64


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """(points ascending, shards) of the virtual nodes; a shard's points do not depend on the number of shards."""
    points = np.array([int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> 1 for s in range(shards) for v in range(virtual)], np.int64)
    owners = np.repeat(np.arange(shards), virtual)
    order = np.argsort(points, kind="stable")
    return points[order], owners[order]


def place(units: list[tuple[int, int, int]], shards: int, slack: float = SLACK) -> list[tuple[int, int]]:
    """(unit, shard) for (unit, point of the ring, load): heaviest first, clockwise past full shards."""
    points, owners = ring(shards)
    around = np.concatenate([owners, owners])
    total = sum(load for _, _, load in units)
    fair = -(-total * (1000 + round(1000 * slack)) // (1000 * shards))
    loads, placed, out = np.zeros(shards, np.int64), 0, []
    for unit, point, load in sorted(units, key=lambda u: (-u[2], u[0])):
        room = max(fair, -(-placed // shards) + load) - load
        at, step = int(np.searchsorted(points, point)) % len(points), 4
        while True:  # ever longer stretches of virtual nodes
            free = loads[around[at : at + step]] <= room
            if free.any():
                break
            step *= 4
        shard = int(around[at + int(free.argmax())])
        loads[shard] += load
        placed += load
        out.append((unit, shard))
    return out


def point_of(name: str) -> int:
    """The point of the ring that a name stands for."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big") >> 1


def row_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 16."""
    return (F.octet_length(text) + F.lit(16)).cast("long")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    ``law`` is ``bytes``: the shards' sizes are near equal. ``slot`` counts a
    shard's rows from 0 without gaps. Equal texts share a shard unless their
    group is heavier than ``HOT`` of the mean shard; only which rows of such a
    group go where depends on the order of the input. A null text is empty;
    null and repeated ids and repeated rows are rows like others; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bits = max(CELLS, CELLS_PER_SHARD * shards - 1).bit_length() - (0 if shards * CELLS_PER_SHARD > CELLS else 1)
    text = F.col("text")
    rows = slim(docs, id_col, text_col).select("doc_id", row_size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    # the top bits of the hash are the cell; ``salt`` deals rows that are otherwise alike
    rows = materialize(rows.withColumns({"cell": F.shiftrightunsigned("h", 64 - bits), "salt": F.xxhash64("doc_id", "row")}), "shard-rows")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    group = ["h", "text_crc32"]
    # at most shards / HOT groups are hot
    hot = [(r["h"], r["text_crc32"], r["load"]) for r in rows.groupBy(*group).agg(F.sum("size").alias("load")).where(F.col("load") > HOT * total / shards).collect()]
    parts, first = [], 1 << bits
    for h, crc, load in sorted(hot):
        n = int(-(-load // max(1.0, PART * total / shards)))
        parts.append((h, crc, first, n))
        first += n
    unit = F.when(F.col("parts").isNull(), F.col("cell")).otherwise(F.col("first") + F.pmod("salt", "parts")).cast("long")
    dealt = rows.join(F.broadcast(driver_table(spark, parts, "h long, text_crc32 long, first long, parts long", "shard-hot")), group, "left").withColumn("unit", unit)
    loads = {r["unit"]: r["load"] for r in dealt.groupBy("unit").agg(F.sum("size").alias("load")).collect()}
    points = {u: (u << (63 - bits)) for u in loads if u < 1 << bits} | {f + i: point_of(f"{h}/{crc}/{i}") for h, crc, f, n in parts for i in range(n)}
    placed = driver_table(spark, place([(u, points[u], n) for u, n in loads.items()], shards), "unit long, shard int", "shard-units")
    buckets = max(SLOT_BUCKETS, count // (shards * SLOT_ROWS))
    at = dealt.join(F.broadcast(placed), "unit").withColumn("bucket", F.pmod("salt", F.lit(buckets)).cast("int"))
    # slots: rows before the bucket in its shard, then the rank within the bucket
    sizes = at.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("salt", "doc_id", "row"))
    return at.withColumn("rank", rank).join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
