"""GPS samples from telemetry packets: a tree of key, length and value records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Record keys and the types of numbers.
GPS5, GPS9, FIX, SCALE = b"GPS5", b"GPS9", b"GPSF", b"SCAL"
NUMBERS = {ord("l"): "i", ord("L"): "I", ord("s"): "h", ord("S"): "H", ord("b"): "b", ord("B"): "B", ord("f"): "f", ord("d"): "d"}
NINE = struct.Struct(">7i2H")


def records(data: bytes) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(key, type, size of an element, payload) of each record; a broken tail ends the sequence."""
    at = 0
    while at + 8 <= len(data):
        key, kind, size, repeat = struct.unpack_from(">4sBBH", data, at)
        length = size * repeat
        if key == b"\0\0\0\0" or at + 8 + length > len(data):
            return
        yield key, kind, size, data[at + 8 : at + 8 + length]
        at += 8 + (length + 3) // 4 * 4


def numbers(kind: int, payload: bytes) -> list[float]:
    code = NUMBERS.get(kind)
    if code is None:
        return []
    width = struct.calcsize(code)
    return list(struct.unpack(f">{len(payload) // width}{code}", payload[: len(payload) // width * width]))


def samples(data: bytes) -> list[tuple[float, float, float] | None]:
    """(lat, lon, alt) of the packet's rows in order; null where there was no fix or no position."""
    out: list = []
    inner = list(records(data))
    own = {key: (kind, payload) for key, kind, _, payload in inner}
    scale = [x or 1 for x in numbers(*own[SCALE])] if SCALE in own else [1]
    for key, kind, size, payload in inner:
        if kind == 0:
            out += samples(payload)
        elif key == GPS5 and kind == ord("l") and size == 20:
            fixed = FIX not in own or (numbers(*own[FIX]) or [0])[0] >= 2
            values = numbers(kind, payload)
            rows = [values[i : i + 5] for i in range(0, len(values) - 4, 5)]
            out += [_position(r, scale) if fixed else None for r in rows]
        elif key == GPS9 and size == NINE.size:
            rows = NINE.iter_unpack(payload[: len(payload) // size * size])
            out += [_position(r, scale) if r[8] / (scale[8] if len(scale) > 8 else 1) >= 2 else None for r in rows]
    return out


def _position(row, scale) -> tuple[float, float, float] | None:
    lat, lon, alt = (row[i] / (scale[i] if len(scale) > i else scale[0]) for i in range(3))
    return None if lat == 0 and lon == 0 else (lat, lon, alt)


def from_first_frame(samples: DataFrame, videos: DataFrame) -> DataFrame:
    """Samples (clip_id, time, ...) with times counted from the first frame of the video (clip_id, start: seconds, null is 0)."""
    origin = videos.select("clip_id", F.coalesce("start", F.lit(0.0)).alias("_start"))
    return samples.join(origin, "clip_id").withColumn("time", F.col("time") - F.col("_start")).drop("_start")


def gps_samples(packets: DataFrame) -> DataFrame:
    """(clip_id, time, lat, lon, alt) of packets (clip_id, start, duration, payload): a packet's rows are spread evenly over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                found = samples(p["payload"] or b"")
                rows += [(p["clip_id"], p["start"] + p["duration"] * i / len(found), *s) for i, s in enumerate(found) if s]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["clip_id", "time", "lat", "lon", "alt"])

    return packets.select("clip_id", "start", "duration", "payload").mapInArrow(run, "clip_id long, time double, lat double, lon double, alt double")
