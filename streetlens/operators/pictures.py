"""Pictures of best views: which frames, what is written into them, and the debug overlay as rows."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.box import SIDES, Box
from ..functions.rounding import round_half_even
from .catalog import overlay

# Colours (blue, green, red) of classes, of other classes to blur, and sources drawn dashed.
COLOURS = {"face": (255, 0, 255), "plate": (0, 215, 255), "sign": (255, 128, 0), "direction": (255, 255, 0)}
OTHER_BLUR = (0, 200, 0)
DASHED = ("interpolated", "padded")


def dms(value: Column) -> Column:
    """struct(degrees, minutes, seconds) of an absolute coordinate, seconds in ten-thousandths, half-even."""
    v = F.abs(value)
    degrees = F.floor(v)
    minutes = F.floor((v - degrees) * 60)
    return F.struct(degrees.alias("degrees"), minutes.alias("minutes"), F.rint((v - degrees - minutes / 60) * 3600 * 10000).cast("long").alias("seconds"))


def utc_offset(minutes: Column) -> Column:
    """Minutes from UTC as ``+HH:MM``."""
    away = F.abs(minutes)
    return F.when(minutes.isNotNull(), F.format_string("%s%02d:%02d", F.when(minutes >= 0, "+").otherwise("-"), F.floor(away / 60), away % 60))


def created(raw: Column) -> Column:
    """struct(local timestamp, offset minutes) of a creation time in ISO form; null where it isn't one. A time without zone counts as UTC."""
    zone = F.regexp_extract(raw, r"([+-]\d{2}):?(\d{2})$", 0)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(zone == "", 0).otherwise(sign * (F.substring(zone, 2, 2).cast("int") * 60 + F.right(zone, F.lit(2)).cast("int")))
    front = F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)(?:Z|[+-]\d{2}:?\d{2})?$", 1)
    local = F.when(front != "", F.replace(front, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))
    return F.struct(local.alias("local"), F.when(local.isNotNull(), offset).alias("offset"))


def index(annotations: DataFrame) -> DataFrame:
    """(clip_id, n, file, frame, time, annotation_indices, shapes): each best frame once per clip.

    Annotations are numbered in order of (first_frame, chain_id); ``n`` counts pictures in frame order.
    """
    place = F.row_number().over(Window.partitionBy("clip_id").orderBy("first_frame", "chain_id")) - 1
    numbered = annotations.withColumn("place", place)
    each = numbered.groupBy("clip_id", "frame").agg(F.first("time").alias("time"), F.array_sort(F.collect_list(F.struct("place", F.array(*SIDES).alias("box")))).alias("a"))
    n = F.row_number().over(Window.partitionBy("clip_id").orderBy("frame")) - 1
    out = each.withColumn("n", n)
    return out.select("clip_id", "n", F.concat(F.col("n").cast("string"), F.lit(".jpg")).alias("file"), "frame", "time", F.transform("a", lambda x: x["place"]).alias("annotation_indices"), F.transform("a", lambda x: x["box"]).alias("shapes"))


def tags(pictures: DataFrame) -> DataFrame:
    """``pictures`` (time, started struct(local, offset), lat, lon, alt) with the fields written into a picture, null where unknown."""
    taken = F.expr("started.local + make_dt_interval(0, 0, 0, CAST(time AS decimal(18, 6)))")
    known = F.col("started.local").isNotNull()
    return pictures.withColumns({
        "taken": F.date_format(taken, "yyyy:MM:dd HH:mm:ss"), "subsec": F.date_format(taken, "SSS"), "zone": F.when(known, utc_offset(F.col("started.offset"))),
        "lat_ref": F.when(F.col("lat") >= 0, "N").when(F.col("lat") < 0, "S"), "lat_dms": F.when(F.col("lat").isNotNull(), dms(F.col("lat"))),
        "lon_ref": F.when(F.col("lon") >= 0, "E").when(F.col("lon") < 0, "W"), "lon_dms": F.when(F.col("lon").isNotNull(), dms(F.col("lon"))),
        "alt_ref": F.when(F.col("alt") >= 0, 0).when(F.col("alt") < 0, 1), "alt_cm": F.rint(F.abs("alt") * 100).cast("long"),
    })


# Tag numbers and field types of the TIFF structure inside a picture.
SOFTWARE, DATETIME, EXIF_AT, GPS_AT, ORIGINAL, SUBSEC, OFFSET = 0x0131, 0x0132, 0x8769, 0x8825, 0x9003, 0x9291, 0x9011
BYTE, ASCII, LONG, RATIONAL = 1, 2, 4, 5


def exif_block(row: dict, software: str) -> bytes:
    """The tags of one row of ``tags`` as a big-endian TIFF structure: one directory, those of time and place below it."""

    def text(value: str) -> tuple[int, int, bytes]:
        return ASCII, len(value) + 1, value.encode("ascii", "replace") + b"\0"

    def ratios(*pairs: tuple[int, int]) -> tuple[int, int, bytes]:
        return RATIONAL, len(pairs), b"".join(struct.pack(">II", *p) for p in pairs)

    def angle(d: dict) -> tuple[int, int, bytes]:
        return ratios((d["degrees"], 1), (d["minutes"], 1), (d["seconds"], 10000))

    def directory(fields: dict[int, tuple[int, int, bytes]], at: int) -> bytes:
        head, rest = struct.pack(">H", len(fields)), b""
        after = at + 2 + 12 * len(fields) + 4
        for tag, (kind, count, data) in sorted(fields.items()):
            value = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(">I", after + len(rest))
            head += struct.pack(">HHI", tag, kind, count) + value
            rest += b"" if len(data) <= 4 else data + b"\0" * (len(data) % 2)
        return head + bytes(4) + rest

    main, times, place = {SOFTWARE: text(software)}, {}, {}
    if row.get("taken"):
        main[DATETIME] = text(row["taken"])
        times = {ORIGINAL: text(row["taken"]), SUBSEC: text(row["subsec"]), OFFSET: text(row["zone"])}
    if row.get("lat_dms") and row.get("lon_dms"):
        place = {0: (BYTE, 4, b"\2\3\0\0"), 1: text(row["lat_ref"]), 2: angle(row["lat_dms"]), 3: text(row["lon_ref"]), 4: angle(row["lon_dms"])}
        if row.get("alt_cm") is not None:
            place |= {5: (BYTE, 1, bytes([row["alt_ref"]])), 6: ratios((row["alt_cm"], 100))}
    below = [(tag, fields) for tag, fields in ((EXIF_AT, times), (GPS_AT, place)) if fields]
    main |= {tag: (LONG, 1, bytes(4)) for tag, _ in below}
    at, parts = 8 + len(directory(main, 8)), b""
    for tag, fields in below:
        main[tag] = (LONG, 1, struct.pack(">I", at + len(parts)))
        parts += directory(fields, at + len(parts))
    return struct.pack(">2sHI", b"MM", 42, 8) + directory(main, 8) + parts


def png(image: np.ndarray, exif: bytes | None = None) -> bytes:
    """An 8-bit RGB image (h, w, 3) as a PNG file, with the tags in a chunk of their own."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = image.shape
    lines = np.zeros((h, 1 + 3 * w), np.uint8)
    lines[:, 1:] = image.reshape(h, 3 * w)
    tag = chunk(b"eXIf", exif) if exif else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + tag + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _colour(other: tuple[int, int, int]) -> Column:
    found = F.lit(None)
    for cls, rgb in COLOURS.items():
        found = F.when(F.col("cls") == cls, F.array(*map(F.lit, rgb))).otherwise(found)
    return F.coalesce(found, F.array(*map(F.lit, other)))


def _label(score: str, track: str) -> Column:
    """``face 0.41 #7``: class, score if known, what the track id ends with if there is one."""
    return F.concat_ws(" ", "cls", F.when(F.col(score).isNotNull(), F.format_string("%.2f", round_half_even(F.col(score), 2))), F.concat(F.lit("#"), F.substring_index(track, ":", -1)))


def overlay_marks(plan: DataFrame, detections: DataFrame, factor: float, wrap_width: float | None = None) -> DataFrame:
    """(clip_id, frame, mark, colour, dashed, label, x1..y2): what a debug picture shows, boxes scaled by ``factor``.

    Shapes of the plan come as ``ellipse`` or ``rect``, dashed where no detection
    stands behind them, and with a label where one does; in a frame that closes
    sideways also one turn left and right, without labels. Detections of other
    groups (signs) come as ``rect``.
    """
    name = ["clip_id", "chain_id", "segment", "frame"]
    turns = F.array(*map(F.lit, (0, -1, 1))) if wrap_width else F.array(F.lit(0))
    seen = plan.join(overlay(plan, detections), name, "left").withColumn("turn", F.explode(turns))
    dashed = F.col("source").isin(*DASHED)
    at = Box.of().translate(F.col("turn") * F.lit(wrap_width or 0.0), F.lit(0.0)).scale(factor, factor)
    shapes = seen.select("clip_id", "frame", F.col("kind").alias("mark"), _colour(OTHER_BLUR).alias("colour"), dashed.alias("dashed"), F.when(~dashed & (F.col("turn") == 0), _label("score", "chain_id")).alias("label"), *at.named())
    signs = detections.where("grp = 'signage'")
    marked = signs.select("clip_id", "frame", F.lit("rect").alias("mark"), _colour(COLOURS["sign"]).alias("colour"), F.lit(False).alias("dashed"), _label("score", "track_id").alias("label"), *Box.of().scale(factor, factor).named())
    return shapes.unionByName(marked)
