"""Boxes of MP4 files as flat rows, and metadata boxes carried from one file to another."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Boxes that hold others, bytes before the first inner box, and metadata boxes that may be carried over.
HOLDERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"udta": 0, b"edts": 0, b"dinf": 0, b"stsd": 8, b"avc1": 78, b"avc3": 78, b"hvc1": 78, b"hev1": 78, b"mp4v": 78, b"av01": 78, b"vp09": 78}
CARRIED = ("FIRM", "LENS", "CAME", "SETT", "MUID", "HMMT", "BCID", "GUMI", "GPMF", "\xa9xyz", "\xa9day", "\xa9mak", "\xa9mod")
# The spherical boxes, where a track header has its matrix (by version), and the matrix that changes nothing.
SPHERICAL_UUID, SPHERICAL = bytes.fromhex("ffcc8263f8554a938814587a02521fdd"), ("sv3d", "st3d")
MATRIX_AT, MATRIX_SIZE = {0: 40, 1: 52}, 36
IDENTITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
SCHEMA = "path string, place long, parent long, kind string, trail string, start long, size long, payload binary"


def scan(data: bytes) -> Iterator[tuple[int, int, str, str, int, int, bytes]]:
    """(place, parent, kind, trail, start, size, payload) of each box in file order; the parent of an outer box is -1.

    A size of 1 has 64 bits after the type, a size of 0 goes to the end of what
    holds the box. Boxes that hold others give only the bytes before the first;
    media data gives none. A size that can't be is an error.
    """
    place, open_ = 0, [(0, len(data), -1, "")]
    while open_:
        at, end, parent, trail = open_.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box at {at} has the impossible size {size}")
        name, body = kind.decode("latin-1"), at + head
        before = HOLDERS.get(kind)
        payload = data[body : body + before] if before is not None else b"" if kind == b"mdat" else data[body : at + size]
        yield place, parent, name, f"{trail}/{name}", at, size, payload
        open_.append((at + size, end, parent, trail))
        if before is not None:
            open_.append((body + before, at + size, place, f"{trail}/{name}"))
        place += 1


def box_rows(files: DataFrame) -> DataFrame:
    """Box rows of files (path, content), as ``binaryFile`` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                columns = list(zip(*((path, *r) for r in scan(data or b"")), strict=True)) or [[]] * 8
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "place", "parent", "kind", "trail", "start", "size", "payload"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def missing_metadata(source: DataFrame, target: DataFrame) -> DataFrame:
    """Metadata boxes of ``source`` that may be carried over and whose kind ``target`` lacks, per ``path``."""
    own = source.where((F.col("trail") == F.concat(F.lit("/moov/udta/"), "kind")) & F.col("kind").isin(*CARRIED))
    there = target.where(F.col("trail") == F.concat(F.lit("/moov/udta/"), "kind")).select("path", "kind")
    return own.join(there, ["path", "kind"], "left_anti")


def assemble(rows: list[tuple[int, int, str, bytes]]) -> bytes:
    """The bytes of boxes (place, parent, kind, payload), sizes computed anew; children come in order of their places."""
    inner: dict[int, list[tuple]] = {}
    for row in sorted(rows):
        inner.setdefault(row[1], []).append(row)

    def write(row: tuple) -> bytes:
        body = row[3] + b"".join(map(write, inner.get(row[0], [])))
        kind = row[2].encode("latin-1")
        if len(body) + 8 > 0xFFFFFFFF:
            return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
        return struct.pack(">I4s", len(body) + 8, kind) + body

    return b"".join(map(write, inner.get(-1, [])))


class _Tree:
    """The movie box of a file as rows that can be changed, keyed by place."""

    def __init__(self, data: bytes):
        rows = list(scan(data))
        movies = [r for r in rows if r[3] == "/moov"]
        if len(movies) != 1:
            raise ValueError(f"{len(movies)} moov boxes instead of one")
        self.root = movies[0]
        self.rows = {r[0]: (r[0], r[1], r[2], r[6]) for r in rows if r[3].startswith("/moov")}
        self.next = len(rows)
        entries = [r[0] for r in rows if r[3].startswith("/moov/trak/") and r[3].split("/")[-2] == "stsd" and r[2].encode("latin-1") in HOLDERS]
        self.entry = entries[0] if entries else None
        self.track = self.entry
        while self.track is not None and self.rows[self.track][2] != "trak":
            self.track = self.rows[self.track][1]

    def inside(self, parent: int, *kinds: str) -> list[tuple]:
        return [r for p, r in sorted(self.rows.items()) if r[1] == parent and r[2] in kinds]

    def add(self, parent: int, kind: str, payload: bytes) -> int:
        self.rows[self.next] = (self.next, parent, kind, payload)
        self.next += 1
        return self.next - 1

    def serialize(self) -> bytes:
        top = self.root[0]
        return assemble([(r[0], -1 if r[0] == top else r[1], r[2], r[3]) for r in self.rows.values()])


def _matrix(tree: _Tree) -> tuple[tuple, int] | None:
    heads = tree.inside(tree.track, "tkhd")
    at = MATRIX_AT.get(heads[0][3][0]) if heads and heads[0][3] else None
    return None if at is None or len(heads[0][3]) < at + MATRIX_SIZE else (heads[0], at)


def transplant(source: bytes, target: bytes) -> tuple[bytes, list[str]]:
    """(file, what was carried): ``target`` with the metadata boxes of ``source`` that may be carried over.

    Spherical boxes of the video track, its display matrix unless it changes
    nothing, and the boxes in CARRIED whose kind ``target`` lacks. ``moov`` must be
    the last box of ``target``, so that no place of media data moves; files
    without a video track stay as they are.
    """
    a, b = _Tree(source), _Tree(target)
    if b.root[4] + b.root[5] != len(target):
        raise ValueError("moov is not the last box")
    if a.track is None or b.track is None:
        return target, []
    done = []

    def spherical(tree: _Tree) -> list[tuple]:
        return [r for r in tree.inside(tree.track, "uuid") if r[3][:16] == SPHERICAL_UUID]

    if first := spherical(a)[:1]:
        for row in spherical(b):
            del b.rows[row[0]]
        b.add(b.track, "uuid", first[0][3])
        done.append("uuid")
    for row in a.inside(a.entry, *SPHERICAL):
        if not b.inside(b.entry, row[2]):
            b.add(b.entry, row[2], row[3])
            done.append(row[2])
    own, other = _matrix(a), _matrix(b)
    if own and other:
        matrix = own[0][3][own[1] : own[1] + MATRIX_SIZE]
        (place, parent, kind, payload), at = other
        if matrix != IDENTITY:
            b.rows[place] = (place, parent, kind, payload[:at] + matrix + payload[at + MATRIX_SIZE :])
            done.append("matrix")
    kept = [r for u in a.inside(a.root[0], "udta")[:1] for r in a.inside(u[0], *CARRIED)]
    if kept:
        there = b.inside(b.root[0], "udta")
        udta = there[0][0] if there else b.add(b.root[0], "udta", b"")
        present = {r[2] for r in b.rows.values() if r[1] == udta}
        for row in kept:
            if row[2] not in present:
                b.add(udta, row[2], row[3])
                done.append(row[2])
    return target[: b.root[4]] + b.serialize(), done


def carry_metadata(pairs: DataFrame) -> DataFrame:
    """(path, content, carried array<string>) of files (path, source, target), one at a time in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, source, target in zip(*(batch.column(c).to_pylist() for c in ("path", "source", "target")), strict=True):
                content, carried = transplant(source, target)
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary()), pa.array([carried], pa.list_(pa.string()))], names=["path", "content", "carried"])

    return pairs.select("path", "source", "target").mapInArrow(run, "path string, content binary, carried array<string>")
