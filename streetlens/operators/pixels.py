"""Pixel operators on planes: rows (clip_id, frame, plane, w, h, depth, data), 8 or 16 bits a sample.

The kernels are numpy functions of one array; ``blur_planes`` joins a plan to
the planes and runs them batch by batch; ``blurred_stats`` does so where the
shapes were joined to the frames before. Where planes name their ``picture``,
no pixels travel: ``outlines`` packs the shapes of a frame, and figures of a
plane are those of the picture and what the shapes change, for whole batches.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.box import Box
from .catalog import seam_copies

Region = tuple[int, int, int, int]
RASTER = 480


def pad_circular(image: np.ndarray, pad: int) -> np.ndarray:
    """``image`` with ``pad`` more columns on each side, taken from the other edge."""
    return np.take(image, np.arange(-pad, image.shape[1] + pad), axis=1, mode="wrap")


def crop_wrapped(image: np.ndarray, region: Region) -> np.ndarray:
    """The region of a frame that closes sideways; it may go round more than once."""
    x1, y1, x2, y2 = region
    rows = image[y1:y2]
    if 0 <= x1 and x2 <= image.shape[1]:
        return rows[:, x1:x2].copy()
    return np.take(rows, np.arange(x1, x2), axis=1, mode="wrap")


def upright(image: np.ndarray, degrees: float) -> np.ndarray:
    """A coded image turned counter-clockwise to how it is shown, in quarter turns."""
    return np.rot90(image, round(degrees / 90) % 4)


def extent(kind: Column, box: Box) -> Box:
    """The box that a shape reaches: an ellipse goes through the corners of its box."""
    r = F.when(kind == "ellipse", F.lit(math.sqrt(2))).otherwise(F.lit(1.0))
    rx, ry = (box.x2 - box.x1) / 2 * r, (box.y2 - box.y1) / 2 * r
    return Box(box.cx - rx, box.cy - ry, box.cx + rx, box.cy + ry)


def roi(kind: Column, box: Box, w, h) -> Box:
    """The whole pixels of a plane of w x h that a shape reaches; empty ones have x2 <= x1 or y2 <= y1."""
    out = extent(kind, box).round_out()
    return Box(F.greatest(F.lit(0), out.x1), F.greatest(F.lit(0), out.y1), F.least(F.lit(w), out.x2), F.least(F.lit(h), out.y2))


def _reach(kind: str, box) -> tuple[float, float, float, float]:
    x1, y1, x2, y2 = box
    r = math.sqrt(2) if kind == "ellipse" else 1.0
    return (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / 2 * r, (y2 - y1) / 2 * r


def shape_region(kind: str, box, w: int, h: int) -> Region | None:
    cx, cy, rx, ry = _reach(kind, box)
    region = max(0, math.floor(cx - rx)), max(0, math.floor(cy - ry)), min(w, math.ceil(cx + rx)), min(h, math.ceil(cy + ry))
    return region if region[2] > region[0] and region[3] > region[1] else None


def ellipse_mask(box, region: Region) -> np.ndarray:
    """The pixels of a region whose centres are inside the ellipse, grown by half a pixel."""
    cx, cy, rx, ry = _reach("ellipse", box)
    x, y = np.arange(region[0], region[2]) + 0.5, np.arange(region[1], region[3]) + 0.5
    return ((x - cx) / max(rx + 0.5, 0.5)) ** 2 + (((y - cy) / max(ry + 0.5, 0.5)) ** 2)[:, None] <= 1.0


@lru_cache(128)
def _averaging(n: int, m: int) -> np.ndarray:
    """m x n weights: each of m cells is the mean of the share of the n samples under it."""
    edge = np.arange(m + 1) * (n / m)
    low, high = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(n) + 1.0)
    share = np.maximum(high - low, 0.0)
    return share / share.sum(1, keepdims=True)


@lru_cache(128)
def _interpolation(m: int, n: int) -> np.ndarray:
    """n x m weights: each of n samples lies between the centres of two of m cells."""
    at = np.clip((np.arange(n) + 0.5) * (m / n) - 0.5, 0, m - 1)
    low = np.floor(at).astype(int)
    out = np.zeros((n, m))
    out[np.arange(n), low] = 1 - (at - low)
    out[np.arange(n), np.minimum(low + 1, m - 1)] += at - low
    return out


@lru_cache(128)
def _smoothing(n: int, sigma: float, reach: int) -> np.ndarray:
    """n x n weights of a Gaussian whose edge samples repeat outward."""
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    out = np.zeros((n, n))
    for k, weight in zip(range(-reach, reach + 1), kernel / kernel.sum(), strict=True):
        np.add.at(out, (np.arange(n), np.clip(np.arange(n) + k, 0, n - 1)), weight)
    return out


def _resampled(patch: np.ndarray, size: tuple[int, int], sigma: float, reach: int) -> np.ndarray:
    """Averaged down to ``size`` (height, width), smoothed there, interpolated back; a stack of patches at once."""
    h, w = patch.shape[-2:]
    small = _averaging(h, size[0]) @ patch.astype(np.float64) @ _averaging(w, size[1]).T
    if sigma:
        small = _smoothing(size[0], sigma, reach) @ small @ _smoothing(size[1], sigma, reach).T
    return _interpolation(size[0], h) @ small @ _interpolation(size[1], w).T


def pixelate(patch: np.ndarray, cells: int) -> np.ndarray:
    """At most ``cells`` averages along the long side survive; they are smoothed and interpolated. A stack of patches is done at once."""
    cell = max(2, math.ceil(max(patch.shape[-2:]) / cells))
    size = tuple(math.ceil(n / cell) for n in patch.shape[-2:])
    return _rounded(_resampled(patch, size, 0.5 if min(size) > 1 else 0.0, 1), patch.dtype)


def gaussian(patch: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A Gaussian of a quarter of the long side, done at a lower resolution, and noise of one part in a hundred."""
    sigma = max(patch.shape) / 4
    factor = max(1.0, sigma / 4)
    size = tuple(max(1, round(n / factor)) for n in patch.shape)
    top = np.iinfo(patch.dtype).max
    return _rounded(_resampled(patch, size, sigma / factor, math.ceil(3 * sigma / factor)) + rng.normal(0.0, top * 0.01, patch.shape), patch.dtype)


def _rounded(values: np.ndarray, dtype) -> np.ndarray:
    return np.clip(np.rint(values), 0, np.iinfo(dtype).max).astype(dtype)


def blur_plane(plane: np.ndarray, shapes: list[tuple[str, tuple]], method: str, cells: int, neutral: int, rng: np.random.Generator | None) -> np.ndarray:
    """A copy of ``plane`` with the shapes (kind, box) made unrecognisable, one after another.

    ``method`` is pixelate_blur, gaussian_strong or solid. Shapes outside the
    plane change nothing. Only gaussian_strong draws from ``rng``.
    """
    out = plane.copy()
    for kind, box in shapes:
        region = shape_region(kind, box, plane.shape[1], plane.shape[0])
        if region is None:
            continue
        patch = out[region[1] : region[3], region[0] : region[2]]
        if method == "solid":
            new = neutral
        elif method == "gaussian_strong":
            new = gaussian(patch, rng)
        elif method == "pixelate_blur":
            new = pixelate(patch, cells)
        else:
            raise ValueError(f"unknown method {method}")
        np.copyto(patch, new, where=ellipse_mask(box, region) if kind == "ellipse" else True)
    return out


def texture(plane: np.ndarray) -> float:
    """Mean absolute difference of neighbours in a row."""
    if plane.shape[1] < 2:
        return 0.0
    steps = np.maximum(plane[:, 1:], plane[:, :-1])
    steps -= np.minimum(plane[:, 1:], plane[:, :-1])
    return float(steps.sum(dtype=np.uint64) / steps.size)


PLANES = "clip_id long, frame long, plane int, w int, h int, depth int, data binary"
STATS = "clip_id long, frame long, plane int, mean double, texture double, crc long"


def shapes_of(plan: DataFrame, wrap_width: float | None = None) -> DataFrame:
    """(clip_id, frame, shapes) of the frames of a plan; where the frame closes sideways each shape counts at a turn less and more, too."""
    turns = F.explode(F.array(*(F.lit(t * wrap_width) for t in (-1, 0, 1)))) if wrap_width else F.lit(0.0)
    moved = plan.select("clip_id", "frame", "chain_id", "segment", "kind", turns.alias("by"), "x1", "y1", "x2", "y2")
    item = F.struct("chain_id", "segment", "by", "kind", (F.col("x1") + F.col("by")).alias("x1"), "y1", (F.col("x2") + F.col("by")).alias("x2"), "y2")
    return moved.groupBy("clip_id", "frame").agg(F.array_sort(F.collect_list(item)).alias("shapes"))


def _pixels(r: dict) -> np.ndarray:
    return np.frombuffer(r["data"], np.uint8 if r["depth"] <= 8 else np.dtype("<u2")).reshape(r["h"], r["w"])


def _blurring(method: str, cells: int, seed: int):
    """From batches of planes with shapes: blurred planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, lists = [], batch.column("shapes")
            ends, held = lists.offsets.to_pylist(), lists.is_valid().to_pylist()
            parts = dict(zip((f.name for f in lists.type.value_type), lists.values.flatten(), strict=True))
            kinds, *sides = (parts[c].to_pylist() for c in ("kind", "x1", "y1", "x2", "y2"))
            for i, r in enumerate(batch.drop_columns(["shapes"]).to_pylist()):
                at = range(ends[i], ends[i + 1]) if held[i] else ()
                if not at:
                    done.append(r["data"])
                    continue
                spans = (r["sub_x"], r["sub_y"]) * 2
                own = [(kinds[k], tuple(side[k] / span for side, span in zip(sides, spans, strict=True))) for k in at]
                rng = np.random.default_rng([seed, r["clip_id"], r["frame"], r["plane"]]) if method == "gaussian_strong" else None
                done.append(blur_plane(_pixels(r), own, method, cells, 1 << (r["depth"] - 1), rng).tobytes())
            names = ["clip_id", "frame", "plane", "w", "h", "depth"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(done, pa.binary())], names=[*names, "data"])

    return run


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            plane = _pixels(r)
            rows.append((r["clip_id"], r["frame"], r["plane"], float(plane.sum(dtype=np.uint64) / plane.size), texture(plane), zlib.crc32(r["data"])))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["clip_id", "frame", "plane", "mean", "texture", "crc"])


def blur_planes(planes: DataFrame, plan: DataFrame, method: str = "pixelate_blur", cells: int = 8, seed: int = 0, wrap_width: float | None = None) -> DataFrame:
    """``planes`` with the plan's shapes blurred; planes of frames without shapes come back as they are.

    Planes carry ``sub_x`` and ``sub_y``: how many coded pixels a sample spans.
    Noise depends on the seed (keep it secret) and the plane only, so a
    task that runs again after a lost executor writes the same bytes.
    """
    planes = planes.select("clip_id", "frame", "plane", "w", "h", "depth", "sub_x", "sub_y", "data")
    return planes.join(shapes_of(plan, wrap_width), ["clip_id", "frame"], "left").mapInArrow(_blurring(method, cells, seed), PLANES)


def plane_stats(planes: DataFrame) -> DataFrame:
    """(clip_id, frame, plane, mean, texture, crc) of planes."""
    return planes.mapInArrow(_stats, STATS)


def blurred_stats(planes: DataFrame, method: str = "pixelate_blur", cells: int = 8, seed: int = 0, pictures: Callable[[int], np.ndarray] | None = None) -> DataFrame:
    """``plane_stats`` of blurred planes, for planes that have their ``shapes`` already (``shapes_of``, joined before pixels are read).

    No pixels are dealt out anew, and none come back from the workers. With
    ``pictures`` planes have a ``picture`` in place of ``data``, and ``shapes``
    as ``outlines`` packs them: workers get the pixels of a picture from that
    function, once for all planes of a batch, or of more, that show it.
    """
    if pictures is not None:
        return planes.mapInArrow(_figures(method, cells, seed, pictures), STATS)
    blurring = _blurring(method, cells, seed)
    return planes.mapInArrow(lambda batches: _stats(blurring(batches)), STATS)


def outlines(plan: DataFrame, wrap_width: float | None = None) -> DataFrame:
    """``shapes_of`` with the shapes of a frame in one binary value: five doubles each, 1 for an ellipse and the box.

    Rows are sorted and packed as they pass by; no lists are built in the JVM.
    """
    turns = F.explode(F.array(*(F.lit(t * wrap_width) for t in (-1, 0, 1)))) if wrap_width else F.lit(0.0)
    moved = plan.select("clip_id", "frame", "chain_id", "segment", "kind", turns.alias("by"), "x1", "y1", "x2", "y2")
    ellipse, x1, x2 = (F.col("kind") == "ellipse").cast("double").alias("ellipse"), (F.col("x1") + F.col("by")).alias("x1"), (F.col("x2") + F.col("by")).alias("x2")
    # what array_sort orders the structs of shapes_of by
    dealt = moved.repartition("clip_id", "frame").sortWithinPartitions("clip_id", "frame", "chain_id", "segment", "by", "kind", "x1", "y1", "x2", "y2")
    return dealt.select("clip_id", "frame", ellipse, x1, "y1", x2, "y2").mapInArrow(_packed, "clip_id long, frame long, shapes binary")


OUTLINE = 5 * 8


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(clip, frame, sides, starts) -> pa.RecordBatch:
        offsets = np.append(starts, len(clip)).astype(np.int32) * OUTLINE
        shapes = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(sides)])
        return pa.RecordBatch.from_arrays([pa.array(clip[starts]), pa.array(frame[starts]), shapes], names=["clip_id", "frame", "shapes"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        clip, frame, *sides = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("clip_id", "frame", "ellipse", "x1", "y1", "x2", "y2"))
        own = [clip, frame, np.stack(sides, 1)]
        clip, frame, sides = [np.concatenate(both) for both in zip(held, own, strict=True)] if held else own
        starts = np.flatnonzero(np.append(True, (clip[1:] != clip[:-1]) | (frame[1:] != frame[:-1])))
        last = starts[-1]  # the frame may go on in the next batch
        if last:
            yield packed(clip[:last], frame[:last], sides[:last], starts[:-1])
        held = [x[last:].copy() for x in (clip, frame, sides)]
    if held:
        yield packed(*held, np.zeros(1, int))


def _after(v: np.ndarray) -> np.ndarray:
    """CRC registers after one more byte of zeros."""
    return (v >> 8) ^ _byte_crcs()[v & 255]


@lru_cache(1)
def _byte_crcs() -> np.ndarray:
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = (v >> 1) ^ np.where(v & 1, np.uint32(0xEDB88320), np.uint32(0))
    return v


@lru_cache(8)
def _distant_crcs(n: int) -> np.ndarray:
    """What a byte with ``d`` bytes behind it adds to a CRC, at 256 * d + byte, for d < n."""
    out = [_byte_crcs()]
    while len(out) < n:
        out.append(_after(out[-1]))
    return np.concatenate(out)


@lru_cache(4)
def _zeros(level: int) -> np.ndarray:
    """Registers after d * 256**level zeros, by d, place of a byte and byte."""
    out = np.empty((256, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for d in range(1, 256):
        out[d] = _behind(_behind(out[d - 1], 255, level - 1), 1, level - 1) if level else _after(out[d - 1])
    return out


def _behind(v: np.ndarray, digit: np.ndarray | int, level: int) -> np.ndarray:
    """Registers ``v`` after digit * 256**level zeros."""
    table, at = _zeros(level).reshape(-1), digit * 1024
    return table[at + (v & 255)] ^ table[at + 256 + ((v >> 8) & 255)] ^ table[at + 512 + ((v >> 16) & 255)] ^ table[at + 768 + (v >> 24)]


def _shifted(v: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC registers after as many bytes of zeros."""
    level = 0
    while zeros.any():
        v, zeros, level = _behind(v, zeros & 255, level), zeros >> 8, level + 1
    return v


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


#: Bytes of pictures that a worker keeps, and of what is computed at once.
KEPT_BYTES = 64 << 20


class _Pictures:
    """Pictures of 8 bits a sample in one buffer, with their sum, steps and CRC."""

    def __init__(self, pixels: Callable[[int], np.ndarray]):
        self.pixels, self.place, self.used = pixels, {}, 0
        self.buffer, self.figures = np.empty(0, np.uint8), np.empty((0, 4), np.int64)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Rows (place in the buffer, sum, steps, CRC)."""
        wanted, where = np.unique(ids, return_inverse=True)
        if new := [i for i in wanted.tolist() if i not in self.place]:
            if self.used > KEPT_BYTES:
                self.place, self.used, self.buffer, self.figures, new = {}, 0, self.buffer[:0], self.figures[:0], wanted.tolist()
            made = [np.ascontiguousarray(self.pixels(i), np.uint8) for i in new]
            rows = []
            for i, a in zip(new, made, strict=True):
                self.place[i] = len(self.place)
                steps = np.maximum(a[:, 1:], a[:, :-1]) - np.minimum(a[:, 1:], a[:, :-1])
                rows.append((self.used, a.sum(dtype=np.int64), steps.sum(dtype=np.int64), zlib.crc32(a)))
                self.used += a.size
            self.buffer, self.figures = np.concatenate([self.buffer, *(a.reshape(-1) for a in made)]), np.concatenate([self.figures, np.array(rows, np.int64)])
        return self.figures[[self.place[i] for i in wanted.tolist()]][where]


def _pixelated(canvas: np.ndarray, cells: int, plane: np.ndarray, at: np.ndarray, stride: np.ndarray, region: np.ndarray, reach: np.ndarray, ellipse: np.ndarray) -> None:
    """Shapes pixelated in place, the first of each plane, then the second; those of one size as one stack."""
    nth = np.arange(len(plane)) - np.searchsorted(plane, plane)
    w, h = region[2] - region[0], region[3] - region[1]
    order = np.lexsort((w, h, ellipse, nth))
    alike = np.stack([nth, ellipse, h, w])[:, order]
    for own in np.split(order, np.flatnonzero((alike[:, 1:] != alike[:, :-1]).any(0)) + 1):
        x, y = np.arange(w[own[0]]), np.arange(h[own[0]])[:, None]
        place = at[own, None, None] + y * stride[own, None, None] + x
        old = canvas[place]
        new = pixelate(old, cells)
        if ellipse[own[0]]:
            cx, cy, rx, ry = (v[own, None, None] for v in reach)
            x, y = x + region[0][own, None, None] + 0.5, y + region[1][own, None, None] + 0.5
            new = np.where(((x - cx) / np.maximum(rx + 0.5, 0.5)) ** 2 + ((y - cy) / np.maximum(ry + 0.5, 0.5)) ** 2 <= 1.0, new, old)
        canvas[place] = new


def _filled(canvas: np.ndarray, neutral: np.ndarray, at: np.ndarray, stride: np.ndarray, region: np.ndarray, reach: np.ndarray, ellipse: np.ndarray) -> None:
    """Shapes filled in place."""
    w, h = region[2] - region[0], region[3] - region[1]
    for own, round_ in ((np.flatnonzero(~ellipse), False), (np.flatnonzero(ellipse), True)):
        row = np.repeat(own, h[own])
        down = _ranges(np.zeros(len(own), int), h[own])
        place = _ranges(at[row] + down * stride[row], w[row])
        value = np.repeat(neutral[row], w[row])
        if round_:
            cx, cy, rx, ry = reach[:, row]
            flat = (((region[1][row] + down + 0.5) - cy) / np.maximum(ry + 0.5, 0.5)) ** 2
            x = _ranges(region[0][row], w[row]) + 0.5
            inside = ((x - np.repeat(cx, w[row])) / np.repeat(np.maximum(rx + 0.5, 0.5), w[row])) ** 2 + np.repeat(flat, w[row]) <= 1.0
            place, value = place[inside], value[inside]
        canvas[place] = value


def _changed(method: str, cells: int, buffer: np.ndarray, begin: np.ndarray, w: np.ndarray, h: np.ndarray, neutral: np.ndarray, box: np.ndarray, plane: np.ndarray, region: np.ndarray, reach: np.ndarray, ellipse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What shapes change in the sum, steps and CRC of planes; each plane has its part ``box``, that holds its shapes, on one canvas."""
    x1, y1, x2, y2 = box
    wide, high = x2 - x1, y2 - y1
    first = np.cumsum(wide * high) - wide * high
    row = np.repeat(np.arange(len(w)), high)
    y = _ranges(y1, high)
    length = wide[row]
    ends = np.cumsum(length)
    starts = ends - length
    old = buffer[_ranges(begin[row] + y * w[row] + x1[row], length)]
    new = old.copy()
    stride = wide[plane]
    at = first[plane] + (region[1] - y1[plane]) * stride + region[0] - x1[plane]
    if method == "solid":
        _filled(new, neutral[plane], at, stride, region, reach, ellipse)
    else:
        _pixelated(new, cells, plane, at, stride, region, reach, ellipse)

    def steps(a: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.uint8)
        out[:-1] = np.maximum(a[1:], a[:-1]) - np.minimum(a[1:], a[:-1])
        out[ends - 1] = 0  # from row to row is no step
        return out

    total = np.add.reduceat(new.astype(np.int32) - old, first, dtype=np.int64)
    rough = np.add.reduceat(steps(new).astype(np.int32) - steps(old), first, dtype=np.int64)
    far = np.repeat(ends - 1, length) - np.arange(len(old))
    crc = np.bitwise_xor.reduceat(_distant_crcs(1 << int(wide.max() - 1).bit_length())[far * 256 + (new ^ old)], starts)
    crc = _shifted(crc, (w * h)[row] - y * w[row] - x2[row])
    return total, rough, np.bitwise_xor.reduceat(crc, np.cumsum(high) - high).astype(np.int64)


def _figures(method: str, cells: int, seed: int, pixels: Callable[[int], np.ndarray]):
    """From batches of planes with pictures and packed shapes: their figures once they are blurred."""
    whole_planes = _blurring(method, cells, seed)

    def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Doubles of all shapes, and the place of the first of each plane, and of the end."""
        packed = batch.column("shapes")
        if packed.null_count:
            packed = packed.fill_null(b"")
        _, offsets, data = packed.buffers()
        ends = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
        values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
        return np.frombuffer(values.tobytes(), np.float64).reshape(-1, 5), (ends - ends[0]) // OUTLINE

    def plainly(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The batch with pixels and lists of shapes, as ``shapes_of`` has them."""
        values, ends = unpacked(batch)
        kinds = pa.array(np.where(values[:, 0] == 1, "ellipse", "rect").tolist(), pa.string())
        items = pa.StructArray.from_arrays([kinds, *(pa.array(values[:, k].copy()) for k in range(1, 5))], names=["kind", "x1", "y1", "x2", "y2"])
        data = pa.array([np.ascontiguousarray(pixels(i)).tobytes() for i in batch.column("picture").to_pylist()], pa.binary())
        return batch.drop_columns(["picture", "shapes"]).append_column("data", data).append_column("shapes", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items))

    def figures(batch: pa.RecordBatch, known: _Pictures) -> Iterator[pa.RecordBatch]:
        w, h, depth, sub_x, sub_y, picture = (batch.column(n).to_numpy() for n in ("w", "h", "depth", "sub_x", "sub_y", "picture"))
        w, h, n = w.astype(np.int64), h.astype(np.int64), batch.num_rows
        values, ends = unpacked(batch)
        plane = np.repeat(np.arange(n), np.diff(ends))
        x1, x2 = values[:, 1] / sub_x[plane], values[:, 3] / sub_x[plane]
        y1, y2 = values[:, 2] / sub_y[plane], values[:, 4] / sub_y[plane]
        ellipse = values[:, 0] == 1
        r = np.where(ellipse, math.sqrt(2), 1.0)
        cx, cy, rx, ry = reach = np.stack([(x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / 2 * r, (y2 - y1) / 2 * r])
        region = np.stack([np.clip(f(v), 0, most[plane]) for f, v, most in ((np.floor, cx - rx, w), (np.floor, cy - ry, h), (np.ceil, cx + rx, w), (np.ceil, cy + ry, h))]).astype(np.int64)
        held = (region[2] > region[0]) & (region[3] > region[1])
        plane, region, reach, ellipse = plane[held], region[:, held], reach[:, held], ellipse[held]
        some, begins, own = np.unique(plane, return_index=True, return_inverse=True)
        box = np.stack([f.reduceat(v, begins) for f, v in zip((np.minimum, np.minimum, np.maximum, np.maximum), region, strict=True)]) if len(some) else np.empty((4, 0), np.int64)
        # steps to the samples left and right of what changes
        box[0], box[2] = np.maximum(box[0] - 1, 0), np.minimum(box[2] + 1, w[some])
        made = np.unique(picture, return_index=True)[1]
        samples = ((box[2] - box[0]) * (box[3] - box[1])).sum() + ((region[2] - region[0]) * (region[3] - region[1])).sum()
        if n > 1 and (w[made] * h[made]).sum() + 32 * samples > KEPT_BYTES:
            for part in (batch.slice(0, n // 2), batch.slice(n // 2)):
                yield from figures(part, known)
            return
        found = known.find(picture)
        begin, total, steps, crc = (v.copy() for v in found.T)
        if len(some):
            change = _changed(method, cells, known.buffer, begin[some], w[some], h[some], 1 << (depth[some] - 1), box, own, region, reach, ellipse)
            total[some], steps[some], crc[some] = total[some] + change[0], steps[some] + change[1], crc[some] ^ change[2]
        columns = [total / (w * h), steps / np.maximum((w - 1) * h, 1), crc]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("clip_id", "frame", "plane")), *map(pa.array, columns)], names=["clip_id", "frame", "plane", "mean", "texture", "crc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Pictures(pixels)
        for batch in batches:
            if not batch.num_rows:
                continue
            if method in ("solid", "pixelate_blur") and batch.column("depth").to_numpy().max() <= 8:
                yield from figures(batch, known)
            else:  # noise of its own for each plane, or samples of two bytes
                yield from _stats(whole_planes(map(plainly, (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)))))

    return run


def over_blur(truth: DataFrame, plan: DataFrame, clips: DataFrame, wrap_width: float | None = None) -> DataFrame:
    """(clip_id, over_blur): mean share of a clip's frames that is blurred outside its annotated boxes.

    ``clips`` are (clip_id, frames, width, height). Frames are rasters of at
    most 480 columns; each row of the plan's (clip, frame) groups is one mask.
    In a frame that closes at ``wrap_width`` shapes are drawn a turn to either side, too.
    """
    box = F.struct("x1", "y1", "x2", "y2")
    turned = seam_copies(plan, wrap_width) if wrap_width else plan
    shapes = turned.groupBy("clip_id", "frame").agg(F.collect_list(F.struct("kind", "x1", "y1", "x2", "y2")).alias("shapes"))
    known = truth.groupBy("clip_id", "frame").agg(F.collect_list(box).alias("known"))
    joined = shapes.join(known, ["clip_id", "frame"], "left").join(clips, "clip_id").where("frame >= 0 AND frame < frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [blurred_outside(r["shapes"], r["known"] or [], r["width"], r["height"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), pa.array(shares, pa.float64())], names=["clip_id", "share"])

    each = joined.select("clip_id", "shapes", "known", "width", "height").mapInArrow(run, "clip_id long, share double")
    total = each.groupBy("clip_id").agg(F.sum("share").alias("total"))
    return clips.join(total, "clip_id", "left").select("clip_id", (F.coalesce("total", F.lit(0.0)) / F.greatest(F.lit(1), F.col("frames"))).alias("over_blur"))


def blurred_outside(shapes: list[dict], known: list[dict], width: int, height: int) -> float:
    """The share of a frame's raster that shapes cover and annotated boxes don't."""
    factor = min(1.0, RASTER / width)
    mask = np.zeros((max(1, round(height * factor)), max(1, round(width * factor))), bool)

    def part(x1: int, y1: int, x2: int, y2: int) -> tuple[slice, slice]:
        return slice(max(0, y1), max(0, y2 + 1)), slice(max(0, x1), max(0, x2 + 1))

    for s in shapes:
        cx, cy, rx, ry = (v * factor for v in _reach(s["kind"], (s["x1"], s["y1"], s["x2"], s["y2"])))
        if s["kind"] == "ellipse":
            cx, cy, rx, ry = round(cx), round(cy), max(0, round(rx)), max(0, round(ry))
            rows, cols = part(cx - rx, cy - ry, cx + rx, cy + ry)
            y, x = np.arange(mask.shape[0])[rows][:, None] - cy, np.arange(mask.shape[1])[cols] - cx
            mask[rows, cols] |= (x / max(rx, 0.5)) ** 2 + (y / max(ry, 0.5)) ** 2 <= 1.0
        else:
            mask[part(*(round(v) for v in (cx - rx, cy - ry, cx + rx, cy + ry)))] = True
    for k in known:
        mask[part(math.floor(k["x1"] * factor), math.floor(k["y1"] * factor), math.ceil(k["x2"] * factor), math.ceil(k["y2"] * factor))] = False
    return float(mask.mean())
