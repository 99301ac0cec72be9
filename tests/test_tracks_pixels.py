"""Assignment, tracking (batch and stream), pixel kernels and planes."""

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streetlens.operators import pixels as P
from streetlens.operators.track import FORBIDDEN, GroupTracker, TrackOptions, assign_tracks, assignment
from streetlens.plans import service
from streetlens.streaming.tracker import track_stream

BOX = "clip_id long, grp string, frame long, seq long, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("seed", range(30))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    cost = rng.random((rng.integers(1, 6), rng.integers(1, 6)))
    cost[rng.random(cost.shape) < 0.3] = FORBIDDEN
    small, large = sorted(cost.shape)
    wide = cost if cost.shape[0] == small else cost.T
    best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(large), small))
    found = assignment(cost)
    assert len({i for i, _ in found}) == len({j for _, j in found}) == small
    assert math.isclose(sum(cost[i, j] for i, j in found), best, rel_tol=1e-9)


def box(x, y=100.0, size=20.0):
    return (x, y, x + size, y + size)


def test_tracks_go_on_end_and_start():
    tracker = GroupTracker(TrackOptions(max_missed=2))
    assert tracker.frame(0, [box(100.0), box(300.0)]) == [1, 2]
    assert tracker.frame(1, [box(305.0), box(104.0)]) == [2, 1]
    assert tracker.frame(4, [box(110.0)]) == [1]  # two frames missed
    assert tracker.frame(8, [box(110.0)]) == [3]  # three are too many
    assert tracker.frame(9, [box(110.0, size=60.0)]) == [4]  # nine times the area
    assert GroupTracker(TrackOptions(wrap_width=1000.0)).frame(0, []) == []
    around = GroupTracker(TrackOptions(wrap_width=1000.0))
    assert around.frame(0, [box(985.0)]) == around.frame(1, [box(5.0)]) == [1]


def rows(seed=1, clips=3, frames=120):
    rng, out, seq = np.random.default_rng(seed), [], 0
    for clip in range(clips):
        for f in range(frames):
            if 40 <= f < 80:  # longer than a track lives
                continue
            for k in range(int(rng.integers(0, 4))):
                seq += 1
                x = float(100 + 60 * k + rng.integers(0, 9) + f)
                out.append((clip, "face" if k < 2 else "plate", f, seq, x, 50.0, x + 20, 70.0))
    return out


def by_group(data):
    found: dict = {}
    for r in data:
        found.setdefault((r[0], r[1]), []).append(r)
    return found


def expected(data, o):
    out = {}
    for (clip, grp), own in by_group(data).items():
        tracker = GroupTracker(o)
        for f, at in itertools.groupby(sorted(own, key=lambda r: (r[2], r[3])), key=lambda r: r[2]):
            at = list(at)
            for r, n in zip(at, tracker.frame(f, [r[4:] for r in at]), strict=True):
                out[r[3]] = f"{grp}:{n}"
    return out


def test_batch_equals_one_pass(spark):
    o, data = TrackOptions(max_missed=10), rows()
    found = assign_tracks(spark.createDataFrame(data, BOX), o)
    assert {r["seq"]: r["track_id"] for r in found.collect()} == expected(data, o)
    assert assign_tracks(spark.createDataFrame([], BOX), o).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    o, data = TrackOptions(max_missed=10), rows(seed=2, clips=2)
    frame = spark.createDataFrame(data, BOX)
    for i, cut in enumerate(((0, 30), (30, 90), (90, 200))):
        frame.where((F.col("frame") >= cut[0]) & (F.col("frame") < cut[1])).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    for i in range(3):  # one directory after another is one micro-batch after another
        (tmp_path / "all").mkdir(exist_ok=True)
        source = spark.readStream.schema(BOX).parquet(str(tmp_path / "all"))
        for part in (tmp_path / f"in{i}").glob("part-*"):
            part.rename(tmp_path / "all" / part.name)
        query = track_stream(source, o).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {r["seq"]: r["track_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == expected(data, o)


def test_crops_and_turns():
    image = np.arange(24, dtype=np.uint8).reshape(4, 6)
    assert (P.pad_circular(image, 2) == np.concatenate([image[:, -2:], image, image[:, :2]], 1)).all()
    assert (P.crop_wrapped(image, (-2, 1, 3, 3)) == np.roll(image, 2, 1)[1:3, :5]).all()
    assert P.crop_wrapped(image, (-6, 0, 12, 4)).shape == (4, 18)
    assert (P.upright(image, 90) == np.rot90(image)).all() and (P.upright(image, 0) == image).all()


@pytest.mark.parametrize("method", ["pixelate_blur", "gaussian_strong", "solid"])
@pytest.mark.parametrize("kind", ["rect", "ellipse"])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_only_the_shape_changes_and_texture_goes(method, kind, dtype):
    rng = np.random.default_rng(0)
    bright = np.iinfo(dtype).max // 255 * 200  # the noise is a share of what the type holds
    plane = (rng.integers(0, 2, (90, 120)) * bright).astype(dtype)
    shape = (40.3, 30.2, 80.0, 62.5)
    out = P.blur_plane(plane, [(kind, shape), (kind, (500.0, 500.0, 520.0, 520.0))], method, 6, 128, rng)
    region = P.shape_region(kind, shape, 120, 90)
    inside = np.zeros(plane.shape, bool)
    inside[region[1] : region[3], region[0] : region[2]] = P.ellipse_mask(shape, region) if kind == "ellipse" else True
    assert (out[~inside] == plane[~inside]).all()
    assert inside[31:62, 41:80].all()
    patch = out[31:62, 41:80]
    assert P.texture(patch) < 0.3 * P.texture(plane[31:62, 41:80])
    if dtype is np.uint8 and method == "pixelate_blur":
        assert abs(float(patch.mean()) - 100) < 25


def test_kernels_keep_a_flat_patch_and_edges():
    flat = np.full((7, 13), 77, np.uint8)
    assert (P.pixelate(flat, 4) == 77).all()
    assert P.pixelate(np.full((1, 1), 5, np.uint8), 4).tolist() == [[5]]
    assert P.shape_region("rect", (10.0, 10.0, 10.0, 12.0), 100, 100) is None
    with pytest.raises(ValueError, match="unknown method"):
        P.blur_plane(flat, [("rect", (0, 0, 5, 5))], "none", 4, 128, np.random.default_rng(0))


def test_planes_meet_the_plan(spark):
    rng = np.random.default_rng(3)
    luma, chroma = rng.integers(0, 255, (36, 64)).astype(np.uint8), rng.integers(0, 255, (18, 32)).astype(np.uint8)
    planes = spark.createDataFrame(
        [(1, f, p, a.shape[1], a.shape[0], 8, s, s, a.tobytes()) for f in (0, 1) for p, a, s in ((0, luma, 1.0), (1, chroma, 2.0))],
        "clip_id long, frame long, plane int, w int, h int, depth int, sub_x double, sub_y double, data binary",
    )
    plan = spark.createDataFrame([(1, 0, "c", 0, "rect", 60.0, 4.0, 70.0, 20.0)], "clip_id long, frame long, chain_id string, segment int, kind string, x1 double, y1 double, x2 double, y2 double")
    out = {(r["frame"], r["plane"]): np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"]) for r in P.blur_planes(planes, plan, "solid", wrap_width=64.0).collect()}
    want = luma.copy()
    want[4:20, 60:64] = want[4:20, 0:6] = 128  # the part beyond the seam shows on the left
    assert (out[0, 0] == want).all() and (out[1, 0] == luma).all() and (out[1, 1] == chroma).all()
    assert (out[0, 1][2:10, 30:32] == 128).all()
    assert P.plane_stats(planes).count() == 4


def test_over_blur_across_the_seam(spark):
    plan = spark.createDataFrame([(1, 0, "a", "rect", 470.0, 0.0, 489.0, 269.0)], "clip_id long, frame long, chain_id string, kind string, x1 double, y1 double, x2 double, y2 double")
    truth = spark.createDataFrame([(1, 0, 470.0, 0.0, 480.0, 270.0)], "clip_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    clips = spark.createDataFrame([(1, 1, 480, 270)], "clip_id long, frames int, width int, height int")
    # ten columns are past the right edge, and come back on the left
    assert [r.over_blur for r in P.over_blur(truth, plan, clips, 480.0).collect()] == [10 / 480]
    assert [r.over_blur for r in P.over_blur(truth, plan, clips).collect()] == [0.0]


def test_over_blur(spark):
    assert P.blurred_outside([{"kind": "rect", "x1": 0, "y1": 0, "x2": 959, "y2": 539}], [], 1920, 1080) == pytest.approx(0.25, abs=0.005)
    assert P.blurred_outside([{"kind": "ellipse", "x1": 800, "y1": 400, "x2": 1000, "y2": 600}], [{"x1": 700, "y1": 300, "x2": 1100, "y2": 700}], 1920, 1080) == 0
    area = P.blurred_outside([{"kind": "ellipse", "x1": 800, "y1": 400, "x2": 1000, "y2": 600}], [], 1920, 1080)
    assert area == pytest.approx(math.pi * 100 * 100 * 2 / (1920 * 1080), abs=0.003)
    clips = spark.createDataFrame([(1, 4, 1920, 1080), (2, 0, 1920, 1080)], "clip_id long, frames long, width int, height int")
    plan = spark.createDataFrame([(1, 0, "rect", 0.0, 0.0, 959.0, 1079.0), (1, 9, "rect", 0.0, 0.0, 959.0, 1079.0)], "clip_id long, frame long, kind string, x1 double, y1 double, x2 double, y2 double")
    truth = spark.createDataFrame([], "clip_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    assert {r["clip_id"]: round(r["over_blur"], 2) for r in P.over_blur(truth, plan, clips).collect()} == {1: 0.13, 2: 0.0}


def test_flow_carries_tracks_over_long_ways(spark):
    # the camera turns: boxes move 90 pixels a frame, far beyond the gate, and one frame lacks its box
    rows = [(1, "face", f, 10 * f + i, 100.0 + 90 * f + 400 * i, 100.0, 120.0 + 90 * f + 400 * i, 120.0) for f in range(6) for i in range(2) if (f, i) != (3, 0)]
    found = spark.createDataFrame(rows, BOX)
    grid = [(float(x), float(y)) for x in range(0, 1000, 10) for y in range(60, 160, 10)]
    flow = spark.createDataFrame([(1, f, [(x, y, 90.0, 0.0) for x, y in grid]) for f in range(1, 6)], "clip_id long, frame long, flow array<struct<x:double,y:double,dx:double,dy:double>>")
    o = TrackOptions(max_missed=3, large_gate=0.5)
    with_flow = {r["seq"]: r["track_id"] for r in assign_tracks(found, o, 1.0, flow).collect()}
    assert {with_flow[10 * f + 1] for f in range(6)} == {"face:2"} and {with_flow[10 * f] for f in (0, 1, 2, 4, 5)} == {"face:1"}
    assert len({r["track_id"] for r in assign_tracks(found, o).collect()}) > 2


def test_motion_goes_on_where_points_are_few():
    tracker = GroupTracker(TrackOptions(gate=0.1, gate_cap=1.0, large_gate=0.1))
    assert tracker.frame(0, [box(100.0)]) == [1]
    near = np.array([(105.0, 105.0, 50.0, 0.0), (115.0, 105.0, 50.0, 0.0), (115.0, 115.0, 51.0, 0.0), (900.0, 900.0, -5.0, 0.0)])
    assert tracker.frame(1, [box(150.0)], near) == [1]
    assert tracker.frame(2, [], near[3:]) == []  # no point is near: the motion stays
    assert tracker.frame(4, [box(300.0)], np.zeros((0, 4))) == [1]


def test_weights_are_computed_once_and_texture_is_exact():
    assert P._averaging(50, 7) is P._averaging(50, 7) and P._interpolation(7, 50) is P._interpolation(7, 50) and P._smoothing(7, 0.5, 1) is P._smoothing(7, 0.5, 1)
    for kind in (np.uint8, np.uint16):
        plane = np.random.default_rng(1).integers(0, np.iinfo(kind).max, (20, 31), kind, endpoint=True)
        assert P.texture(plane) == float(np.abs(np.diff(plane.astype(np.float64), axis=1)).mean())


@pytest.mark.parametrize("method", ["solid", "gaussian_strong", "pixelate_blur"])
def test_shapes_joined_before_the_pixels_blur_alike(spark, method):
    """Planes that carry their shapes give the figures of planes joined with the plan; pixels are not shuffled for it."""
    rng = np.random.default_rng(9)
    planes = [(c, f, p, 40, 30, 8, 2.0, 2.0, rng.integers(0, 256, (30, 40), np.uint8).tobytes()) for c in (1, 2) for f in range(6) for p in (0, 1)]
    planes = spark.createDataFrame(planes, "clip_id long, frame long, plane int, w int, h int, depth int, sub_x double, sub_y double, data binary")
    plan = [(c, f, f"k{k}", 0, ("rect", "ellipse")[k], 10.0 + 20 * k, 8.0, 34.0 + 20 * k, 40.0) for c in (1, 2) for f in (0, 2, 3) for k in range(1 + f % 2)]
    plan = spark.createDataFrame(plan, "clip_id long, frame long, chain_id string, segment int, kind string, x1 double, y1 double, x2 double, y2 double")
    want = P.plane_stats(P.blur_planes(planes, plan, method, seed=3)).collect()
    carried = P.blurred_stats(planes.join(P.shapes_of(plan), ["clip_id", "frame"], "left"), method, seed=3)
    assert sorted(carried.collect()) == sorted(want) and len(want) == 24
    text = service.blurred(spark, "/root/testdata/sf0.001", method)._jdf.queryExecution().sparkPlan().toString()
    assert text.count("MapInArrow") == 2 and "MapInArrow" not in text.partition("Join")[2]


def noise(number):
    """Pictures of three sizes, one of them a single column; the last has two bytes a sample."""
    h, w = ((60, 90), (300, 401), (40, 1), (20, 30))[number % 4]
    kind = np.uint16 if number % 4 == 3 else np.uint8
    return np.random.default_rng(number).integers(0, np.iinfo(kind).max, (h, w), kind, endpoint=True)


def shown(seed, numbers, kinds=("rect", "ellipse")):
    """Planes (clip_id, frame, plane, picture, sub_x, sub_y) of pictures, each with up to five shapes: small, large, overlapping or outside."""
    rng, out = np.random.default_rng(seed), []
    for f in range(60):
        picture = int(rng.choice(numbers))
        h, w = noise(picture).shape
        shapes = []
        for k in range(int(rng.integers(0, 6))):
            x, y = rng.uniform(-0.3, 1.2, 2) * (2.0 * w, 1.5 * h)
            wide, high = rng.uniform(0.0, 0.8, 2) ** 2 * (2.0 * w, 1.5 * h)
            shapes.append((kinds[k % len(kinds)], float(x), float(y), float(x + wide), float(y + high)))
        out.append(((5, f, f % 2, picture, 2.0, 1.5), shapes))
    return out


def expect(planes, method, cells=8):
    for (clip, frame, plane, picture, sx, sy), shapes in planes:
        image = noise(picture)
        out = P.blur_plane(image, [(k, (x1 / sx, y1 / sy, x2 / sx, y2 / sy)) for k, x1, y1, x2, y2 in shapes], method, cells, 1 << (8 * image.itemsize - 1), np.random.default_rng([0, clip, frame, plane]))
        yield clip, frame, plane, float(out.sum(dtype=np.uint64) / out.size), P.texture(out), zlib.crc32(out.tobytes())


def pictured(planes):
    rows, shapes = zip(*planes, strict=True)
    clip, frame, plane, picture, sx, sy = zip(*rows, strict=True)
    size = [noise(p).shape for p in picture]
    values = [np.array([(float(k == "ellipse"), *box) for k, *box in own]).tobytes() if own else None for own in shapes]
    columns = {"clip_id": pa.array(clip), "frame": pa.array(frame), "plane": pa.array(plane, pa.int32()), "w": pa.array([s[1] for s in size], pa.int32()), "h": pa.array([s[0] for s in size], pa.int32()), "depth": pa.array([8 * noise(p).itemsize for p in picture], pa.int32()), "sub_x": pa.array(sx), "sub_y": pa.array(sy), "picture": pa.array(picture), "shapes": pa.array(values, pa.binary())}
    return pa.RecordBatch.from_pydict(columns)


def check_figures(method, monkeypatch):
    for numbers, kept in (((0, 1, 2, 4, 5), P.KEPT_BYTES), (tuple(n for n in range(40) if n % 4 < 3), 1), ((0, 3), P.KEPT_BYTES)):
        monkeypatch.setattr(P, "KEPT_BYTES", kept)  # by one: each plane and picture by itself
        planes = shown(len(numbers), numbers)
        run = P._figures(method, 8, 0, noise)
        batch = pictured(planes)
        found = [tuple(r.values()) for b in run(iter([batch.slice(0, 0), batch.slice(0, 25), batch.slice(25)])) for r in b.to_pylist()]
        assert found == list(expect(planes, method)) and len(found) == 60


@pytest.mark.parametrize("method", ["pixelate_blur", "gaussian_strong"])
def test_figures_of_pictures_are_those_of_blurred_planes(method, monkeypatch):
    check_figures(method, monkeypatch)


def test_packed_shapes_are_those_of_the_lists(spark):
    """Frames that go on from batch to batch stay whole, and shapes are in the order of ``shapes_of``."""
    rng = np.random.default_rng(4)
    rows = [(c, f, f"k{rng.integers(0, 9)}", k, ("rect", "ellipse")[k % 2], *map(float, rng.uniform(0, 90, 4))) for c in (1, 2) for f in (0, 1, 7) for k in range(int(rng.integers(1, 40)))]
    plan = spark.createDataFrame(rows, "clip_id long, frame long, chain_id string, segment int, kind string, x1 double, y1 double, x2 double, y2 double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for width in (None, 90.0):
        try:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
            found = {(r["clip_id"], r["frame"]): np.frombuffer(r["shapes"], np.float64).reshape(-1, 5).tolist() for r in P.outlines(plan, width).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        want = {(r["clip_id"], r["frame"]): [[float(s["kind"] == "ellipse"), s["x1"], s["y1"], s["x2"], s["y2"]] for s in r["shapes"]] for r in P.shapes_of(plan, width).collect()}
        assert found == want and len(found) == 6
    assert P.outlines(plan.where("false")).count() == 0


def check_query(spark, method):
    """The query gives the figures of planes that are made, blurred and measured one by one, and no pixels pass the JVM."""
    d = "/root/testdata/sf0.001"
    found = service.blurred(spark, d, method)
    assert "data#" not in found._jdf.queryExecution().analyzed().toString()
    some = P.shapes_of(service.Q.plan(spark, d)).where("clip_id % 5 = 0").collect()
    want = []
    for r in some:
        for p in (0, 1):
            x, y = np.arange(192), np.arange(108)[:, None]
            image = ((x * 7 + y * 13) * 37 % 256).astype(np.uint8)[: 108 >> p, : 192 >> p] + np.uint8((r["clip_id"] * 3 + r["frame"]) * 37 % 256)
            sub = 10.0 * (p + 1)
            out = P.blur_plane(image, [(s["kind"], tuple(s[c] / sub for c in ("x1", "y1", "x2", "y2"))) for s in r["shapes"]], method, 8, 128, None)
            want.append((r["clip_id"], r["frame"], p, zlib.crc32(out.tobytes()), float(out.mean()), P.texture(out)))
    rows = sorted(found.where("clip_id % 5 = 0").select("clip_id", "frame", "plane", "crc", "mean", "texture").collect())
    assert [r[:4] for r in rows] == [r[:4] for r in sorted(want)] and len(rows) > 100
    assert np.allclose([r[4:] for r in rows], [r[4:] for r in sorted(want)], rtol=0, atol=1e-6)


def test_pixelate_query_moves_no_pixels(spark):
    check_query(spark, "pixelate_blur")


def test_solid_figures_of_pictures(monkeypatch):
    check_figures("solid", monkeypatch)


def test_solid_query_moves_no_pixels(spark):
    check_query(spark, "solid")
