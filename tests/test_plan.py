"""Plans, links and merges against the definitions done anew in plain Python, and scenes made up for this engine.

Positions in the scenes come from simple motions (a constant speed, a circle),
so expected boxes are computed from the motion, not listed.
"""

import math
import random
from collections import Counter, defaultdict
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streetlens.functions.box import SIDES, Box
from streetlens.functions.rounding import round_half_even
from streetlens.operators import detections as D
from streetlens.operators import link as L
from streetlens.operators import metrics as M
from streetlens.operators import plan as P
from streetlens.operators import signs as S
from streetlens.options import Options
from streetlens.plans import queries as Q

SCHEMA = "clip_id long, frame long, seq long, cls string, grp string, score double, x1 double, y1 double, x2 double, y2 double, track_id string, pass_id string"
GROUP = {"sign": "signage", "direction": "signage"}


def scene(spark, rows):
    """Rows (frame, class, score, x, y, w, h, track)."""
    data = [(3, f, i, c, GROUP.get(c, c), s, float(x), float(y), float(x + w), float(y + h), t, "p") for i, (f, c, s, x, y, w, h, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def shapes(spark, rows, o, frames=60):
    out = defaultdict(list)
    for r in P.blur_plan(L.link(scene(spark, rows), o, o.wrap_width), o, frames).collect():
        out[r.frame].append(r)
    return out


PLAIN = Options(fps=12.0, width=640, height=480, margin=0.0, padding=0)


def test_a_walker_seen_every_third_frame_is_covered_in_between(spark):
    walk = lambda f: 50 + 7 * f
    p = shapes(spark, [(f, "face", 0.8, walk(f), 200, 24, 30, "face:w") for f in range(6, 40, 3)], PLAIN)
    assert sorted(p) == list(range(6, 40))
    for f, (r,) in p.items():
        assert r.kind == "ellipse" and r.source == ("detected" if f % 3 == 0 else "interpolated")
        assert r.x1 <= walk(f) + 1e-9 and r.x2 >= walk(f) + 24 - 1e-9


def test_margin_padding_and_growth_follow_the_speed(spark):
    o = replace(PLAIN, padding=4, growth=0.2, margin=0.25, smoothing=1)
    p = shapes(spark, [(20 + f, "plate", 0.9, 300 + 5 * f, 100 - 2 * f, 40, 10, "plate:m") for f in range(6)], o)
    for k in range(1, 5):
        w, h = 40 * (1 + 0.2 * k), 10 * (1 + 0.2 * k)
        for f, x, y in ((20 - k, 300 - 5 * k, 100 + 2 * k), (25 + k, 325 + 5 * k, 90 - 2 * k)):
            (r,) = p[f]
            cx, cy = x + 20, y + 5
            want = [cx - 0.75 * w, cy - 0.75 * h, cx + 0.75 * w, cy + 0.75 * h]
            assert r.source == "padded" and [r.x1, r.y1, r.x2, r.y2] == pytest.approx(want)


def test_an_unsure_part_after_a_jump_is_left_alone(spark):
    rows = [(f, "plate", 0.7, 20 + f, 20, 30, 12, "plate:j") for f in range(5)] + [(f, "plate", 0.12, 590, 450 - f, 14, 9, "plate:j") for f in range(6, 9)]
    o = replace(PLAIN, max_jump=4.0)
    assert sorted(shapes(spark, rows, o)) == [0, 1, 2, 3, 4]
    assert 5 in shapes(spark, rows, replace(o, max_jump=400.0))


def test_the_clip_and_the_frame_end_a_plan(spark):
    o = replace(PLAIN, padding=30)
    p = shapes(spark, [(2, "face", 0.5, 630, 470, 20, 20, None), (2, "face", 0.5, 700, 10, 20, 20, None)], o, frames=5)
    assert sorted(p) == [0, 1, 2, 3, 4] and all(len(v) == 1 for f, v in p.items() if f == 2) and p[2][0].source == "orphan"


def test_nothing_is_lost_at_the_seam(spark):
    """Someone walks three times around a frame that closes at 640 pixels."""
    o = replace(PLAIN, wrap_width=640.0, margin=0.1)
    at = lambda f: 600 + 33 * f
    rows = [(f, "face", 0.9, at(f) % 640, 100, 40, 40, "face:s") for f in range(60) if f % 2 == 0]
    p = shapes(spark, rows, o)
    assert sorted(p) == list(range(59)) and {r.chain_id for v in p.values() for r in v} == {"face:s"}
    for f, (r,) in p.items():
        assert 0 <= r.x1 < 640 and r.x2 - r.x1 < 120
        assert any(r.x1 <= at(f) % 640 + t + 1e-6 and r.x2 >= at(f) % 640 + t + 40 - 1e-6 for t in (-640, 0, 640))
    high = [(f, "plate", 0.9, 635, -30, 20, 10, "plate:h") for f in range(3)]
    assert not shapes(spark, high, o)
    truth = scene(spark, rows).select("clip_id", F.col("track_id").alias("track"), "frame", "seq", "cls", F.lit(True).alias("readable"), *SIDES)
    plan = P.blur_plan(L.link(scene(spark, rows), o, 640.0), o, 60)
    assert {r.coverage for r in M.object_frames(truth, plan, o).collect()} == {1.0}
    assert [r.chains for r in M.chains_per_track(truth, plan, o).collect()] == [1]


# coverage, by the definition


def covered(box, found, wrap):
    w, h = box[2] - box[0], box[3] - box[1]
    nx, ny = (max(1, min(16, math.ceil(v))) for v in (w, h))
    hit = 0
    for i in range(nx):
        for j in range(ny):
            x, y = box[0] + (i + 0.5) * w / nx, box[1] + (j + 0.5) * h / ny
            hit += any(inside(kind, (x1 + t, y1, x2 + t, y2), x, y) for kind, x1, y1, x2, y2 in found for t in ((-wrap, 0, wrap) if wrap else (0,)))
    return hit / (nx * ny)


def inside(kind, b, x, y):
    if kind == "rect":
        return b[0] <= x <= b[2] and b[1] <= y <= b[3]
    rx, ry = (b[2] - b[0]) / math.sqrt(2), (b[3] - b[1]) / math.sqrt(2)
    return rx > 0 and ry > 0 and ((x - (b[0] + b[2]) / 2) / rx) ** 2 + ((y - (b[1] + b[3]) / 2) / ry) ** 2 <= 1


@pytest.mark.parametrize("wrap", [None, 200.0])
def test_coverage_and_holding_chains(spark, wrap):
    rng = random.Random(31)
    box = lambda most: (lambda x, y: (x, y, x + rng.uniform(0.3, most), y + rng.uniform(0.3, most)))(rng.uniform(0, 190), rng.uniform(0, 40))
    truth = [(1, f"t{i % 40}", i % 25, i, "face", i % 2 == 0, *box(40)) for i in range(200)]
    plan = [(1, f"c{i % 30}", i % 25, rng.choice(["rect", "ellipse"]), *box(60)) for i in range(300)] + [(1, "flat", 3, "ellipse", 5.0, 5.0, 5.0, 9.0)]
    o = replace(PLAIN, wrap_width=wrap)
    t = spark.createDataFrame(truth, "clip_id long, track string, frame long, seq long, cls string, readable boolean, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(plan, "clip_id long, chain_id string, frame long, kind string, x1 double, y1 double, x2 double, y2 double")
    found = {r.seq: r.coverage for r in M.object_frames(t, p, o).collect()}
    chains = {r.track: r.chains for r in M.chains_per_track(t, p, o).collect()}
    holding = defaultdict(set)
    for _, track, frame, seq, _, _, *b in truth:
        near = [(k, *s) for _, c, f, k, *s in plan if f == frame]
        assert found[seq] == pytest.approx(covered(b, near, wrap)), seq
        holding[track] |= {c for _, c, f, k, *s in plan if f == frame for u in ((-wrap, 0, wrap) if wrap else (0,)) if inside(k, (s[0] + u, s[1], s[2] + u, s[3]), (b[0] + b[2]) / 2, (b[1] + b[3]) / 2)}
    assert chains == {t: len(c) for t, c in holding.items()} | {t[1]: 0 for t in truth if not holding[t[1]]}


def test_a_summary_and_its_gate(spark):
    rows = [("a", f, f, f % 4 != 1, True) for f in range(12)] + [("b", 30 + f, 50 + f, f > 5, True) for f in range(8)] + [("c", 2, 90, False, False)]
    objects = spark.createDataFrame([(1, t, "face", f, s, "16-32px", r, 1.0 if p else 0.0, p) for t, f, s, p, r in rows], "clip_id long, track string, cls string, frame long, seq long, size string, readable boolean, coverage double, protected boolean")
    chains = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "c", 1)], "clip_id long, track string, chains long")
    blur = spark.createDataFrame([(1, 0.25), (2, 0.125)], "clip_id long, over_blur double")
    found = M.summary(objects, chains, PLAIN, blur)
    r = found.first()
    assert (r.object_frames, r.unprotected, r.tracks, r.tracks_ever_leaked, r.readable_tracks, r.readable_tracks_ever_leaked) == (21, 10, 3, 3, 2, 2)
    assert (r.longest_exposure_frames, r.longest_exposure_frames_readable, r.transient_exposures) == (6, 6, 3)
    assert (r.mean_chains_per_track, r.over_blur_ratio, r.leakage_rate, r.readable_leakage_rate) == (1.333, 0.1875, 0.47619, 0.45)
    gate = M.gate(found, PLAIN).first()
    assert not gate.passed and gate.failures == ["leakage rate of readable objects 45.00% > 1.00%", "a readable object stayed exposed 6 consecutive frames > 3"]
    assert M.gate(M.summary(objects.where("protected"), chains, PLAIN), PLAIN).first().passed
    nothing = M.summary(objects.limit(0), chains.limit(0), PLAIN).first()
    assert (nothing.tracks, nothing.leakage_rate, nothing.longest_exposure_frames) == (0, 0.0, 0)


# linking and merging, by the definitions


def turned(box, towards, wrap):
    by = round((towards - (box[0] + box[2]) / 2) / wrap) * wrap if wrap else 0
    return (box[0] + by, box[1], box[2] + by, box[3])


def plain_links(rows, o):
    """{seq: chain id}: fragments of a clip one after another, each to the nearest chain it may go on."""
    fragments = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["frame"], r["seq"])):
        fragments[r["clip_id"], r["track_id"] or ("orphan", r["seq"])].append(r)
    every = sorted(fragments.values(), key=lambda f: (f[0]["clip_id"], f[0]["grp"], f[0]["frame"], f[-1]["frame"], f[0]["track_id"] is not None, f[0]["frame"], f[0]["seq"]))
    out, chains, number = {}, [], Counter()
    for f in every:
        grp, clip, first = f[0]["grp"], f[0]["clip_id"], f[0]
        best = None
        for c in chains:
            seen = c["seen"]
            gap = first["frame"] - seen[-1][0]
            if c["of"] != (clip, grp) or not 0 < gap <= o.link_gap:
                continue
            tail = seen[-o.velocity_samples :]
            span = tail[-1][0] - tail[0][0]
            there = [b + ((b - a) / span * gap if span > 0 else 0) for a, b in zip(tail[0][1], tail[-1][1], strict=True)]
            here = [first[s] for s in SIDES]
            w, h = ([b[2] - b[0] for b in (there, here)], [b[3] - b[1] for b in (there, here)])
            far = math.dist(((there[0] + there[2]) / 2, (there[1] + there[3]) / 2), ((here[0] + here[2]) / 2, (here[1] + here[3]) / 2)) / max(*w, *h, 1.0)
            ratio = max(max(0, w[0]) * max(0, h[0]), 1) / max(w[1] * h[1], 1)
            if far <= o.link_distance * (1 + 0.1 * gap) and 1 / o.area_ratio <= ratio <= o.area_ratio and (best is None or far < best[0]):
                best = far, c
        if best is None:
            number[clip, grp] += 1
            chains.append({"of": (clip, grp), "id": first["track_id"] or f"{grp}:~{number[clip, grp]}", "seen": []})
            best = 0, chains[-1]
        for r in f:
            best[1]["seen"].append((r["frame"], [r[s] for s in SIDES]))
            out[r["seq"]] = best[1]["id"]
    return out


def test_links_of_made_up_walks(spark):
    rng, rows = random.Random(17), []
    for walker in range(14):
        x, y, v, f = rng.uniform(0, 500), rng.uniform(0, 300), rng.uniform(-9, 9), rng.randint(0, 30)
        for _ in range(12):
            f += rng.choice([1, 1, 2, 5, 9, 16])
            cls = "face" if walker % 2 else "plate"
            rows.append((f, cls, 0.5, round(x + v * f), round(y), 20, 20, rng.choice([None, f"{cls}:{walker}.{f // 20}"])))
    found = scene(spark, rows)
    assert {r.seq: r.chain_id for r in L.link(found, PLAIN).collect()} == plain_links([r.asDict() for r in found.collect()], PLAIN)


def test_links_of_the_test_detections(spark):
    found = Q.detections(spark, "/root/testdata/sf0.001").where("grp <> 'signage'")
    o = replace(Q.OPTIONS, fps=72.0, link_distance=4.0)
    assert {r.seq: r.chain_id for r in L.link(found, o).collect()} == plain_links([r.asDict() for r in found.collect()], o)


def test_a_chain_that_an_orphan_begins_counts_the_tracks_before_it(spark):
    rows = [(0, "face", 0.5, 10, 10, 20, 20, "face:k"), (1, "face", 0.5, 400, 300, 20, 20, None), (40, "face", 0.5, 200, 100, 20, 20, None)]
    assert [r.chain_id for r in L.link(scene(spark, rows), PLAIN).orderBy("seq").collect()] == ["face:k", "face:~2", "face:~3"]


def plain_merge(rows, o):
    out = []
    groups = defaultdict(list)
    for r in rows:
        groups[r["clip_id"], r["frame"], r["grp"]].append(r)
    for group in groups.values():
        clusters = []
        for r in sorted(group, key=lambda r: (-r["score"], r["seq"])):
            b = [r[s] for s in SIDES]
            for c in clusters:
                if any(twice(b, [m[s] for s in SIDES], o) for m in c):
                    c.append(r)
                    break
            else:
                clusters.append([r])
        for c in clusters:
            pick = c if c[0]["grp"] != "signage" else c[:1]
            out.append((c[0]["clip_id"], c[0]["frame"], c[0]["grp"], c[0]["cls"], c[0]["score"], len(c), min(m["x1"] for m in pick), min(m["y1"] for m in pick), max(m["x2"] for m in pick), max(m["y2"] for m in pick)))
    return sorted(out)


def twice(a, b, o):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    one, two = ((v[2] - v[0]) * (v[3] - v[1]) for v in (a, b))
    return both / (one + two - both) >= o.merge_iou or both / min(one, two) >= o.merge_iomin


def test_merges(spark):
    days = Q._by_day(spark, "/root/testdata/sf0.001")
    rng = random.Random(23)
    crowd = scene(spark, [(f, rng.choice(["face", "sign", "direction"]), rng.choice([0.2, 0.5, 0.9]), 100 + rng.randint(0, 25), 50 + rng.randint(0, 25), rng.randint(8, 30), rng.randint(8, 30), None) for f in range(15) for _ in range(9)])
    for found in (days, crowd):
        got = [(r.clip_id, r.frame, r.grp, r.cls, r.score, r.n, r.x1, r.y1, r.x2, r.y2) for r in L.merge_duplicates(found, PLAIN).collect()]
        assert sorted(got) == plain_merge([r.asDict() for r in found.collect()], PLAIN)


def test_a_merge_across_the_seam(spark):
    rows = [(0, "plate", 0.7, 622, 40, 36, 18, None), (0, "plate", 0.6, -20, 41, 38, 18, None), (0, "plate", 0.5, 300, 40, 36, 18, None)]
    found = sorted((r.x1, r.x2, r.n) for r in L.merge_duplicates(scene(spark, rows), PLAIN, 640.0).collect())
    assert found == [(300, 336, 1), (620, 658, 2)]


# small pieces


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6) | st.integers(-10**6, 10**6).map(lambda n: n / 20) | st.integers(-10**6, 10**6).map(lambda n: n / 2000), min_size=1, max_size=60), st.sampled_from([1, 2, 3, 7]))
def test_rounding(spark, values, digits):
    values += [10.25, 0.35, 2.675, 0.5, 1.5, -0.05, 0.15, 0.25]
    found = spark.createDataFrame([(float(v),) for v in values], "v double").select(round_half_even(F.col("v"), digits)).collect()
    assert [r[0] for r in found] == [round(float(v), digits) + 0.0 for v in values]


def test_turning_back(spark):
    b = Box.of()
    df = spark.createDataFrame([(float(i), 10.0 + i, 30.0 + i, 90.0, 90 * i) for i in range(-4, 5)], "x1 double, y1 double, x2 double, y2 double, d int")
    back = b.rotate(F.col("d"), 640, 480).unrotate(F.col("d"), 640, 480)
    assert all([r.x1, r.y1, r.x2, r.y2] == [r.a1, r.b1, r.a2, r.b2] for r in df.select("*", back.x1.alias("a1"), back.y1.alias("b1"), back.x2.alias("a2"), back.y2.alias("b2")).collect())
    up = df.where("d = 270").select(*b.rotate(F.col("d"), 640, 480).named()).first()
    assert list(up) == [480 - 90, 3, 480 - 13, 33]  # what was at the left is at the top, what was at the bottom at the left


def test_passes_come_to_the_frame(spark):
    found = spark.createDataFrame([(1, "g1024", 5.0, 6.0, 9.0, 9.0), (1, "tR", 5.0, 6.0, 9.0, 9.0)], "clip_id long, pass_id string, x1 double, y1 double, x2 double, y2 double")
    passes = spark.createDataFrame([(1, "g1024", "global", None, None, 30), (1, "tR", "tile", 400, 100, 0)], "clip_id long, id string, kind string, x1 int, y1 int, pad int")
    got = {r.pass_id: (r.x1, r.y1, r.x2, r.y2) for r in D.from_passes(found, passes).collect()}
    assert got == {"g1024": (-25, 6, -21, 9), "tR": (405, 106, 409, 109)}


def test_the_larger_part_of_a_sign_is_shown(spark):
    o = replace(PLAIN, wrap_width=640.0, sign_length=1)
    rows = [(f, "sign", 0.9, 620, 100 + f, 60, 20, "signage:x") for f in range(2)]
    tracks = S.sign_tracks(scene(spark, rows).withColumn("chain_id", F.col("track_id")), o)
    r = S.display_shapes(tracks, o).first()
    assert (r.x1, r.y1, r.x2, r.y2) == (0, 100, 40, 120)
    r = S.display_shapes(tracks, replace(o, wrap_width=None), 180).first()
    assert (r.x1, r.y1, r.x2, r.y2) == (0, 360, 20, 380)


def test_options_are_checked():
    with pytest.raises(ValueError):
        Options(conf_detect=0.5)
