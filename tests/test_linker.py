"""Linking and planning as streams against the same over a whole table."""

from dataclasses import replace

import pytest

from streetlens.operators import link as L
from streetlens.operators import plan as P
from streetlens.options import Options
from streetlens.plans import queries as Q
from streetlens.streaming.linker import GroupLinker, link_stream, plan_stream

COLUMNS = "clip_id long, grp string, frame long, seq long, cls string, score double, track_id string, x1 double, y1 double, x2 double, y2 double"
NAMES = [part.split()[0] for part in COLUMNS.split(", ")]


def row(frame, seq, x, track=None):
    return {"frame": frame, "seq": seq, "cls": "face", "score": 0.5, "track_id": track, "x1": float(x), "y1": 0.0, "x2": x + 20.0, "y2": 20.0}


def test_chains_are_final_after_the_gap():
    o = Options()
    linker = GroupLinker(1, "face", o)
    assert linker.take([row(0, 0, 0), row(1, 1, 1), row(1, 2, 500, "t")]) == []
    later = 1 + o.link_gap
    assert linker.take([row(later, 3, 1)]) == []
    found = linker.take([row(later + o.link_gap + 1, 4, 1)])
    assert sorted((r["seq"], r["chain_id"]) for r in found) == [(0, "face:~1"), (1, "face:~1"), (2, "t"), (3, "face:~1")]
    assert [(r["seq"], r["chain_id"]) for r in linker.close()] == [(4, "face:~3")]
    with pytest.raises(ValueError, match="came after"):
        linker.take([row(0, 9, 0)])


@pytest.fixture(scope="module")
def scene(spark):
    # tracks of the fixture may pause for longer than the gap: each pause begins a new track here
    o = replace(Options(), link_gap_s=1.25)
    rows, last = [], {}
    for r in Q.detections(spark, "/root/testdata/sf0.001").where("grp <> 'signage' AND clip_id < 12").orderBy("clip_id", "frame", "seq").collect():
        track = r.track_id
        if track is not None:
            frame, n = last.get((r.clip_id, track), (r.frame, 0))
            n += r.frame - frame > o.link_gap
            last[r.clip_id, track] = (r.frame, n)
            track = f"{track}.{n}"
        rows.append((r.clip_id, r.grp, r.frame, r.seq, r.cls, r.score, track, r.x1, r.y1, r.x2, r.y2))
    assert len({r[0] for r in rows}) > 3
    return o, rows


def test_streams_equal_the_whole(spark, tmp_path, scene):
    o, rows = scene
    for n, (low, high) in enumerate([(0, 100), (100, 101), (101, 400), (400, 10**9)]):
        part = [r for r in rows if low <= r[2] < high]
        if n == 3:
            part += [(c, g, 720, None, None, None, None, None, None, None, None) for c, g in sorted({r[:2] for r in rows})]
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    source = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    linked = link_stream(source, o)
    query = linked.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    whole = L.link(spark.createDataFrame(rows, COLUMNS), o)
    assert sorted(map(tuple, found.select("clip_id", "seq", "chain_id", "x1").collect())) == sorted(map(tuple, whole.select("clip_id", "seq", "chain_id", "x1").collect()))

    plan_stream(link_stream(source, o), o, 720, str(tmp_path / "plan"), str(tmp_path / "plan_state")).awaitTermination()
    key = ["clip_id", "chain_id", "segment", "frame", "kind", "cls", "source"]

    def shapes(plan):
        return sorted((*(r[k] for k in key), *(round(r[s], 6) for s in ("x1", "y1", "x2", "y2"))) for r in plan.collect())

    assert shapes(spark.read.parquet(str(tmp_path / "plan"))) == shapes(P.blur_plan(whole, o, 720))
