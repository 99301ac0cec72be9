"""Logs, telemetry packets and key frames, with expectations worked out by hand."""

import struct

import pytest

from streetlens.operators import keyframes as K
from streetlens.sources import logs, telemetry


def record(key, kind, size, payload):
    return struct.pack(">4sBBH", key, ord(kind) if kind else 0, size, len(payload) // size) + payload + b"\0" * (-len(payload) % 4)


def packet(rows, fix=3):
    inner = record(b"GPSF", "L", 4, struct.pack(">I", fix)) + record(b"SCAL", "l", 4, struct.pack(">5i", 10**7, 10**7, 1000, 1000, 100))
    inner += record(b"GPS5", "l", 20, b"".join(struct.pack(">5i", *r) for r in rows))
    stream = record(b"STRM", None, 1, inner)
    return record(b"DEVC", None, 1, stream)


def test_gps_samples(spark):
    rows = [(451234567, 57654321, 213000, 0, 0), (451234568, 57654322, 213000, 0, 0)]
    data = [(1, 10.0, 1.0, packet(rows)), (2, 0.0, 1.0, packet(rows, fix=0)), (3, 0.0, 1.0, packet([(0, 0, 1, 0, 0), rows[0]])), (4, 0.0, 1.0, b"junk"), (5, 0.0, 1.0, None), (6, 0.0, 1.0, packet(rows)[:-3])]
    found = telemetry.gps_samples(spark.createDataFrame(data, "clip_id long, start double, duration double, payload binary")).collect()
    assert [(r.clip_id, r.time) for r in sorted(found)] == [(1, 10.0), (1, 10.5), (3, 0.5)]
    first = min(found)
    assert (round(first.lat, 7), round(first.lon, 7), first.alt) == (45.1234567, 5.7654321, 213.0)


def log(spark, *lines):
    return logs.parse(spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "clip_id long, at long, line string"))


HEAD, FOOT = '{"type":"header","schema":"detections","version":1}', '{"type":"footer","frames":1,"complete":true}'
FRAME = '{"type":"frame","index":0,"time":0.0,"detections":[{"class":"face","score":0.4,"box":[1,2,3,4],"track_id":null,"seq":7}]}'


@pytest.mark.parametrize(
    "lines,problem",
    [
        ((HEAD, FRAME, FOOT), None), ((HEAD, FRAME), None), ((HEAD, "", FRAME), None), ((FRAME, FOOT), "header"), ((HEAD.replace("1}", "2}"), FRAME), "schema"),
        ((HEAD, FRAME.replace('"index":0', '"index":1')), "order"), ((HEAD, FOOT, FRAME), "content after footer"),
    ],
)
def test_log_check(spark, lines, problem):
    assert [r.problem for r in logs.check(log(spark, *lines)).collect()] == [problem]


def test_bad_line_is_an_error(spark):
    with pytest.raises(Exception, match="bad line 1 of clip 1"):
        log(spark, HEAD, "{nonsense").collect()


def test_log_detections(spark):
    assert [tuple(r) for r in logs.detections(log(spark, HEAD, FRAME, FOOT)).collect()] == [(1, 0, 7, "face", 0.4, None, 1.0, 2.0, 3.0, 4.0)]


def test_log_files(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text("\n".join((HEAD, FRAME, FOOT)) + "\n")
    assert logs.detections(logs.parse(logs.read(spark, f"file://{tmp_path}"))).count() == 1


def test_log_files_in_blocks(spark, tmp_path):
    for name, n in (("a", 500), ("b", 3)):
        (tmp_path / f"{name}.ndjson").write_text("".join(f"{name}{i} {'x' * (i % 7)}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256)
    try:
        found = logs.read(spark, str(tmp_path))
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, n in (("a", 500), ("b", 3)):
        own = sorted((r.at, r.line) for r in rows if r.clip_id.endswith(f"{name}.ndjson"))
        assert own == [(i, f"{name}{i} {'x' * (i % 7)}") for i in range(n)]


def test_key_frames_expand(spark):
    keys = [(1, "a", 0, 0, False, True, 0.0, 0.0, 10.0, 10.0), (1, "a", 4, 1, False, False, 40.0, 0.0, 50.0, 10.0), (1, "a", 6, 2, True, True, 60.0, 0.0, 70.0, 10.0), (1, "b", 8, 3, False, True, 1.0, 1.0, 2.0, 2.0)]
    found = K.expand(spark.createDataFrame(keys, "clip_id long, track string, frame long, seq long, outside boolean, readable boolean, x1 double, y1 double, x2 double, y2 double"), 10).collect()
    assert sorted((r.track, r.frame, r.x1) for r in found) == [("a", f, 10.0 * min(f, 4)) for f in range(6)] + [("b", 8, 1.0), ("b", 9, 1.0)]


def test_key_frames_thin(spark):
    frames = spark.createDataFrame([(1, "a", f) for f in (0, 2, 5, 6, 11, 40, 41)], "clip_id long, chain_id string, frame long")
    assert sorted((r.segment, r.frame) for r in K.thin(frames, 5, 10).collect()) == [(0, 0), (0, 5), (0, 11), (1, 40), (1, 41)]


def test_logs_are_complete_and_of_the_right_video(spark, tmp_path):
    from streetlens.plans import queries as Q
    from streetlens.sources import logs

    found = Q.detections(spark, "/root/testdata/sf0.001").where("clip_id < 4")
    lines = logs.to_lines(found, Q.FRAMES, 24.0, (1280, 720))
    clips = [r.clip_id for r in found.select("clip_id").distinct().orderBy("clip_id").collect()]
    videos = spark.createDataFrame([(c, 1280 if c != clips[0] else 640, 720) for c in [*clips, 999]], "clip_id long, width int, height int")
    problem = lambda parsed, **kw: {r.clip_id: r.problem for r in logs.owned(parsed, videos, **kw).collect()}
    assert problem(logs.parse(lines)) == {c: "size" if c == clips[0] else None for c in clips} | {999: "incomplete"}
    cut = logs.parse(lines.where("line NOT LIKE '%footer%'"))
    assert set(problem(cut).values()) == {"incomplete"}
    assert problem(cut, allow_partial=True) == {c: "size" if c == clips[0] else None for c in clips} | {999: "size"}
    logs.write(lines, str(tmp_path / "logs"))
    back = logs.detections(logs.parse(logs.read(spark, str(tmp_path / "logs" / "*"))))
    assert sorted((r.seq, r.frame, r.x1, r.score) for r in back.collect()) == sorted((r.seq, r.frame, r.x1, r.score) for r in found.collect())


def test_positions_count_from_the_first_frame_and_have_heights(spark):
    from streetlens.operators import signs
    from streetlens.sources import telemetry

    samples = spark.createDataFrame([(1, 5.0 + t, 10.0 + t, 20.0 - t, 100.0 + 4 * t) for t in range(4)], "clip_id long, time double, lat double, lon double, alt double")
    moved = telemetry.from_first_frame(samples, spark.createDataFrame([(1, 5.0)], "clip_id long, start double"))
    times = spark.createDataFrame([(1, 0.5), (1, 3.9), (1, 9.0), (1, -0.5)], "clip_id long, time double")
    at = {r.time: (r.lat, r.lon, r.alt) for r in signs.position_at(times, moved).collect()}
    assert at == {0.5: (10.5, 19.5, 102.0), 3.9: (13.0, 17.0, 112.0), 9.0: (None, None, None), -0.5: (10.0, 20.0, 100.0)}
