"""Set-up files, folders, keys, pictures and the streams of packets, log lines and progress."""

import datetime as dt
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetlens.operators import cache as C
from streetlens.operators import pictures as X
from streetlens.operators.track import TrackOptions
from streetlens.sources import files, logs, setup_files
from streetlens.streaming import progress, tail
from streetlens.streaming.copier import RangeCopier, copy_stream
from streetlens.streaming.tracker import track_stream

CLIP = "- {id: %s, source_sha256: ab, start_s: 1, frames: 10, fps: 24, width: 8, height: 4, proxy_width: 4, proxy_height: 2, projection: flat}\n"
MODEL = "- {name: %s, family: f, version: '1', file: a.pt, url: 'https://host.example/a', sha256: %s, classes: [face, %s], train_imgsz: 640, min_memory_gib: 2, licence: free}\n"


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "manifest.yaml")
    assert setup_files.manifest(spark, path).count() == 0
    (tmp_path / "manifest.yaml").write_text("version: 1\nclips:\n" + CLIP % "b" + CLIP % "a-1")
    clips = setup_files.manifest(spark, path)
    assert {(r["id"], r["fps"], r["annotator"]) for r in clips.collect()} == {("b", 24.0, None), ("a-1", 24.0, None)}
    text = setup_files.manifest_text(setup_files.put(clips, clips.where("id = 'b'").withColumn("frames", F.lit(99).cast("long"))))
    (tmp_path / "again.yaml").write_text(text)
    assert [(r["id"], r["frames"]) for r in setup_files.manifest(spark, str(tmp_path / "again.yaml")).collect()] == [("a-1", 10), ("b", 99)]
    for bad, message in (("version: 2", "unknown version"), ("clips:\n" + CLIP % "'A b'", "clip ids"), ("clips:\n- {id: a, color: red}", "unknown fields"), ("clips:\n- {id: a}", "are missing")):
        (tmp_path / "manifest.yaml").write_text(bad)
        with pytest.raises(ValueError, match=message):
            setup_files.manifest(spark, path)


def test_registry_tracker_thresholds(spark, tmp_path):
    def put(text):
        (tmp_path / "f.yaml").write_text(text)
        return str(tmp_path / "f.yaml")

    good = "schema_version: 1\nmodels:\n" + MODEL % ("m", "a" * 64, "plate")
    assert [(r["name"], r["tag"], r["classes"], r["size_bytes"]) for r in setup_files.registry(spark, put(good)).collect()] == [("m", "m/1", ["face", "plate"], None)]
    for bad, message in ((good + MODEL % ("m", "b" * 64, "plate"), "occur twice"), (good.replace("plate", "face"), "classes of"), (good.replace("aaa", "zzz"), "sha256"), (good.replace("https", "file"), "pinned"), ("schema_version: 1", "must not be empty")):
        with pytest.raises(ValueError, match=message):
            setup_files.registry(spark, put(bad))
    assert setup_files.tracker(spark, put("tracker_type: flow\ngate: 3\ntrack_buffer_s: 1.5"), 24.0) == TrackOptions(gate=3.0, max_missed=36)
    for bad, message in (("tracker_type: flow\ngatee: 3", "unknown keys"), ("gate: 3", "missing"), ("tracker_type: other", "unknown tracker_type")):
        with pytest.raises(ValueError, match=message):
            setup_files.tracker(spark, put(bad), 24.0)
    assert setup_files.thresholds(spark, put("annotated_dataset: {max_leakage: 0.01, run: 3}")) == {"max_leakage": 0.01, "run": 3.0}
    with pytest.raises(ValueError, match="no section"):
        setup_files.thresholds(spark, put("other: {}"))


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert {(r["name"], r["length"]) for r in files.listing(spark, str(tmp_path)).collect()} == {("a.bin", 3), ("b.txt", 1)}
    assert [r["sha256"] for r in files.digests(spark, str(tmp_path), "*.bin").collect()] == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]


def test_log_files_keep_their_lines_in_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type": "header"}\n\n{"type": "footer"}\n')
    rows = logs.read(spark, str(tmp_path)).orderBy("at").collect()
    assert [(r["at"], r["line"]) for r in rows] == [(0, '{"type": "header"}'), (1, ""), (2, '{"type": "footer"}'), (3, "")]
    assert [r["type"] for r in logs.parse(logs.read(spark, str(tmp_path))).orderBy("at").collect()] == ["header", "footer"]


def test_keys_and_reuse(spark):
    one = spark.createDataFrame([(1, "x", None), (1, "y", 2)], "a int, b string, c int")
    keys = [r[0] for r in one.select(C.key("a", "b", "c")).collect()]
    assert keys == [r[0] for r in one.select(C.key("c", "a", "b")).collect()] and len(set(keys)) == 2 and all(len(k) == 12 for k in keys)
    schema = "clip_id long, det_key string, track_key string"
    wanted = spark.createDataFrame([(1, "d", "t"), (1, "d", "u"), (2, "d", "t"), (3, "d", "t"), (3, "d", "t")], schema)
    kept = spark.createDataFrame([(1, "d", "t", True), (1, "d", "s", True), (1, "d", "a", False), (3, "d", "t", False)], f"{schema}, complete boolean")
    assert {tuple(r) for r in C.reuse(wanted, kept).collect()} == {(1, "d", "t", "cached", None), (1, "d", "u", "retrack", "s"), (2, "d", "t", "detect", None), (3, "d", "t", "detect", None)}


def read_tags(data, at):
    kinds = {1: 1, 2: 1, 4: 4, 5: 8}
    out = {}
    for i in range(struct.unpack_from(">H", data, at)[0]):
        tag, kind, count = struct.unpack_from(">HHI", data, at + 2 + 12 * i)
        size = kinds[kind] * count
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(">I", data, at + 10 + 12 * i)[0]
        value = data[place : place + size]
        out[tag] = value if kind < 4 else struct.unpack(f">{size // 4}I", value)
    return out


def test_picture_tags(spark):
    rows = [(1.5, dt.datetime(2024, 12, 31, 23, 59, 59, 250000), 90, 48.5, -2.25, -3.5), (0.0, None, None, None, None, None)]
    pictures = spark.createDataFrame(rows, "time double, l timestamp_ntz, o int, lat double, lon double, alt double").withColumn("started", F.struct(F.col("l").alias("local"), F.col("o").alias("offset")))
    first, second = (r.asDict(recursive=True) for r in X.tags(pictures).orderBy(F.desc("time")).collect())
    assert (first["taken"], first["subsec"], first["zone"]) == ("2025:01:01 00:00:00", "750", "+01:30")
    block = X.exif_block(first, "streetlens")
    main = read_tags(block, 8)
    assert main[X.SOFTWARE] == b"streetlens\0"
    assert read_tags(block, main[X.EXIF_AT][0])[X.OFFSET] == b"+01:30\0"
    gps = read_tags(block, main[X.GPS_AT][0])
    assert (gps[1], gps[2], gps[3], gps[4], gps[5], gps[6]) == (b"N\0", (48, 1, 30, 1, 0, 10000), b"W\0", (2, 1, 15, 1, 0, 10000), b"\1", (350, 100))
    assert set(read_tags(X.exif_block(second, "x"), 8)) == {X.SOFTWARE}
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    data, chunks, at = X.png(image, block), {}, 8
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunks[kind] = data[at + 8 : at + 8 + size]
        assert struct.unpack_from(">I", data, at + 8 + size)[0] == zlib.crc32(kind + chunks[kind])
        at += 12 + size
    pixels = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(5, 22)
    assert (pixels[:, 1:].reshape(5, 7, 3) == image).all() and not pixels[:, 0].any() and chunks[b"eXIf"] == block


def test_range_copier():
    c = RangeCopier()
    script = [("packet", 0, 0.0), ("packet", 1, 0.6), ("skipped", -1, 0.5), ("packet", 2, 1.2), ("rendered", -1, 1.0), ("packet", 3, 0.9), ("packet", 4, 1.7), ("rendered", -1, 1.5), ("last", -1, 2.0), ("packet", 5, 2.4), ("packet", 6, 2.5)]
    out = [p for kind, seq, time in script for p in c.take(kind, 7, seq, time, 0.5 if kind == "last" else 0.0)]
    assert [(s, n, round(t, 6)) for s, n, t in out] == [(7, 2, 0.2), (7, 4, 0.7), (7, 5, 1.4)]
    assert c.state["waiting"] == []


def run_stream(df, spark, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_copy_stream(spark, tmp_path):
    schema = "clip_id long, seq long, kind string, stream long, time double, duration double"
    one = [(1, 0, "packet", 3, 0.0, None), (1, 1, "packet", 3, 1.25, None), (1, 2, "rendered", None, 1.0, None)]
    two = [(1, 3, "last", None, 1.5, 0.5), (1, 4, "packet", 3, 1.75, None), (1, 5, "packet", 3, 2.0, None), (1, 6, "end", None, 0.0, None), (2, 0, "packet", 1, 0.0, None), (2, 1, "last", None, 0.0, 0.5)]
    for rows in (one, two):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    assert sorted(tuple(r) for r in run_stream(copy_stream(events), spark, "copied")) == [(1, 3, 1, 0.25), (1, 3, 4, 0.75), (2, 1, 0, 0.0)]


def test_log_lines_reach_the_tracker(spark, tmp_path):
    found = spark.createDataFrame([(1, 0, 1, "face", 0.5, None, 10.0, 10.0, 30.0, 30.0), (1, 2, 2, "face", 0.5, None, 12.0, 10.0, 32.0, 30.0)], "clip_id long, frame long, seq long, cls string, score double, track_id string, x1 double, y1 double, x2 double, y2 double")
    lines = [r["line"] for r in logs.to_lines(found, 3, 24.0).orderBy("at").collect()]
    (tmp_path / "log").mkdir()
    for part, some in enumerate((lines[:3], lines[3:])):
        (tmp_path / "log" / f"1-{part}.jsonl").write_text("\n".join(some) + "\n\n")
    rows = tail.arriving(tail.lines(spark, str(tmp_path / "log"), 1)).withColumns({"clip_id": F.col("clip_id").cast("long"), "grp": F.lit("face")})
    tracked = run_stream(track_stream(rows, TrackOptions()), spark, "tailed")
    assert sorted(tuple(r) for r in tracked) == [(1, "face", 0, 1, "face:1"), (1, "face", 2, 2, "face:1")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "1-0.jsonl").write_text('{"type": "other"}\n')
    with pytest.raises(Exception, match="bad line"):
        run_stream(tail.arriving(tail.lines(spark, str(tmp_path / "bad"))), spark, "badly")


def test_progress(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "analyzing", t + dt.timedelta(seconds=10.1), t, 5, 100), (1, "analyzing", t + dt.timedelta(seconds=10.8), t, 20, 100), (1, "rendering", t + dt.timedelta(seconds=20), t + dt.timedelta(seconds=10), 200, 100), (2, "analyzing", t, t, 0, 100), (3, "analyzing", t, t, 7, None)]
    got = {(r["job_id"], r["phase"]): (r["done"], round(r["percent"], 6), r["eta_s"]) for r in progress.throttled(spark.createDataFrame(rows, "job_id long, phase string, at timestamp, started_at timestamp, done long, total long")).collect()}
    assert got == {(1, "analyzing"): (20, 14.0, 43), (1, "rendering"): (200, 100.0, -5), (2, "analyzing"): (0, 0.0, None), (3, "analyzing"): (7, 0.0, None)}
