"""Detector hooks, cached detections beside frames, and ground-truth files."""

import pytest

from streetlens.operators import detect as T
from streetlens.operators import detections as D
from streetlens.sources import truth

FRAMES = [(1, f, bytes([f] * 4)) for f in range(20)] + [(2, 0, b"")]
PASSES = [(1, "whole", "whole", 0, 0, 10), (1, "t0", "tile", 100, 50, 0), (2, "whole", "whole", 0, 0, 0)]


def bright():
    class Bright:
        """Two steps: bytes become their sum, and a sum that is not 0 is a face of that width."""

        classes = ("face",)

        def prepare(self, inputs):
            assert len(inputs) <= 3
            return [sum(r["data"]) for r in inputs]

        def infer(self, prepared):
            return [[("face", 0.5, 0.0, 0.0, float(v), 1.0)] if v else [] for v in prepared]

    return Bright()


@pytest.fixture(scope="module")
def frames(spark):
    table = spark.createDataFrame(FRAMES, "clip_id long, frame long, data binary")
    return T.inputs(table, spark.createDataFrame(PASSES, "clip_id long, id string, kind string, x1 int, y1 int, pad int"))


def test_two_steps_and_passes_back_in_the_frame(spark, frames):
    model = bright()
    found = T.detect(frames, lambda: model, batch=3)
    moved = D.from_passes(found, spark.createDataFrame(PASSES, "clip_id long, id string, kind string, x1 int, y1 int, pad int"))
    rows = {(r.clip_id, r.frame, r.pass_id): (r.x1, r.y1, r.x2) for r in moved.collect()}
    assert rows == {(1, f, "whole"): (-10.0, 0.0, 4.0 * f - 10) for f in range(1, 20)} | {(1, f, "t0"): (100.0, 50.0, 4.0 * f + 100) for f in range(1, 20)}


def test_names_and_classes(frames):
    T.register("one sign", lambda: T.Simple(lambda r: [("sign", 1.0, 0.0, 0.0, 1.0, 1.0)] * 2, ("sign",)))
    found = T.detect(frames, "one sign").collect()
    assert len(found) == 82 and {r.seq for r in found} == {0, 1}
    with pytest.raises(ValueError, match="known already"):
        T.register("one sign", bright)
    with pytest.raises(ValueError, match="no detector is named 'x'"):
        T.detect(frames, "x")
    with pytest.raises(Exception, match="that it does not name"):
        T.detect(frames, lambda: T.Simple(lambda r: [("sign", 1.0, 0.0, 0.0, 1.0, 1.0)], ("face",))).collect()


def test_scripted_detector(frames):
    model = bright()
    script = T.detect(frames, lambda: model, batch=3)
    assert T.scripted(script, frames.where("frame < 3 AND pass_id = 't0'")).count() == 2


def test_cached_detections_beside_frames(spark, frames):
    model = bright()
    cached = T.detect(frames, lambda: model, batch=3).where("pass_id = 't0'").drop("pass_id")
    there = frames.where("pass_id = 'whole'").select("clip_id", "frame", "data")
    rows = T.with_frames(cached, there).collect()
    assert len(rows) == 21 and {(r.clip_id, r.frame) for r in rows if r.seq is None} == {(1, 0), (2, 0)}
    with pytest.raises(Exception, match="of clip 1 is not in the video"):
        T.with_frames(cached, there.where("frame < 5")).collect()


TRUTH = [("a", "face 1", "face", 3, 0, True, 1.0, 2.0, 3.5, 4.0), ("a", "face 1", "face", 2, 1, False, 1.0, 2.0, 3.0, 4.0), ("a", "plate 1", "plate", 0, 2, False, 0.0, 0.0, 1.0, 1.0), ("b", "face 1", "face", 0, 0, True, 5.0, 5.0, 6.0, 6.0)]


def test_truth_files(spark, tmp_path):
    rows = spark.createDataFrame(TRUTH, "clip_id string, track string, cls string, frame long, seq long, readable boolean, x1 double, y1 double, x2 double, y2 double")
    clips = spark.createDataFrame([("a", 10, 1920, 1080), ("b", 5, 640, 480), ("c", 7, 640, 480)], "clip_id string, frames long, width int, height int")
    truth.write(truth.clips_of(rows, clips), str(tmp_path / "t"))
    back = truth.read(spark, str(tmp_path / "t" / "*")).persist()
    assert sorted(tuple(r)[:4] for r in back.collect()) == sorted(tuple(r) for r in clips.collect())
    sides = [c for c in rows.columns if c != "seq"]
    assert sorted(map(tuple, truth.boxes(back).select(*sides).collect())) == sorted(map(tuple, rows.select(*sides).collect()))
    assert [r.frame for r in truth.boxes(back).where("clip_id = 'a' AND cls = 'face'").orderBy("seq").collect()] == [2, 3]


@pytest.mark.parametrize("text", ['{"version": 2, "clip_id": "a", "tracks": []}', '{"tracks": []}', '{"clip_id": "a", "tracks": [{"id": "x", "cls": "face", "boxes": [{"frame": 0, "box": [1, 2]}]}]}', '{"clip_id": '])
def test_bad_truth_is_an_error(spark, tmp_path, text):
    (tmp_path / "ground_truth.json").write_text(text)
    with pytest.raises(Exception, match="ground truth|MALFORMED"):
        truth.boxes(truth.read(spark, str(tmp_path))).collect()
        truth.read(spark, str(tmp_path)).collect()


def test_truth_over_lines_with_defaults(spark, tmp_path):
    (tmp_path / "x.json").write_text('{\n "clip_id": "a", "frames": 3, "width": 4, "height": 5,\n "tracks": [{"id": "p", "cls": "plate", "boxes": [{"frame": 1,\n "box": [1, 2, 3, 4]}]}]\n}')
    row = truth.boxes(truth.read(spark, str(tmp_path))).first()
    assert (row.track, row.frame, row.readable, row.x2) == ("p", 1, False, 3.0)
