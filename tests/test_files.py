"""Box trees, annotation XML, sealed rows and set-up rules on small inputs."""

import struct
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from streetlens.operators import jobs as J
from streetlens.operators import keyframes as K
from streetlens.operators import layout as Y
from streetlens.sources import annotation_xml as A
from streetlens.sources import archive, boxes


def mp4(kind, body=b"", wide=False):
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def movie(*meta):
    entry = mp4(b"avc1", bytes(78) + mp4(b"sv3d", b"xy"))
    table = mp4(b"stsd", bytes(8) + entry)
    trak = mp4(b"trak", mp4(b"tkhd", bytes(84)) + mp4(b"mdia", mp4(b"minf", mp4(b"stbl", table))))
    return mp4(b"ftyp", b"isom") + mp4(b"moov", trak + mp4(b"udta", b"".join(meta)))


def test_boxes_survive_a_round_trip():
    data = movie(mp4(b"FIRM", b"1.0"), mp4(b"\xa9xyz", b"+45"))
    rows = list(boxes.scan(data))
    assert boxes.assemble([(r[0], r[1], r[2], r[6]) for r in rows]) == data
    assert "/moov/trak/mdia/minf/stbl/stsd/avc1/sv3d" in {r[3] for r in rows}
    assert [r[2] for r in boxes.scan(mp4(b"mdat", b"abc", wide=True) + struct.pack(">I4s", 0, b"free") + b"zz")] == ["mdat", "free"]
    assert list(boxes.scan(b"")) == [] and list(boxes.scan(b"1234567")) == []
    with pytest.raises(ValueError, match="impossible size"):
        list(boxes.scan(struct.pack(">I4s", 99, b"moov")))


def test_only_missing_allowed_metadata_is_carried(spark):
    def rows(data):
        return boxes.box_rows(spark.createDataFrame([("a", bytearray(data))], "path string, content binary"))

    source, target = movie(mp4(b"FIRM", b"1"), mp4(b"LENS", b"2"), mp4(b"thmb", b"3"), mp4(b"\xa9xyz", b"4")), movie(mp4(b"LENS", b"9"))
    assert {r["kind"] for r in boxes.missing_metadata(rows(source), rows(target)).collect()} == {"FIRM", "\xa9xyz"}


def film(media, matrix=boxes.IDENTITY, inner=b"", beside=b"", meta=None, version=0):
    head = bytes([version]) + bytes(boxes.MATRIX_AT[version] - 1) + matrix + bytes(8)
    table = mp4(b"stsd", bytes(8) + mp4(b"avc1", bytes(78) + inner))
    trak = mp4(b"trak", mp4(b"tkhd", head) + mp4(b"mdia", mp4(b"minf", mp4(b"stbl", table))) + beside)
    return mp4(b"ftyp", b"isom") + mp4(b"mdat", media) + mp4(b"moov", trak + (b"" if meta is None else mp4(b"udta", meta)))


def test_metadata_is_carried_from_file_to_file(spark):
    turned = struct.pack(">9i", 0, 0x10000, 0, -0x10000, 0, 0, 0, 0, 0x40000000)
    uuid = mp4(b"uuid", boxes.SPHERICAL_UUID + b"<xml/>")
    source = film(b"source", turned, mp4(b"sv3d", b"abc"), uuid, mp4(b"FIRM", b"1") + mp4(b"thmb", b"picture") + mp4(b"LENS", b"2"), version=1)
    plain = film(b"rendered")
    content, carried = boxes.transplant(source, plain)
    assert carried == ["uuid", "sv3d", "matrix", "FIRM", "LENS"]
    assert content == film(b"rendered", turned, mp4(b"sv3d", b"abc"), uuid, mp4(b"FIRM", b"1") + mp4(b"LENS", b"2"))
    assert boxes.transplant(source, content)[0] == content  # once more changes nothing
    assert boxes.transplant(plain, plain) == (plain, [])
    own = film(b"x", meta=mp4(b"LENS", b"own"))
    assert boxes.transplant(source, own)[1] == ["uuid", "sv3d", "matrix", "FIRM"]
    with pytest.raises(ValueError, match="not the last"):
        boxes.transplant(source, plain + mp4(b"free"))
    with pytest.raises(ValueError, match="0 moov"):
        boxes.transplant(mp4(b"ftyp"), plain)
    pairs = spark.createDataFrame([("a", bytearray(source), bytearray(plain)), ("b", bytearray(plain), bytearray(plain))], "path string, source binary, target binary")
    assert {(r["path"], bytes(r["content"]), len(r["carried"])) for r in boxes.carry_metadata(pairs).collect()} == {("a", content, 5), ("b", plain, 0)}


XML = """<?xml version="1.0"?><annotations><version>1.1</version>
<track id="0" label="face"><box frame="0" outside="0" xtl="1" ytl="2" xbr="11" ybr="12"><attribute name="readable">True</attribute></box>
<box frame="4" outside="1" xtl="5" ytl="2" xbr="15" ybr="12"><attribute name="readable">false</attribute></box></track>
<track id="1" label="tree"><box frame="0" outside="0" xtl="1" ytl="2" xbr="3" ybr="4"/></track>
<track id="2" label="plate"><box frame="2" outside="0" xtl="0" ytl="0" xbr="4" ybr="4"/><polygon frame="3"/></track></annotations>"""


def test_annotation_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    tracks = A.read(spark, str(tmp_path / "a.xml"))
    keys = A.keys(tracks, 7, ("face", "plate"), 2.0, 3.0)
    got = {(r["track"], r["frame"]): (r["outside"], r["readable"], r["x1"], r["y2"]) for r in keys.collect()}
    assert got == {("face:0", 0): (False, True, 2.0, 36.0), ("face:0", 4): (True, False, 10.0, 36.0), ("plate:2", 2): (False, False, 0.0, 12.0)}
    assert {(r["reason"], r["n"]) for r in A.skipped(tracks, ("face", "plate")).collect()} == {("label:tree", 1), ("shape:polygon", 1)}
    assert K.expand(keys, 6).count() == 4 + 4
    A.write(A.document(keys, ("face", "plate"), 6, 640, 360), str(tmp_path / "out"))
    (written,) = (tmp_path / "out" / "clip_id=7").glob("*.txt")
    root = ElementTree.parse(written).getroot()
    assert [e.text for e in root.iter("name")] == ["face", "readable", "plate", "readable"]
    assert [root.findtext(f"meta/task/{p}") for p in ("size", "stop_frame", "original_size/width", "original_size/height")] == ["6", "5", "640", "360"]
    assert [(t.get("id"), t.get("label"), t[0].get("xtl")) for t in root.iter("track")] == [("0", "face", "2.00"), ("1", "plate", "0.00")]
    back = A.keys(A.read(spark, str(written)), 7, ("face", "plate"))
    assert {(r["cls"], r["frame"], r["outside"], r["x1"]) for r in back.collect()} == {("face", 0, False, 2.0), ("face", 4, True, 10.0), ("plate", 2, False, 0.0)}
    with pytest.raises(Exception, match="no label for plate"):
        A.document(keys, ("face",), 6, 640, 360).collect()
    with pytest.raises(ValueError, match="not made of letters"):
        A.document(keys, ("a<b",), 6, 640, 360)


def test_sealed_rows(spark):
    # test vector 1 of the standard for the key derivation
    okm = archive.derive_key(bytes([0x0B] * 22), bytes(range(0xF0, 0xFA)), bytes(range(13)), 42)
    assert okm.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    key = archive.derive_key(b"secret", b"kept")
    rows = spark.createDataFrame([(1, bytearray(b"face")), (2, bytearray(b"")), (3, None)], "id long, data binary")
    sealed = archive.seal(rows, "data", key, "id").collect()
    assert b"face" not in bytes(sealed[0]["data"])
    kept = spark.createDataFrame(sealed, "id long, data binary")
    assert [r["data"] for r in archive.unseal(kept, "data", key, "id").orderBy("id").collect()] == [bytearray(b"face"), bytearray(b""), None]
    with pytest.raises(Exception, match="AES|decrypt"):
        archive.unseal(kept.where("id = 1").withColumn("id", F.col("id") + 1), "data", key, "id").collect()


def test_passes(spark):
    schema = "clip_id long, width int, height int, projection string, profile string"

    def ids(*row, pad=0.0):
        found = Y.passes(spark.createDataFrame([(1, *row)], schema), 5760, pad).orderBy("place").collect()
        return [(r["id"], r["imgsz"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in found]

    none = (None,) * 4
    assert ids(1920, 1080, "flat", "standard") == [("g1024", 1024, *none), ("g1920", 1920, *none)]
    assert ids(640, 360, "flat", "thorough") == [("g640", 640, *none)]
    assert ids(7680, 4320, "flat", "fast") == [("g1024", 1024, *none), ("g2048", 2048, *none)]
    assert ids(7680, 3840, "equirectangular", "standard", pad=0.05)[2:] == [("tL", 4096, -384, 960, 4320, 2880), ("tR", 4096, 3360, 960, 8064, 2880)]
    assert ids(7680, 3000, "flat", "standard")[2:] == [("t00", 4096 if 4224 > 4096 else 4224, 0, 0, 4224, 3000), ("t01", 4096, 3456, 0, 7680, 3000)]


def test_guards(spark):
    schema = "start_frame long, end_frame long, callback_url string, sync boolean, queued long, bytes long"
    rows = [(0, None, None, False, 0, 1), (5, 5, None, False, 0, 1), (0, 9, "https://ok.example/x", False, 0, 1), (0, 9, "ftp://ok.example/x", False, 0, 1), (0, 9, "http://no.example", False, 0, 1), (0, None, "::", False, 0, 1), (0, None, None, True, 0, 1), (0, None, None, False, 9, 1), (0, None, None, False, 0, 999)]
    found = J.request_code(spark.createDataFrame(rows, schema).coalesce(1), ("ok.example",), 9, 100, 0.0)
    assert [r["code"] for r in found.collect()] == [None, "invalid_parameter", None, "callback_not_allowed", "callback_not_allowed", "callback_not_allowed", "sync_too_long", "queue_full", "file_too_large"]


def test_replay_guards(spark):
    schema = "job_id long, seq long, kind string, status string, phase string, frames_done long, frames_total long, percent double"
    events = [
        (1, 1, "insert", None, None, None, None, None), (2, 1, "insert", None, None, None, None, None), (2, 2, "progress", None, "a", 1, 9, 1.0), (2, 3, "claim", None, None, None, None, None), (2, 4, "progress", None, "b", 5, 10, 50.0), (2, 5, "progress", None, "c", 6, None, 60.0),
        (3, 1, "claim", None, None, None, None, None), (3, 2, "finish", "succeeded", None, None, None, None), (3, 3, "finish", "failed", None, None, None, None), (3, 4, "progress", None, "z", 7, 7, 7.0), (3, 5, "expire", None, None, None, None, None),
        (4, 1, "finish", "cancelled", None, None, None, None), (4, 2, "claim", None, None, None, None, None), (4, 3, "expire", None, None, None, None, None),
    ]
    got = {r[0]: tuple(r)[1:] for r in J.replay(spark.createDataFrame(events, schema)).collect()}
    assert got == {1: ("queued", None, 0, None, 0.0), 2: ("running", "c", 6, 10, 60.0), 3: ("expired", None, 0, None, 100.0), 4: ("cancelled", None, 0, None, 0.0)}
