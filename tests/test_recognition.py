"""Images, crops and recognisers on tiny files written here."""

import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxline.operators import metrics as M
from boxline.operators import recognition as R
from boxline.plans.dataset import pair_all, prepare_dataset, unlabelled
from boxline.sources import images as I
from boxline.sources import labels as L
from boxline.sources import sinks as S


def write_png(path, pixels):
    h, w = pixels.shape
    raw = b"".join(b"\x00" + pixels[y].tobytes() for y in range(h))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


@pytest.fixture(scope="module")
def pictures(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(1)
    arrays = {}
    for name, shape in (("a.png", (16, 24)), ("b.PNG", (40, 30)), ("tiny.png", (5, 5))):
        arrays[name] = rng.integers(0, 256, shape, dtype=np.uint8)
        write_png(folder / name, arrays[name])
    (folder / "broken.jpg").write_bytes(b"no image")
    (folder / "note.txt").write_text("not an image")
    return str(folder), arrays


def test_scan_and_decode(spark, pictures):
    folder, arrays = pictures
    scanned = I.scan_images(spark, folder)
    assert sorted(r.stem for r in scanned.collect()) == ["a", "b", "broken", "tiny"]
    assert [r.stem for r in I.scan_images(spark, folder, max_images=2).collect()] == ["a", "b"]
    requests = {r.stem: r.image_base64 for r in I.encode_requests(scanned).collect()}
    assert "\r" not in requests["b"] and requests["broken"] == "bm8gaW1hZ2U="
    decoded = {r.stem: r for r in I.decode_images(spark, folder).collect()}
    assert {k: v.is_valid for k, v in decoded.items() if k != "note"} == {
        "a": True, "b": True, "broken": False, "tiny": False
    }
    assert bytes(decoded["a"].image.data) == arrays["a.png"].tobytes()


def _images(spark, folder):
    ids = F.when(F.col("stem") == "a", 1).when(F.col("stem") == "b", 2).otherwise(3).cast("long")
    return I.decode_images(spark, folder).where("stem IN ('a', 'b', 'broken')").select(
        ids.alias("image_id"), "image"
    )


@pytest.mark.parametrize("crops,copies", [(256, 64), (2, 1)])
def test_crops(spark, pictures, monkeypatch, crops, copies):
    folder, arrays = pictures
    monkeypatch.setattr(R, "PARTS_PER_COPY", copies)
    boxes = [(0, 2, 1, 10, 9), (1, -5, -5, 4, 4), (2, 20, 10, 99, 99), (3, 5, 5, 5, 9), (4, 30, 0, 40, 9)]
    rows = [(image, *b) for image in (1, 2, 3) for b in boxes]
    regions = spark.createDataFrame(rows, "image_id long, region_idx long, x1 int, y1 int, x2 int, y2 int")
    got = {(r.image_id, r.region_idx): r for r in R.crop_regions(_images(spark, folder), regions, crops).collect()}
    assert len(got) == 15
    for image, name in ((1, "a.png"), (2, "b.PNG")):
        pixels = arrays[name]
        h, w = pixels.shape
        for idx, x1, y1, x2, y2 in boxes:
            piece = pixels[max(0, y1):max(0, min(y2, h)), max(0, x1):max(0, min(x2, w))]
            r = got[(image, idx)]
            if piece.size == 0:
                assert r.crop is None
            else:
                assert bytes(r.crop) == piece.tobytes()
                assert (r.crop_height, r.crop_width) == piece.shape
                assert r.mean_gray == pytest.approx(piece.mean())
    assert all(got[(3, i)].crop is None for i in range(5))


def test_ink_profiles(spark, pictures):
    folder, arrays = pictures
    rows = _images(spark, folder).where("image.height > 0").select(
        "image_id", R.ink_profiles(
            F.col("image.data"), F.col("image.height"), F.col("image.width"),
            F.col("image.nChannels"), F.lit(128),
        ).alias("p"),
    )
    for r in rows.collect():
        ink = arrays["a.png" if r.image_id == 1 else "b.PNG"] < 128
        assert r.p.rows == ink.sum(1).tolist() and r.p.cols == ink.sum(0).tolist()
        assert len(r.p.thumbnail) == 64


def test_errors_stay_in_their_row(spark):
    def shout():
        def read(items):
            if any(i == "bad" for i in items):
                raise ValueError("cannot read")
            return [(i.upper(), 0.9) for i in items]
        return read

    frame = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "image_id long, v string").coalesce(1)
    got = {r.image_id: r for r in R.recognise(frame, ["v"], shout, ["image_id"], name="shout").collect()}
    assert got[1].text == "A" and got[3].text == "C"
    assert got[2].text is None and "cannot read" in got[2].error


def test_realign_fills_blanks(spark):
    inputs = spark.createDataFrame([(i,) for i in range(4)], "pos long")
    results = spark.createDataFrame([(1, "x", 0.5), (3, None, None)], "pos long, text string, confidence double")
    got = [(r.text, r.confidence) for r in R.realign(inputs, results, ["pos"]).orderBy("pos").collect()]
    assert got == [("", 0.0), ("x", 0.5), ("", 0.0), ("", 0.0)]


def test_routes(spark):
    rows = [("input_box", 250.0, None), ("input_box", 100.0, None), ("send_button", 1.0, "send"),
            ("send_button", 1.0, None), ("chat_message", 255.0, "x"), ("contact_item", 255.0, "x")]
    frame = spark.createDataFrame(rows, "class string, mean_gray double, known_text string")
    got = [r[0] for r in frame.select(R.route(F.col("class"), F.col("mean_gray"), F.col("known_text"))).collect()]
    assert got == ["empty", "single_line", "known", "single_line", "multi_line", "single_line"]


def test_standard_inputs(spark):
    image = "struct<height:int,width:int>"
    arrays = spark.createDataFrame([(0, (9, 9)), (1, None)], f"pos long, image {image}")
    paths = spark.createDataFrame([(2, "/x/p1.png", (9, 9)), (3, "/x/p2.png", (-1, -1))], f"pos long, path string, image {image}")
    dicts = spark.createDataFrame([(4, "own", (9, 9)), (5, None, (9, 9))], f"pos long, id string, image {image}")
    got = {r.pos: r.source_id for r in R.standard_inputs(spark, arrays, paths, dicts).collect()}
    assert got == {0: "image_0", 2: "p1", 4: "own", 5: "dict_5"}


def test_timed(spark):
    frame = spark.createDataFrame([("e", "c", 1, 2.0), ("e", "c", 2, 0.0)], "engine string, config string, item_id long, item double")
    times = frame.mapInPandas(R.timed(lambda v: 1 / v, rounds=2), R.TIMINGS)
    row = M.latency_summary(times, ["engine"]).first()
    assert (row.total_calls, row.successful_calls) == (4, 2)


def test_label_files(spark, tmp_path):
    for name, body in (("a", "0 0.5 0.5 0.1 0.1\n1 0.5 0.5 0.2 0.2\n"), ("b", "9 0.5 0.5 0.1 0.1\n"),
                       ("c", "\n"), ("d", "1 0.5 0.5 0.1 0.1\n\n1 0.5 0.5 0.1 0.1\n")):
        (tmp_path / f"{name}.txt").write_text(body)
    lines = L.read_label_lines(spark, str(tmp_path))
    strict = {r.image_stem: r.is_valid for r in L.label_file_validity(lines).collect()}
    loose = {r.image_stem: r.is_valid for r in L.label_file_validity(lines, require_nonempty=False).collect()}
    assert strict == {"a": True, "b": False, "c": False, "d": False}
    assert loose == {"a": True, "b": False, "c": True, "d": False}
    named = spark.createDataFrame([("a",), ("zero",)], "image_stem string")
    listed = L.label_file_validity(lines, require_nonempty=False, files=named)
    assert {r.image_stem: r.is_valid for r in listed.collect()} == {**loose, "zero": True}
    parsed = L.parse_label_lines(lines.where("image_stem = 'a'")).orderBy("line_no").collect()
    assert [(r.class_id, r.w) for r in parsed] == [(0, 0.1), (1, 0.2)]
    images = spark.createDataFrame([("a",), ("b",), ("e",)], "image_stem string")
    manifest = prepare_dataset(images, L.label_file_validity(lines)).collect()
    assert [r.image_stem for r in manifest] == ["a"]
    assert [r.image_stem for r in unlabelled(images, lines).collect()] == ["e"]
    assert pair_all(images, L.label_file_validity(lines)).count() == 3


def test_label_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"objects": [{"class": "a",\n "bbox": [1, 2, 3, 4], "more": 1}]}')
    (tmp_path / "y.json").write_text('{"analysis": "none"}')
    got = {r.image_stem: (r["class"], r.bbox) for r in L.read_label_json(spark, str(tmp_path)).collect()}
    assert got == {"x": ("a", [1, 2, 3, 4]), "y": (None, None)}


def test_dictionary(spark, tmp_path):
    path = tmp_path / "chars.txt"
    path.write_text("a\n\n 字 \nb\n", encoding="utf-8")
    got = L.read_character_dictionary(spark, str(path)).orderBy("class_idx").collect()
    assert [r.char for r in got] == ["<blank>", "a", "字", "b", " "]
    assert [r.class_idx for r in got] == [0, 1, 2, 3, 4]


def test_writers(spark, tmp_path):
    lines = spark.createDataFrame([("a", 1, "l1"), ("a", 0, "l0")], "image_stem string, line_no int, line string")
    images = spark.createDataFrame([("a", "train"), ("b", "val")], "image_stem string, split string")
    S.write_label_files(lines, images, str(tmp_path / "labels"))

    def files():
        root = tmp_path / "labels"
        return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}

    assert files() == {"train/a.txt": "l0\nl1\n", "val/b.txt": ""}
    assert not (tmp_path / "labels" / "_jobs").exists()
    # A job with a failing task changes nothing and leaves nothing behind.
    bad = images.union(spark.createDataFrame([("up/../c", "train")], images.schema))
    with pytest.raises(Exception, match="not a file name"):
        S.write_label_files(lines.unionByName(lines.withColumn("line", F.lit("other"))), bad, str(tmp_path / "labels"))
    assert files() == {"train/a.txt": "l0\nl1\n", "val/b.txt": ""}
    assert not (tmp_path / "labels" / "_jobs").exists()
    S.write_label_files(lines, images.where("split = 'train'"), str(tmp_path / "labels"))
    assert files() == {"train/a.txt": "l0\nl1\n"}
    S.write_dataset(images, str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set")).where("split = 'val'").count() == 1
    stats = spark.createDataFrame([(2, 4, 10.0)], "calls int, regions int, total_ms double")
    results = spark.createDataFrame([("chat", 1, 0, "hi", 0.5)], "source_type string, image_id long, region_idx long, text string, confidence double")
    S.write_report(S.report_lines(stats, results), str(tmp_path / "report"))
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert "- regions: 4" in text and "chat 1/0: hi (confidence 0.500)" in text
    S.write_json(results, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    S.write_json(results.union(results), str(tmp_path / "session"), stamped=True)
    stamps = {r.run_stamp for r in spark.read.json(str(tmp_path / "session")).collect()}
    assert len(stamps) == 1 and re.fullmatch(r"\d{8}_\d{6}", stamps.pop())


def test_packed_reading(spark):
    from boxline.plans.page_text import read_packed_lines

    def joined():
        return lambda packs: [("|".join(p), 0.8) for p in packs]

    rows = [(1, i, f"line {i}", 100, 20, 240) for i in range(30)]
    frame = spark.createDataFrame(rows, "image_id long, line_no int, line string, effective_width int, char_height int, scaled_width int")
    got = read_packed_lines(frame, "line", joined, strategy="aggressive").orderBy("line_no").collect()
    assert [r.text for r in got] == [f"line {i}" for i in range(30)]


def test_grouping_parts(spark):
    rows = [(1, "s", i, f"t{i}", 0.5, 0, 0, 1, 1) for i in range(25)]
    frame = spark.createDataFrame(rows, "image_id long, source_type string, region_idx long, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    got = {r.part: [x.text for x in r.results] for r in R.group_by_source(frame, part=10).collect()}
    assert {k: len(v) for k, v in got.items()} == {0: 10, 1: 10, 2: 5}
    assert got[1][0] == "t10"
