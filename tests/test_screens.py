"""Line splitters against plain loops, and reading from pixels with plug-ins."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from boxline.functions import splitters as L
from boxline.operators import screens as S
from boxline.operators.recognition import crop_regions

# Plug-ins of this module go to the tasks by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def flood(ink):
    """(x, y, w, h, area) of 8-connected parts by flood fill."""
    left, out = {(y, x) for y, x in zip(*np.nonzero(ink))}, []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            y, x = todo.pop()
            seen.append((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (y + dy, x + dx) in left:
                        left.remove((y + dy, x + dx))
                        todo.append((y + dy, x + dx))
        ys, xs = [p[0] for p in seen], [p[1] for p in seen]
        out.append((min(xs), min(ys), max(xs) + 1 - min(xs), max(ys) + 1 - min(ys), len(seen)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.05, 0.3, 0.5, 0.8])
def test_parts(share):
    rng = np.random.default_rng(int(share * 100))
    for _ in range(30):
        ink = rng.random((rng.integers(1, 20), rng.integers(1, 20))) < share
        assert sorted(L.parts(ink)) == flood(ink)


def test_closing():
    rng = np.random.default_rng(2)
    for high, wide in ((3, 5), (4, 6), (1, 2)):
        ink = rng.random((12, 15)) < 0.15

        def any_of(flags, y, x, up, left):
            return flags[max(0, y - up):max(0, y - up + high), max(0, x - left):max(0, x - left + wide)].any()

        up, left = high - 1 - high // 2, wide - 1 - wide // 2
        grown = np.array([[
            ink[max(0, y - up):y + high // 2 + 1, max(0, x - left):x + wide // 2 + 1].any() for x in range(15)
        ] for y in range(12)])
        shut = np.array([[
            grown[max(0, y - high // 2):y + up + 1, max(0, x - wide // 2):x + left + 1].all() for x in range(15)
        ] for y in range(12)])
        assert (L.closed(ink, high, wide) == shut).all()
        assert (L.closed(ink, high, wide) | ~ink).all()


def test_projection():
    ink = np.zeros((60, 40), bool)
    ink[5:25, 3:30] = ink[40:58, :20] = True
    found = L.projection(ink, 15, 20)
    assert [(y1, y2) for _, y1, _, y2, _ in found] == [(3, 27), (39, 59)]
    profile = np.convolve(ink.sum(1), np.ones(5) / 5, mode="same")
    assert np.allclose(L.smoothed(ink, 15), profile)
    assert L.projection(np.zeros((30, 10), bool), 15, 20) == []


@pytest.mark.parametrize("rows, span", [([2, 1, 7, 4, 2, 5, 5, 2], (1, 8)), ([6, 6, 2, 4, 4, 4, 2, 1], (0, 8))])
def test_projection_adds_rows_from_top_to_bottom(rows, span):
    # One row of each lies at 0.3 of the mean; the order of addition decides, as in the SQL.
    ink = np.arange(8) < np.array(rows)[:, None]
    assert [(y1, y2) for _, y1, _, y2, _ in L.projection(ink, 2, 2)] == [span]


def test_merged_and_names():
    lines = [(0, 0, 5, 10, 0.1), (2, 14, 9, 20, 0.7), (0, 25, 4, 30, 0.2)]
    assert L.merged(lines) == [(0, 0, 9, 20, 0.7), (0, 25, 4, 30, 0.2)]
    ink = np.ones((30, 30), bool)
    assert L.splitter("auto", 0.2, L.SPLITTERS)(ink, 15, 20) == L.component(ink, 15, 20)
    with pytest.raises(ValueError, match="unknown line splitter"):
        L.splitter("other", None, L.SPLITTERS)


def image(spark, arrays):
    """image_id and image; None is an unreadable image."""
    rows = [
        (i, None if a is None else (a.shape[0], a.shape[1], a.shape[2], bytearray(a.tobytes())))
        for i, a in enumerate(arrays)
    ]
    return spark.createDataFrame(
        rows, "image_id long, image struct<height:int,width:int,nChannels:int,data:binary>"
    )


def page(bands, high=80, wide=60, channels=3):
    out = np.full((high, wide, channels), 255, np.uint8)
    for a, b in bands:
        out[a:b, 5:50] = 0
    return out


def size_reader():
    return lambda pieces: [(f"{p.shape[1]}x{p.shape[0]}", 0.9) for p in pieces]


def test_read_regions(spark):
    shown = image(spark, [page([(5, 25), (40, 60)]), None, page([(10, 30)], channels=1), page([])])
    regions = spark.createDataFrame([
        (0, 0, 7, "chat_area", -5, 0, 60, 80), (0, 1, 8, "chat_area", 10, 35, 40, 900),
        (0, 2, 9, "send_button", 0, 0, 60, 80), (0, 3, 9, "chat_area", 30, 30, 30, 40),
        (1, 0, 1, "chat_area", 0, 0, 60, 80), (2, 0, 2, "side_info", 0, 5, 60, 80), (3, 0, 3, "chat_area", 0, 0, 60, 80),
        (99, 0, 4, "chat_area", 0, 0, 9, 9),
    ], "image_id long, region_idx long, det_id int, class string, x1 int, y1 int, x2 int, y2 int")
    got = S.read_regions(shown, regions, size_reader, ["chat_area", "side_info"]).collect()
    rows = sorted(
        (r["image_id"], r["det_id"], r["line_no"], r["region_id"], r["x1"], r["y1"], r["x2"], r["y2"], r["text"])
        for r in got
    )
    assert rows == [
        (0, 7, 1, "chat_area_1", 0, 3, 60, 27, "60x24"), (0, 7, 2, "chat_area_2", 0, 38, 60, 62, "60x24"),
        (0, 8, 1, "chat_area_1", 10, 38, 40, 62, "30x24"), (2, 2, 1, "side_info_1", 0, 8, 60, 32, "60x24"),
    ]
    assert all(r["error"] is None and r["confidence"] == 0.9 for r in got)


def test_splitter_plug_in_and_mixed_methods(spark):
    shown = image(spark, [page([(5, 25), (33, 60)])])
    crops = crop_regions(shown, spark.createDataFrame(
        [(0, i, 0, 0, 60, 80) for i in range(4)], "image_id long, region_idx long, x1 int, y1 int, x2 int, y2 int"
    )).withColumn("edge_density", F.lit(0.05)).withColumn(
        "method", F.element_at(F.array(F.lit("projection"), F.lit("auto"), F.lit("halves"), F.lit(None)),
                               (F.col("region_idx") + 1).cast("int")),
    )

    def halves(ink, min_height, min_width):
        middle = len(ink) // 2
        return [(0, 0, ink.shape[1], middle, 0.5), (0, middle, ink.shape[1], len(ink), 0.5)]

    got = {}
    for r in S.split_regions(crops, "component", {"halves": halves}).collect():
        got.setdefault((r["region_idx"], r["method"]), []).append((r["y1"], r["y2"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        (0, "projection"): [(3, 27), (31, 62)], (1, "auto"): [(3, 62)], (2, "halves"): [(0, 40), (40, 80)],
        (3, "component"): [(5, 25), (33, 60)],
    }
    with pytest.raises(Exception, match="unknown line splitter"):
        S.split_regions(crops.drop("method"), "no such").collect()


def band_detector():
    def detect(images):
        out = []
        for pixels in images:
            if pixels.shape[0] == 13:
                raise ValueError("odd page")
            rows = np.flatnonzero((pixels[..., 0] < 9).any(axis=1))
            groups = np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1) if len(rows) else []
            boxes = [(5, int(g[0]), 50, int(g[-1]) + 1) for g in groups]
            # Not in order, and one box outside the image.
            out.append([(900, 900, 950, 950), *boxes[::-1]])
        return out

    return detect


def odd_reader():
    def read(pieces):
        if any(p.shape[0] == 7 for p in pieces):
            raise ValueError("seven rows")
        known = {5: ("", 0.9), 9: ("low", 0.2), 11: ("unknown", None)}
        return [known.get(p.shape[0], (f"h{p.shape[0]}", 0.8)) for p in pieces]

    return read


def test_read_images(spark):
    shown = image(spark, [
        page([(2, 7), (10, 19), (20, 27), (30, 41), (50, 60)]), None, page([]), page([(1, 5)], high=13), page([(3, 23)]),
    ])
    plain = S.read_images(shown, band_detector, odd_reader)
    assert plain.columns == ["image_id", "line_no", "text"]
    want = [(0, 4, "unknown"), (0, 5, "h10"), (4, 1, "h20")]
    assert sorted(map(tuple, plain.collect())) == want
    full = S.read_images(shown, band_detector, odd_reader, boxes=True, confidences=True, errors=True)
    assert full.columns == ["image_id", "line_no", "text", "confidence", "x1", "y1", "x2", "y2", "error"]
    rows = {(r["image_id"], r["line_no"]): r for r in full.collect()}
    assert len(rows) == 5
    assert rows[0, 4]["confidence"] is None and rows[0, 5]["confidence"] == 0.8
    assert tuple(rows[0, 5])[4:8] == (5, 50, 50, 60)
    assert rows[0, 3]["text"] is None and "seven" in rows[0, 3]["error"]
    assert "odd page" in rows[3, None]["error"] and rows[3, None]["x1"] is None
    # Without order, numbers follow the detector, whose first box lies outside.
    loose = S.read_images(shown, band_detector, odd_reader, in_order=False).collect()
    assert sorted(map(tuple, loose)) == [(0, 2, "h10"), (0, 3, "unknown"), (4, 2, "h20")]


def test_no_detector_and_no_images(spark):
    shown = image(spark, [page([], high=9), page([], high=30), None])
    got = S.read_images(shown, None, odd_reader, min_confidence=0.1, boxes=True).collect()
    assert sorted(map(tuple, got)) == [(0, 1, "low", 0, 0, 60, 9), (1, 1, "h30", 0, 0, 60, 30)]
    # The least confidence holds whatever the flags.
    assert [r["image_id"] for r in S.read_images(shown, None, odd_reader).collect()] == [1]
    assert S.read_images(shown.limit(0), band_detector, odd_reader).count() == 0


def test_crowded_image_keeps_every_region(spark, monkeypatch):
    from boxline.operators import recognition as R

    monkeypatch.setattr(R, "PARTS_PER_COPY", 2)
    shown = image(spark, [page([(5, 25)]), page([(5, 25)])])
    regions = spark.range(400).select(
        F.expr("id div 390").alias("image_id"), (F.col("id") % 390).alias("region_idx"), F.lit(0).alias("x1"),
        F.lit(0).alias("y1"), F.lit(60).alias("x2"), F.lit(80).alias("y2"),
    )
    crops = R.crop_regions(shown, regions, crops=10)
    assert crops.where("crop is not null").count() == 400
