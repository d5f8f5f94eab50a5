"""Line finding against plain loops, with slices forced small."""

import random

import numpy as np
from pyspark.sql import functions as F

from boxline.operators import lines as L
from boxline.testing import canonical


def _profiles(seed, images=6, length=90):
    rng = random.Random(seed)
    out = []
    for image in range(images):
        y, ink = 0, []
        while y < length:
            run = rng.randint(1, 25)
            level = rng.choice([0, 0, 3, 40])
            ink += [level + rng.randint(0, 3) if level else 0 for _ in range(run)]
            y += run
        out.append((image, ink[:length - image]))
    return out


def _frame(spark, profiles):
    rows = [(image, y, v) for image, ink in profiles for y, v in enumerate(ink)]
    return spark.createDataFrame(rows, "image_id long, y int, ink int").repartition(3)


def _runs(flags, least):
    runs, start = [], None
    for y, above in enumerate(list(flags) + [False]):
        if above and start is None:
            start = y
        elif not above and start is not None:
            if y - start >= least:
                runs.append((start, y))
            start = None
    return runs


def test_kernel_is_odd():
    assert [L.kernel_size(h) for h in (3, 8, 15, 18, 30)] == [3, 3, 5, 7, 11]


def test_projection_runs(spark):
    profiles = _profiles(1)
    expected = []
    for image, ink in profiles:
        smooth = np.convolve(np.array(ink, float), np.ones(5) / 5, mode="same")
        for s, e in _runs(smooth > 0.3 * smooth.mean(), 8):
            expected.append((image, s, e))
    for size in (7, 100_000):
        got = L.projection_runs(_frame(spark, profiles), min_height=8, kernel=5, size=size)
        assert canonical([(r.image_id, r.start, r.end) for r in got.collect()]) == canonical(expected)


def test_adaptive_runs(spark):
    profiles = _profiles(2)
    expected = []
    for image, ink in profiles:
        values = np.array(ink)
        level = max(1, int(values[values > 0].mean() * 0.1))
        expected += [(image, s, e) for s, e in _runs(values > level, 9)]
    for size in (6, 100_000):
        frame = _frame(spark, profiles).withColumn("char_height", F.lit(16))
        got = L.adaptive_runs(frame, size=size)
        assert canonical([(r.image_id, r.start, r.end) for r in got.collect()]) == canonical(expected)


def test_a_run_over_many_slices_stays_one(spark):
    frame = _frame(spark, [(1, [0, 0] + [9] * 50 + [0, 0])])
    got = L.projection_runs(frame, min_height=3, kernel=3, size=5).collect()
    assert [(r.start, r.end) for r in got] == [(1, 53)]


def test_merge_close_follows_the_last_end(spark):
    ranges = [(1, 0, 30), (1, 12, 20), (1, 22, 40), (1, 60, 70), (2, 5, 9), (2, 14, 16)]
    frame = spark.createDataFrame(ranges, "image_id long, start int, end int")
    for limit in (2, 1_000_000):
        got = L.merge_close(frame, F.lit(3), limit=limit).collect()
        assert sorted((r.image_id, r.start, r.end) for r in got) == [
            (1, 0, 40), (1, 60, 70), (2, 5, 9), (2, 14, 16)
        ]
    strict = L.merge_close(frame, F.lit(5), strict=True).collect()
    assert (2, 5, 9) in {(r.image_id, r.start, r.end) for r in strict}


def _components(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(200):
        x, y = rng.randint(0, 300), rng.randint(0, 200)
        w, h = rng.randint(2, 40), rng.randint(2, 30)
        rows.append((rng.choice([1, 1, 1, 2]), i, x, y, w, h, w * h // 2, y + h / 2))
    return rows


def test_component_lines(spark):
    rows = _components(4)
    expected = []
    for image in (1, 2):
        members = sorted((r for r in rows if r[0] == image), key=lambda r: (r[7], r[1]))
        lines, current = [], []
        for row in members:
            if current and abs(row[7] - current[-1][7]) > 0.5 * max(row[5], current[-1][5]):
                lines.append(current)
                current = []
            current.append(row)
        lines.append(current)
        for line in lines:
            box = (min(r[2] for r in line), min(r[3] for r in line),
                   max(r[2] + r[4] for r in line), max(r[3] + r[5] for r in line))
            if box[3] - box[1] >= 15:
                share = sum(r[6] for r in line) / ((box[2] - box[0]) * (box[3] - box[1]))
                expected.append((image, *box, len(line), min(1.0, share * len(line) / 10)))
    schema = "image_id long, comp_id int, x int, y int, w int, h int, area int, cy double"
    frame = spark.createDataFrame(rows, schema)
    for limit in (10, 1_000_000):
        got = L.component_lines(frame, limit=limit).collect()
        assert canonical([
            (r.image_id, r.x1, r.y1, r.x2, r.y2, r.n_components, r.confidence) for r in got
        ]) == canonical(expected)


def test_text_structure_matches_numpy(spark):
    rows = _components(5)
    schema = "image_id long, comp_id int, x int, y int, w int, h int, area int, cy double"
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    got = {r.image_id: r for r in L.text_structure(spark.createDataFrame(rows, schema), images).collect()}
    for image in (1, 2):
        heights = [r[5] for r in rows if r[0] == image and r[6] > 20 and r[5] > 5 and r[4] > 3
                   and 0.1 < r[5] / r[4] < 10]
        char = int(np.median(heights))
        r = got[image]
        assert (r.char_height, r.char_height_std) == (char, int(np.std(heights)))
        assert (r.line_height, r.line_spacing) == (int(char * 1.2), max(5, int(char * 0.3)))
        assert r.height_distribution == np.histogram(heights, bins=10)[0].tolist()
    assert (got[3].char_height, got[3].line_height, got[3].line_spacing) == (20, 30, 10)


def test_text_structure_keeps_whole_deviations(spark):
    """The deviation is 7 exactly; the sum of squares in doubles came out below it and gave 6."""
    counts = {159: 3, 160: 2, 161: 2, 162: 2, 163: 1, 164: 2, 167: 1, 170: 1, 171: 1, 173: 1,
              175: 1, 186: 1}
    high = [h for h, n in counts.items() for _ in range(n)]
    assert len(high) * sum(h * h for h in high) - sum(high) ** 2 == (7 * len(high)) ** 2
    # Beside it: one pixel less in the tallest component, many of two heights, all of one height.
    below = high[:-1] + [185]
    rows = [(image, i, 0, 0, 100, h, 1000, 0.0)
            for image, heights in enumerate((high, below, [20] * 3000 + [60] * 3000, [12] * 5))
            for i, h in enumerate(heights)]
    schema = "image_id long, comp_id int, x int, y int, w int, h int, area int, cy double"
    got = L.text_structure(spark.createDataFrame(rows, schema)).collect()
    assert {r.image_id: r.char_height_std for r in got} == {0: 7, 1: 6, 2: 20, 3: 0}


def test_profile_widths(spark):
    ink = [0, 0, 1, 1, 0, 0, 0, 0, 0, 2, 0, 0]
    rows = [(1, x, v) for x, v in enumerate(ink)] + [(2, x, 0) for x in range(5)]
    frame = spark.createDataFrame(rows, "image_id long, x int, ink int")
    got = {r.image_id: r for r in L.profile_widths(frame, ["image_id"], F.lit(200)).collect()}
    assert (got[1].span_width, got[1].compact_width, got[1].adaptive_width) == (28, 23, 23)
    assert got[2].span_width == 200
