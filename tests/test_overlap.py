"""Suppression, close pairs and evaluation against loops, crowded paths included."""

import random

import pytest
from pyspark.sql import functions as F

from boxline.operators import evaluation as E
from boxline.operators import overlap as O
from boxline.testing import canonical


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w < 0 or h < 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def _boxes(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randint(0, 120), rng.randint(0, 120)
        rows.append((
            rng.choice([1, 1, 1, 2]), rng.choice(["a", "b"]), i, x, y,
            x + rng.randint(-2, 60), y + rng.randint(1, 60), rng.randint(0, 50) / 50,
        ))
    return rows


SCHEMA = "image_id long, class string, det_id long, x1 int, y1 int, x2 int, y2 int, confidence double"


def _nms(rows, key, thr, keep):
    groups = {}
    for r in rows:
        groups.setdefault(key(r), []).append(r)
    out = []
    for members in groups.values():
        kept = []
        for r in sorted(members, key=lambda r: (-r[7], r[2])):
            if len(kept) < keep and all(_iou(k[3:7], r[3:7]) <= thr for k in kept):
                kept.append(r)
        out += [r[2] for r in kept]
    return sorted(out)


@pytest.mark.parametrize("limit,keep", [(1_000, 300), (7, 300), (7, 9)])
def test_nms(spark, limit, keep):
    rows = _boxes(1)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = O.nms(frame, limit=limit, keep=keep)
    assert sorted(r.det_id for r in got.collect()) == _nms(rows, lambda r: r[:2], 0.45, keep)
    agnostic = O.nms(frame, ["image_id"], limit=limit, keep=keep)
    assert sorted(r.det_id for r in agnostic.collect()) == _nms(rows, lambda r: r[0], 0.45, keep)


@pytest.mark.parametrize("min_iou", [0.3, 0.5, 0.8])
def test_close_pairs(spark, min_iou):
    left, right = _boxes(2, 90), _boxes(3, 90)
    a = spark.createDataFrame(left, SCHEMA).drop("confidence")
    b = spark.createDataFrame(right, SCHEMA).select(
        "image_id", "class", F.col("det_id").alias("truth_id"),
        *[F.col(c).alias(f"q_{c}") for c in ("x1", "y1", "x2", "y2")],
    )
    expected = sorted(
        (p[2], t[2]) for p in left for t in right
        if p[:2] == t[:2] and _iou(p[3:7], t[3:7]) >= min_iou
    )
    for limit in (5, 1_000):
        got = O.close_pairs(a, b, ["image_id", "class"], min_iou, limit)
        assert sorted((r.det_id, r.truth_id) for r in got.collect()) == expected


def _truth(rows):
    return [(i, c, 1000 + d, x1 + 1, y1, x2 + 2, y2) for i, c, d, x1, y1, x2, y2, _ in rows]


TRUTH = "image_id long, class string, truth_id long, x1 int, y1 int, x2 int, y2 int"


def test_evaluation_against_a_loop(spark):
    rows = [r for r in _boxes(5, 120) if r[5] > r[3]]
    truth = _truth(rows[::2])
    best = {}
    for p in rows:
        options = [(_iou(p[3:7], t[3:7]), -t[2]) for t in truth if t[:2] == p[:2]]
        options = [o for o in options if o[0] >= 0.5]
        if options:
            iou, negative = max(options)
            best[p[2]] = (-negative, iou, p[7], p[1])
    expected = {}
    for level in E.IOU_LEVELS:
        winners = {}
        for det, (t, iou, conf, cls) in best.items():
            if iou >= level and (t not in winners or (conf, -det) > winners[t][0]):
                winners[t] = ((conf, -det), cls)
        for (conf, _), cls in winners.values():
            key = (cls, level, round(conf * 1000))
            expected[key] = expected.get(key, 0) + 1
    predictions = spark.createDataFrame(rows, SCHEMA)
    truths = spark.createDataFrame(truth, TRUTH)
    for limit in (4, 1_000):
        tp = E.true_positives(E.match_truth(predictions, truths, limit=limit))
        assert {(r["class"], r.level, r.bucket): r.tp for r in tp.collect()} == expected


@pytest.mark.parametrize("limit", [5, 1_000])
def test_one_to_one_assignment(spark, limit):
    rows = [r for r in _boxes(9, 150) if r[5] > r[3] and r[6] > r[4]]
    # Copies on both sides, so that predictions contest truths and go on to their next best.
    rows += [(*r[:2], r[2] + 5000 * k, *r[3:7], round(r[7] - k / 50, 3)) for r in rows[:25] for k in (1, 2, 3)]
    truth = _truth(rows[::2])
    truth += [(i, c, t + 70_000, *box) for i, c, t, *box in truth[:30]]
    # A null class is a class of its own.
    rows, truth = rows + [(1, None, 1, 0, 0, 9, 9, 0.5)], truth + [(1, None, 2, 0, 0, 9, 8)]
    levels, expected, contested = [0.2, 0.6], set(), 0
    for key in {p[:2] for p in rows}:
        for level in levels:
            free = {t[2]: t for t in truth if t[:2] == key}
            for p in sorted((p for p in rows if p[:2] == key), key=lambda p: (-p[7], p[2])):
                options = sorted(
                    (-_iou(p[3:7], t[3:7]), t[3:7], t[2]) for t in truth
                    if t[:2] == key and _iou(p[3:7], t[3:7]) >= level
                )
                open_ = [o for o in options if o[2] in free]
                contested += bool(open_) and open_[0] != options[0]
                if open_:
                    del free[open_[0][2]]
                    expected.add((*key, level, p[2], open_[0][2]))
    assert contested > 20
    got = E.assign_truths(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(truth, TRUTH), levels, limit=limit
    ).collect()
    assert len(got) == len(expected)
    assert {(r.image_id, r["class"], r.level, r.det_id, r.truth_id) for r in got} == expected


def test_perfect_predictions_score_one(spark):
    rows = [(1, "a", i, 50 * i, 0, 50 * i + 20, 20, 0.9) for i in range(5)]
    truth = [(1, "a", i, 50 * i, 0, 50 * i + 20, 20) for i in range(5)]
    classes = spark.createDataFrame([("a",), ("b",)], "class string")
    scores = E.evaluate(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(truth, TRUTH), classes
    )
    got = {r["class"]: r for r in scores.collect()}
    assert (got["a"].ap50, got["a"].ap50_95, got["a"].recall) == (1.0, pytest.approx(1.0), 1.0)
    assert got["b"].ap50 == 0.0
    assert got["all"].ap50 == 0.5


def test_overlap_match_is_strict(spark):
    rows = [(1, "a", 1, 0, 0, 10, 10, 0.5), (1, "a", 2, 0, 0, 10, 8, 0.5), (2, "a", 3, 0, 0, 1, 1, 0.5)]
    query = spark.createDataFrame([(1, 0, 0, 10, 10)], "image_id long, q_x1 int, q_y1 int, q_x2 int, q_y2 int")
    got = O.overlap_match(spark.createDataFrame(rows, SCHEMA), query, ["image_id"])
    assert [r.det_id for r in got.collect()] == [1]


def test_only_close_pairs_are_gathered(spark):
    box = "x1 int, y1 int, x2 int, y2 int"
    sides = [
        spark.createDataFrame(
            [(1, "a", i, *rest, 10 * i, 0, 10 * i + 8, 8) for i in range(50)],
            f"image_id long, class string, {name}, {box}",
        )
        for name, rest in (("det_id long, confidence double", (0.5,)), ("truth_id long", ()))
    ]
    found = E.assign_truths(*sides, levels=[0.5, 0.9])
    assert sorted((r.level, r.det_id, r.truth_id) for r in found.collect()) == [
        (level, i, i) for level in (0.5, 0.9) for i in range(50)
    ]
    # One gathering, above the filter by overlap.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1 and plan.index("collect_list(") < plan.index("Join")


def test_edits_of_near_and_far_texts(spark):
    rng, rows = random.Random(4), [("", ""), ("a", ""), (None, "a"), ("same", "same")]
    for errors in (0, 1, 5, 12, 30, 60, 200):
        for letters in ("ab", "abcdefgh", "aé漢😀"):
            truth = "".join(rng.choices(letters, k=rng.randint(1, 120)))
            text = list(truth)
            for _ in range(errors):
                at = rng.randint(0, len(text))
                text[at:at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
            rows.append(("".join(text), truth))
    got = E.with_edits(spark.createDataFrame(rows, "predicted string, truth string")).withColumn(
        "all", F.levenshtein("predicted", "truth")
    ).collect()
    assert len(got) == len(rows) and all(r.edits == r["all"] for r in got)
    assert {0, 1} < {r.edits for r in got} and max(r.edits or 0 for r in got) > 40


def test_error_rate(spark):
    frame = spark.createDataFrame([("e", "kitten", "sitting"), ("e", "abc", "abc")], "engine string, predicted string, truth string")
    row = E.character_error_rate(frame, ["engine"]).first()
    assert (row.edits, row.chars, row.cer) == (3, 10, 0.3)


def test_canonical_is_stable():
    assert canonical([(2, 0.1 + 0.2), (1, None)]) == canonical([(1, None), (2, 0.3)])
