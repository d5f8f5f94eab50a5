"""Label quality on hand-made rows."""

from pyspark.sql import functions as F

from boxline.functions import geometry as G
from boxline.functions import sizing as S
from boxline.operators import quality as Q
from boxline.operators.nearest import nearest_avatar
from boxline.plans.extract import extract_fields

LABELS = "image_id long, class string, x1 int, y1 int, x2 int, y2 int"

def _labels(spark):
    return spark.createDataFrame([
        (1, "receiver_name", 0, 0, 100, 20),
        (1, "input_box", 0, 500, 700, 590),
        (2, "input_box", 0, 0, 50, 50),
        (2, "input_box", 0, 100, 3, 150),
        (2, "chat_message", 10, 10, 10, 40),
        *[(4, "receiver_name" if i == 0 else "input_box" if i == 1 else "contact_item", i, i, i + 50, i + 50)
          for i in range(21)],
    ], LABELS)


def _images(spark):
    return spark.createDataFrame([(1,), (2,), (3,), (4,)], "image_id long")


def test_review(spark):
    got = {r.image_id: (r.n_labels, r.needs_review, r.reason) for r in Q.needs_review(_images(spark), _labels(spark)).collect()}
    assert got == {
        1: (2, False, "labels look normal"),
        2: (3, True, "missing: receiver_name; repeated: input_box; size: 1 invalid_size, 1 too_small"),
        3: (0, True, "missing: receiver_name, input_box; no elements"),
        4: (21, True, "too many elements"),
    }


def test_report(spark):
    rows = {r.image_info.image_id: r for r in Q.validation_report(_images(spark), _labels(spark), F.lit(800), F.lit(600)).collect()}
    assert rows[1].recommendations == ["confirm"]
    assert rows[1].class_distribution == {"receiver_name": 1, "input_box": 1}
    assert rows[2].recommendations == ["check", "correct"]
    assert [(i.type, i["class"], i.severity) for i in rows[2].potential_issues] == [
        ("duplicate_unique_element", "input_box", "high"),
        ("missing_required_element", "receiver_name", "medium"),
    ]
    assert rows[3].statistics is None and rows[3].recommendations == ["check"]


def test_issue_codes(spark):
    rows = spark.createDataFrame([
        (1, "a", 5, 5, 5, 9), (1, "a", 0, 0, 9, 50), (1, "a", 0, 0, 641, 50), (1, "a", -1, 0, 20, 20),
        (1, "a", 0, 0, 640, 480), (1, "a", 795, 0, 803, 20),
    ], LABELS)
    got = [r.issues for r in Q.box_issues(rows, F.lit(800), F.lit(600)).collect()]
    assert got == [
        ["invalid_size"], ["too_small"], ["too_large"], ["out_of_bounds"], [],
        ["too_small", "out_of_bounds"],
    ]


def test_corrections(spark):
    before = spark.createDataFrame([(1, "a", 0, 0, 1, 1), (1, "a", 0, 0, 1, 1), (2, "b", 0, 0, 2, 2), (3, "a", 0, 0, 1, 1)], LABELS)
    after = spark.createDataFrame([(1, "a", 0, 0, 1, 1), (1, "c", 0, 0, 1, 1), (2, "b", 0, 0, 2, 2), (3, "a", 0, 0, 9, 1)], LABELS)
    diff = Q.label_diff(before, after)
    got = {r.image_id: (r.corrected, r.corrected_classes) for r in Q.corrections(diff).collect()}
    assert got == {1: (True, ["c"]), 2: (False, []), 3: (True, [])}
    stats = Q.session_statistics(diff).first()
    assert (stats.total_validated, stats.total_corrected, stats.overall_accuracy, stats.correction_rate) == (
        3, 2, "33.33%", "66.67%"
    )
    accuracy = {r["class"]: (r.total, r.errors, r.accuracy) for r in Q.class_accuracy(diff).collect()}
    assert accuracy["a"] == (3, 2, "33.33%") and accuracy["b"] == (1, 0, "100.00%")


def test_violations_hot_and_plain(spark):
    rows = spark.createDataFrame(
        [(1, "chat_message", i, 0, (i * 37) % 100, 10, 120) for i in range(60)] + [(2, "nope", 1, 0, 0, 5, 5)],
        "image_id long, class string, seq int, x1 int, y1 int, x2 int, y2 int",
    )
    plain = Q.spec_violations(rows, F.lit(800), F.lit(600))
    hot = Q.spec_violations(rows, F.lit(800), F.lit(600), limit=10)
    pick = ["image_id", "seq", "out_of_order", "unknown_class"]
    left = sorted(tuple(r) for r in plain.select(*pick).collect())
    assert left == sorted(tuple(r) for r in hot.select(*pick).collect())
    assert len(left) == 1 + sum((i * 37) % 100 < ((i - 1) * 37) % 100 for i in range(1, 60))


DETECTIONS = "image_id long, class string, det_id long, x1 int, y1 int, x2 int, y2 int, confidence double"


def test_fields(spark):
    rows = [
        (1, "receiver_name", 1, 100, 0, 200, 20, 0.9), (1, "receiver_name", 2, 0, 0, 10, 10, 0.9),
        (1, "receiver_avatar", 3, 60, 0, 100, 40, 0.6), (1, "receiver_avatar", 4, 60, 0, 100, 40, 0.7),
        (1, "receiver_avatar", 5, 700, 0, 740, 40, 0.99), (1, "input_box", 6, 0, 500, 9, 510, 0.4),
        *[(1, "contact_item", 10 + i, 0, i, 9, i + 9, 0.5 + i / 100) for i in range(12)],
        *[(1, "chat_message", 40 + i, 0, i, 9, i + 9, 0.6) for i in range(5)],
        (2, "receiver_name", 90, 0, 0, 10, 10, 0.8), (2, "receiver_avatar", 91, 200, 0, 210, 10, 0.8),
        (3, None, 95, 0, 0, 1, 1, 0.9), (4, "chat_message", 99, 0, 0, 1, 1, 0.1),
    ]
    frame = spark.createDataFrame(rows, DETECTIONS)
    for limit in (1, 2, 1_000_000):
        got = {r.image_id: r for r in extract_fields(frame, limit=limit).collect()}
        assert sorted(got) == [1, 2]
        one = got[1]
        assert (one.receiver.det_id, one.avatar.det_id, one.input_box) == (1, 4, None)
        assert [c.y1 for c in one.contacts] == list(range(11, 1, -1))
        assert [m.y1 for m in one.messages] == [0, 1, 2, 3, 4]
        assert got[2].receiver.det_id == 90 and got[2].avatar is None


def test_avatar_distance_is_strict(spark):
    rows = [(1, "receiver_name", 1, 0, 0, 10, 10, 0.9), (1, "receiver_avatar", 2, 200, 0, 210, 10, 0.9)]
    assert nearest_avatar(spark.createDataFrame(rows, DETECTIONS)).count() == 0
    assert nearest_avatar(spark.createDataFrame(rows, DETECTIONS), reach=201).count() == 1


def test_sizes(spark):
    frame = spark.createDataFrame([(10,), (20,), (34,), (35,), (100,)], "h int")
    scales = [r[0] for r in frame.select(S.batch_scale(F.col("h"))).collect()]
    assert scales == [4.8, 1.5, 48 / 34, 1.0, 0.48]
    buckets = [r[0] for r in frame.select(S.height_bucket(F.col("h"))).collect()]
    assert buckets == ["small", "medium", "medium", "large", None]
    sides = spark.createDataFrame([(1000, 400), (100, 200), (500, 400), (400, 400)], "w int, h int")
    plan = [tuple(r[0]) for r in sides.select(S.detection_size(F.col("w"), F.col("h"))).collect()]
    assert plan == [(640, 256), (320, 640), (416, 320), (416, 416)]


def test_image_validity(spark):
    frame = spark.createDataFrame([(8, 8), (7, 50), (4096, 4097), (-1, -1), (None, 9)], "w int, h int")
    got = [r[0] for r in frame.select(G.is_valid_image(F.col("w"), F.col("h"))).collect()]
    assert got == [True, False, False, False, False]
