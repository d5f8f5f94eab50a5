"""Limits steer how rows are spread and never what a result holds, also for null keys."""

from pyspark.sql import functions as F

from boxline.operators import decode, metrics, overlap, packing, reuse
from boxline.plans import extract
from boxline.streaming import frames as S


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def detections(spark):
    rows = [(None, None, i, i * 20, 0, i * 20 + 10, 10, 0.9 - i / 100) for i in range(30)]
    rows += [(None, None, 100 + i, i * 20 + 1, 0, i * 20 + 10, 10, 0.5) for i in range(10)]
    rows += [(1, "chat_message", i, i * 20, 0, i * 20 + 10, 10, 0.8) for i in range(3)]
    rows += [(None, "chat_message", 200 + i, i * 20, 0, i * 20 + 10, 10, 0.8) for i in range(12)]
    rows += [(None, "receiver_name", 300, 0, 0, 10, 10, 0.9)]
    return spark.createDataFrame(
        rows, "image_id long, class string, det_id long, x1 int, y1 int, x2 int, y2 int, confidence double"
    )


def test_suppression(spark):
    boxes = detections(spark)
    whole = rows_of(overlap.nms(boxes, limit=1000))
    assert len(whole) == 46
    assert rows_of(overlap.nms(boxes, limit=10)) == whole
    assert rows_of(overlap.nms(boxes, ["image_id"], limit=10)) == rows_of(
        overlap.nms(boxes, ["image_id"], limit=1000)
    )


def test_packs(spark):
    rows = [(None, i, 40 + i % 90, 20) for i in range(60)] + [(1, i, 50, 20) for i in range(5)]
    lines = spark.createDataFrame(
        rows, "image_id long, line_no int, effective_width int, char_height int"
    ).withColumn("scaled_width", F.col("effective_width") * 2)
    whole = rows_of(packing.pack_lines(lines, size=4000))
    assert len(whole) == 65
    assert rows_of(packing.pack_lines(lines, size=20)) == whole


def test_latency_of_a_null_group(spark):
    timings = spark.createDataFrame(
        [(None, float(v), True) for v in range(1, 4)] + [("a", 5.0, True)],
        "config string, elapsed_ms double, ok boolean",
    )
    found = {r["config"]: r["median_ms"] for r in metrics.latency_summary(timings, ["config"]).collect()}
    assert found == {None: 2.0, "a": 5.0}
    split = metrics.latency_summary(timings, ["config"], limit=1)
    assert rows_of(split) == rows_of(metrics.latency_summary(timings, ["config"]))


def test_decoded_null_line(spark):
    steps = spark.createDataFrame(
        [(None, i, i % 3, 0.5) for i in range(9)], "line_id long, t int, class_idx int, prob double"
    )
    names = spark.createDataFrame([(1, "a"), (2, "b")], "class_idx int, char string")
    row = decode.decode_steps(steps, names, ["t"]).collect()
    assert [(r["text"], r["confidence"]) for r in row] == [("ababab", 0.5)]


def test_fields_of_a_null_image(spark):
    found = extract.extract_fields(detections(spark)).collect()
    null = [r for r in found if r["image_id"] is None]
    assert len(null) == 1 and len(null[0]["messages"]) == 12 and null[0]["receiver"] is not None
    split = extract.extract_fields(detections(spark), limit=5)
    assert rows_of(split) == rows_of(extract.extract_fields(detections(spark)))


def test_model_rows_with_a_hot_key(spark):
    items = spark.createDataFrame(
        [(i, "k0" if i < 50 else f"k{i % 5}") for i in range(60)], "item_id long, hash string"
    )

    def run(limit):
        seen = spark.sparkContext.accumulator(0)

        def model(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch[["hash"]].assign(text=batch["hash"].str.upper())

        out = reuse.reuse_results(
            items, "hash", lambda todo: todo.mapInPandas(model, "hash string, text string"), limit=limit
        )
        return rows_of(out), seen.value

    plain, once = run(1000)
    split, again = run(10)
    assert plain == split and once == again == 5


def test_stable_text_over_frames_with_regions(spark):
    rows = [
        (1, f"2024-01-01 00:0{f}:00", f, 100 * r, 0, 100 * r + 50, 40, "hello" if r == 0 else f"{f}-{r}")
        for f in range(5) for r in range(7)
    ]
    table = spark.createDataFrame(
        rows, "stream_id long, ts string, frame_id long, x1 int, y1 int, x2 int, y2 int, text string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    box = [0, 0, 50, 40]
    assert [tuple(r) for r in S.stable_text(table, box).collect()] == [(1, "hello", 5)]
    assert S.recent_frames(table, 2).count() == 14
    pandas = table.toPandas()
    assert len(S.last_frames(pandas, 2, ["stream_id"])) == 14 and len(S.last_frames(pandas, 2)) == 14
