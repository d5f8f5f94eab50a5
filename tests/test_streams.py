"""Streams against their batch forms, over several micro-batches."""

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.streaming import frames as S
from boxline.testing import canonical

BOX = [8, 3, 108, 43]


def _split_input(spark, folder, tmp_path, parts=5):
    """The event table as several files, in time order."""
    events = X.zoned(X.table(spark, folder, "events"))
    path = str(tmp_path / "events")
    last = events.agg(F.max("event_id")).first()[0]
    for i in range(parts):
        low, high = (last + 1) * i // parts, (last + 1) * (i + 1) // parts
        part = events.where((F.col("event_id") >= low) & (F.col("event_id") < high))
        part.coalesce(1).write.mode("append").parquet(path)
    return events, path


def _rows(frame, columns):
    return canonical([tuple(r) for r in frame.select(*columns).collect()])


def test_stable_text_stream_equals_batch(spark, folder, tmp_path):
    events, path = _split_input(spark, folder, tmp_path)
    stream = X.frames_of(S.stream_table(spark, path, files_per_batch=1))
    out = S.run_available(S.stable_text_stream(stream, BOX), "update", "t-stable")
    assert out.select("batch_id").distinct().count() >= 5
    last = S.latest_output(out, ["stream_id"]).where("text IS NOT NULL")
    batch = S.stable_text(X.frames_of(events), BOX)
    columns = ["stream_id", "text", "n"]
    assert _rows(last, columns) == _rows(batch, columns)
    assert batch.count() > 0


def test_list_state_survives_a_restart(spark, folder, tmp_path):
    events, path = _split_input(spark, folder, tmp_path, parts=4)
    place = str(tmp_path / "run")
    # The first run sees two of the files, the second goes on with the state that it finds.
    files = sorted((tmp_path / "events").glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    later = tmp_path / "later"
    later.mkdir()
    for file in files[2:]:
        file.rename(later / file.name)

    def run():
        stream = X.frames_of(S.stream_table(spark, path, files_per_batch=1))
        states = S.stable_text_states(stream, BOX, idle_ms=10**12, delay="3650 days", buffer=12)
        return S.run_available(states, "update", "t-states", place, rocks=True)

    first = run().select("batch_id").distinct().count()
    for file in files[2:]:
        (later / file.name).rename(file)
    out = run()
    assert out.select("batch_id").distinct().count() > first >= 2
    last = S.latest_output(out, ["stream_id"]).where("text IS NOT NULL")
    columns = ["stream_id", "text", "n"]
    assert _rows(last, columns) == _rows(S.stable_text(X.frames_of(events), BOX), columns)


def test_a_new_stream_makes_three_state_calls():
    from datetime import datetime
    from unittest.mock import MagicMock

    from pyspark.sql import Row

    handle, timers = MagicMock(), MagicMock()
    handle.getListState.return_value.get.return_value = iter([])
    timers.getCurrentWatermarkInMs.return_value = 0
    states = S.StableText(BOX, 10, 3, 0.8, 30, 1000)
    states.init(handle)
    handle.reset_mock()
    rows = [
        Row(stream_id=1, ts=datetime(2024, 1, 1), frame_id=i, text="same", **dict(zip(("x1", "y1", "x2", "y2"), BOX)))
        for i in range(40)
    ]
    (out,) = states.handleInputRows((1,), iter(rows), timers)
    assert (out.text, out.n) == ("same", 10)
    assert sorted(c[0].split(".")[-1] for c in handle.mock_calls) == ["get", "put", "registerTimer"]


def test_silent_streams_are_forgotten(spark, tmp_path):
    path = str(tmp_path / "silent")
    schema = "stream_id long, frame_id long, ts timestamp, x1 int, y1 int, x2 int, y2 int, text string"
    # Stream 1 falls silent for a day; what it showed before doesn't count afterwards.
    for number, (stream, hour) in enumerate([(1, 0), (2, 30), (2, 31), (2, 32), (1, 33)]):
        rows = [(stream, 10 * number + i, hour * 3600 + i, *BOX, "same") for i in range(3)]
        spark.createDataFrame(rows, schema.replace("ts timestamp", "ts long")).withColumn(
            "ts", F.timestamp_seconds("ts")
        ).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    for states, rocks in ((S.stable_text_states, True), (S.stable_text_stream, False)):
        out = S.run_available(states(stream, BOX, delay="1 minute"), "update", "t-silent", rocks=rocks)
        got = {r.stream_id: r.n for r in S.latest_output(out, ["stream_id"]).collect()}
        assert got == {1: 3, 2: 9}


def test_last_frames_by_hand(spark):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}", 0, 0, 100, 100, "a" if i < 9 else "b") for i in range(14)]
    rows += [(2, i, f"2024-01-01 00:00:{i:02d}", 0, 0, 100, 100, t) for i, t in enumerate("xyxyz")]
    frame = spark.createDataFrame(
        rows, "stream_id long, frame_id long, ts string, x1 int, y1 int, x2 int, y2 int, text string"
    ).withColumn("ts", F.to_timestamp("ts"))
    got = {r.stream_id: (r.text, r.n) for r in S.stable_text(frame, [0, 0, 100, 100]).collect()}
    assert got == {1: ("a", 5)} or got == {1: ("b", 5)}
    # Frames 4..13 remain: five a, five b; a is seen first.
    assert got[1] == ("a", 5)
    two = S.stable_text(frame, [0, 0, 100, 100], at_least=2).where("stream_id = 2").first()
    assert (two.text, two.n) == ("x", 2)
    far = S.stable_text(frame, [0, 0, 100, 79])
    assert far.count() == 0


def test_reuse_and_latency(spark, folder, tmp_path):
    events, path = _split_input(spark, folder, tmp_path)
    stream = X.frames_of(S.stream_table(spark, path, files_per_batch=2))
    hashed = stream.withColumn("hash", F.md5("text")).select("stream_id", "hash", "ts")
    got = S.run_available(S.reuse_stream(hashed, delay="3650 days"), "append", "t-reuse")
    wanted = events.select("user_id", F.md5("event_type")).distinct()
    assert got.count() == wanted.count()

    stats = S.running_latency(stream, width="1 hour", delay="3650 days")
    out = S.latest_output(
        S.run_available(stats, "update", "t-latency"), ["stream_id", "window_start"]
    )
    assert out.agg(F.sum("frames")).first()[0] == events.count()


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    path = str(tmp_path / "late")
    schema = "stream_id long, ts timestamp, elapsed_ms double"
    for name, times in (("a", ["2024-01-01 00:00:05"]), ("b", ["2024-01-01 06:00:00"]),
                        # Spark judges lateness by the watermark of the batch before.
                        ("b2", ["2024-01-01 06:00:00"]), ("c", ["2024-01-01 00:00:06", "2024-01-01 06:00:02"])):
        rows = [(1, t, 1.0) for t in times]
        spark.createDataFrame(rows, "stream_id long, ts string, elapsed_ms double").withColumn(
            "ts", F.to_timestamp("ts")
        ).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        S.running_latency(stream, delay="1 minute").writeStream.format("memory").queryName("late")
        .outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert S.late_rows(query) == 1
    assert spark.table("late").agg(F.sum("frames")).first()[0] >= 3


def test_combining_keeps_the_last_frames(spark):
    rows = [(s, i) for s in (1, 2) for i in range(50)]
    frame = spark.createDataFrame(rows, "stream_id long, frame_id long").withColumn(
        "ts", F.timestamp_seconds("frame_id")
    ).coalesce(1)
    kept = S.latest_per_batch(frame, 10)
    assert sorted((r.stream_id, r.frame_id) for r in kept.collect()) == [
        (s, i) for s in (1, 2) for i in range(40, 50)
    ]
