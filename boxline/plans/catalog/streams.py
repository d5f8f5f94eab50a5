"""Queries over frames: batch forms, and streams run over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.plans.catalog import views as V
from boxline.plans.catalog.readings import label_reader
from boxline.streaming import frames as S

BOX = [8, 3, 108, 43]


def _stream(spark, folder):
    return X.frames_of(X.zoned(S.stream_table(spark, f"{folder}/events.parquet")))


def _regions(spark, folder):
    return X.frame_regions(X.table(spark, folder, "events"))


def recent_frames(spark, folder):
    """Regions of the last ten frames of each stream; a frame has several."""
    return S.recent_frames(_regions(spark, folder)).select("stream_id", "frame_id")


def stable_text(spark, folder):
    return S.stable_text(_regions(spark, folder), BOX)


def stable_text_stream(spark, folder):
    events = X.zoned(S.stream_table(spark, f"{folder}/events.parquet"))
    stream = S.stable_text_stream(X.frame_regions(events), BOX)
    out = S.run_available(stream, "update", "stable")
    return S.latest_output(out, ["stream_id"]).where(F.col("text").isNotNull()).select(
        "stream_id", "text", "n"
    )


def stable_text_states(spark, folder):
    """The same with list state and timers."""
    events = X.zoned(S.stream_table(spark, f"{folder}/events.parquet"))
    stream = S.stable_text_states(X.frame_regions(events), BOX)
    out = S.run_available(stream, "update", "states", rocks=True)
    return S.latest_output(out, ["stream_id"]).where(F.col("text").isNotNull()).select(
        "stream_id", "text", "n"
    )


def reuse_stream(spark, folder):
    """Frames whose text is new on their stream; the delay spans the whole table."""
    hashed = _stream(spark, folder).withColumn("hash", F.md5("text"))
    first = S.reuse_stream(hashed.select("stream_id", "hash", "ts"), delay="3650 days")
    return S.run_available(first, "append", "reuse").select("stream_id", "hash")


def running_latency_stream(spark, folder):
    stats = S.running_latency(_stream(spark, folder), width="1 day", delay="3650 days")
    out = S.run_available(stats, "update", "latency")
    last = S.latest_output(out, ["stream_id", "window_start"])
    return last.select(
        "stream_id",
        F.convert_timezone(
            F.current_timezone(), F.lit("UTC"), F.col("window_start").cast("timestamp_ntz")
        ).alias("window_start"),
        "frames", F.round("avg_ms", 4).alias("avg_ms"),
        "min_ms", "max_ms", F.round("fps", 9).alias("fps"),
    )


def process_frames_stream(spark, folder):
    read = S.process_frames(_stream(spark, folder), ["text"], label_reader)
    return S.run_available(read, "append", "frames").select(
        "stream_id", "frame_id", "text", "confidence"
    )


QUERIES = {f.__name__: f for f in (
    recent_frames, stable_text, stable_text_stream, stable_text_states, reuse_stream, running_latency_stream,
    process_frames_stream,
)}

_RECENT = """recent AS (SELECT * FROM frames QUALIFY dense_rank() OVER (PARTITION BY stream_id
  ORDER BY ts DESC, frame_id DESC) <= 10)"""
_STABLE = V.using(V.FRAME_REGIONS, _RECENT, f"""near AS (SELECT * FROM (SELECT r.*, {V.iou('r.', 'q.')} AS iou
    FROM recent r, (SELECT 8 AS x1, 3 AS y1, 108 AS x2, 43 AS y2) q) WHERE iou > 0.8),
counted AS (SELECT stream_id, text, count(*) AS n, min((ts, frame_id)) AS seen
  FROM near GROUP BY stream_id, text)""") + """
SELECT stream_id, text, n FROM (SELECT * FROM counted QUALIFY row_number() OVER (
  PARTITION BY stream_id ORDER BY n DESC, seen, text) = 1) WHERE n >= 3"""

SQL = {
    "recent_frames": V.using(V.FRAME_REGIONS, _RECENT) + "SELECT stream_id, frame_id FROM recent",
    "stable_text": _STABLE,
    "stable_text_stream": _STABLE,
    "stable_text_states": _STABLE,
    "reuse_stream": V.using(V.FRAMES) + """
SELECT DISTINCT stream_id, md5(text) AS hash FROM frames""",
    "running_latency_stream": V.using(V.FRAMES) + """
SELECT stream_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS frames,
  round(avg(elapsed_ms), 4) AS avg_ms, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms,
  round(count(*) / 86400.0::DOUBLE, 9) AS fps
FROM frames GROUP BY 1, 2""",
    "process_frames_stream": V.using(V.FRAMES) + """
SELECT stream_id, frame_id, '<' || text || '>' AS text, length(text) / 16.0::DOUBLE AS confidence
FROM frames""",
}
