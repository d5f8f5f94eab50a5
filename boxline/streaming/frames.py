"""Frame streams: recognition per frame, stable text, reuse and running latency."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from boxline.functions import geometry as G
from boxline.operators.metrics import most_common
from boxline.operators.overlap import MATCH_IOU
from boxline.operators.recognition import recognise
from boxline.session import shared_path

# Frames looked at and occurrences needed for a stable text.
RECENT, OCCURRENCES = 10, 3
BUFFER = 30
_ROW = ["ts", "frame_id", *G.BOX, "text"]


def recent_frames(frames: DataFrame, count: int = RECENT) -> DataFrame:
    """Regions of the last ``count`` distinct frames of each stream of a batch table.

    Each task drops regions of earlier frames ahead of the shuffle.
    """
    last = Window.partitionBy("stream_id").orderBy(F.col("ts").desc(), F.col("frame_id").desc())
    return frames.withColumn("_n", F.dense_rank().over(last)).where(F.col("_n") <= count).drop("_n")


def last_frames(rows: pd.DataFrame, count: int, keys: list[str] = []) -> pd.DataFrame:
    """Rows of the last ``count`` distinct frames (per ``keys``), in frame order."""
    names = [*keys, "ts", "frame_id"]
    ordered = rows.sort_values(names, kind="stable")
    if not len(ordered):
        return ordered
    new = ~ordered.duplicated(names)
    if not keys:
        number = new.cumsum()
        return ordered[number > number.iloc[-1] - count]
    groups = [ordered[k] for k in keys]
    number = new.astype("int64").groupby(groups, dropna=False).cumsum()
    return ordered[number > number.groupby(groups, dropna=False).transform("max") - count]


def stable_text(
    frames: DataFrame, box: list[int], count: int = RECENT, at_least: int = OCCURRENCES,
    min_iou: float = MATCH_IOU,
) -> DataFrame:
    """Batch form: the most common text of the last frames that overlap ``box``."""
    query = {f"q_{n}": F.lit(v) for n, v in zip(G.BOX, box)}
    near = recent_frames(frames, count).withColumns(query).where(G.iou() > min_iou)
    near = near.withColumn("seen", F.struct("ts", "frame_id"))
    return most_common(near, ["stream_id"], "text", "seen", at_least)


def latest_per_batch(frames: DataFrame, count: int) -> DataFrame:
    """Drops frames that others of the same Arrow batch make irrelevant, ahead of the shuffle.

    A busy stream then sends the regions of at most ``count`` frames per batch to the task that holds
    its state.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield last_frames(batch, count, ["stream_id"])

    return frames.mapInPandas(keep, frames.schema)


def _rows(frames: pd.DataFrame) -> list[tuple]:
    """Rows of ``_ROW`` as plain values that state can hold; the frames of one stream are too few for pandas."""
    return list(zip(*([_plain(v) for v in frames[c].tolist()] for c in _ROW)))


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime(warn=False)
    return int(value) if isinstance(value, float) else value


def _frame_order(row: tuple) -> tuple:
    """Time and number of a frame, nulls last."""
    return tuple((v is None, v) for v in row[:2])


def _last_rows(rows: list[tuple], count: int) -> list[tuple]:
    """``last_frames`` of the rows of one stream."""
    first = sorted({_frame_order(r) for r in rows})[-count:][0]
    return sorted((r for r in rows if _frame_order(r) >= first), key=_frame_order)


def most_stable(
    rows: list[tuple], box: list[int], at_least: int, min_iou: float
) -> tuple[str | None, int]:
    """The most common text of regions that overlap ``box``, and how often; (None, 0) when none is stable.

    ``rows`` are (ts, frame_id, box, text) in the order of frames.
    """
    bx1, by1, bx2, by2 = box
    counts: dict[str, int] = {}
    first: dict[str, tuple] = {}
    for when, frame, x1, y1, x2, y2, text in rows:
        if None in (x1, y1, x2, y2):
            continue
        wide, high = min(x2, bx2) - max(x1, bx1), min(y2, by2) - max(y1, by1)
        shared = wide * high
        union = (x2 - x1) * (y2 - y1) + (bx2 - bx1) * (by2 - by1) - shared
        if (shared / union if wide >= 0 and high >= 0 and union > 0 else 0.0) > min_iou:
            counts[text] = counts.get(text, 0) + 1
            first.setdefault(text, (when, frame))
    # As in the batch form: the text seen first, then the least one, wins among equals.
    best = min(counts, key=lambda t: (-counts[t], first[t], t)) if counts else None
    if best is None or counts[best] < at_least:
        return None, 0
    return best, counts[best]


def stable_text_stream(
    frames: DataFrame, box: list[int], count: int = RECENT, at_least: int = OCCURRENCES,
    min_iou: float = MATCH_IOU, delay: str = "10 minutes", idle_ms: int = 3_600_000,
    buffer: int = BUFFER,
) -> DataFrame:
    """Streaming form, to be written in update mode: (stream_id, text, n, last_ts).

    The state of a stream is its last ``buffer`` frames, each with all its regions; the last ``count`` of
    them are looked at. ``text`` is null while none is stable.
    Streams silent for ``idle_ms`` of event time beyond the watermark are forgotten.
    """
    buffer = max(buffer, count)
    wanted = latest_per_batch(frames.select("stream_id", *_ROW), buffer).withWatermark("ts", delay)
    state_schema = "ts array<timestamp>, frame_id array<long>, " + ", ".join(
        f"{n} array<int>" for n in G.BOX
    ) + ", text array<string>"

    def update(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            held = _last_rows(held + _rows(batch), buffer)
        state.update(tuple(list(column) for column in zip(*held)))
        last = pd.Timestamp(held[-1][0])
        end = int(last.timestamp() * 1000) + idle_ms
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        text, n = most_stable(_last_rows(held, count), box, at_least, min_iou)
        yield pd.DataFrame({"stream_id": [key[0]], "text": [text], "n": [n], "last_ts": [last]})

    return wanted.groupBy("stream_id").applyInPandasWithState(
        update, _OUTPUT, state_schema, "update", GroupStateTimeout.EventTimeTimeout
    )


_OUTPUT = "stream_id long, text string, n long, last_ts timestamp"


class StableText(StatefulProcessor):
    """Keeps the regions of a stream's last frames as a list that batches append to.

    The list is cut back to the last ``buffer`` frames once it holds more than twice as many, so a region is rewritten
    a bounded number of times however small the batches are. A timer forgets silent streams.
    """

    def __init__(self, box: list[int], count: int, at_least: int, min_iou: float, buffer: int, idle_ms: int):
        self.box, self.count, self.at_least, self.min_iou = box, count, at_least, min_iou
        self.buffer, self.idle_ms = buffer, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = ", ".join(f"{n} int" for n in G.BOX)
        self.handle = handle
        self.frames = handle.getListState("frames", f"ts long, frame_id long, {kinds}, text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Times are held as microseconds, which no zone touches.
        instant = T.TimestampType()
        own = _last_rows([(instant.toInternal(r.ts), *(r[c] for c in _ROW[1:])) for r in rows], self.buffer)
        # Each call to the state or the timers waits for the JVM, so a new stream makes three.
        held = [tuple(r) for r in self.frames.get()]
        every = _last_rows(held + own, self.buffer)
        frames = {r[:2] for r in held + own}
        if held and len(frames) <= 2 * self.buffer:
            fresh = [r for r in own if _frame_order(r) >= _frame_order(every[0])]
            if fresh:
                self.frames.appendList(fresh)
        else:
            self.frames.put(every)
        seen = _last_rows(every, self.count)
        last = seen[-1][0]
        for timer in list(self.handle.listTimers()) if held else []:
            self.handle.deleteTimer(timer)
        end = last // 1000 + self.idle_ms
        self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        text, n = most_stable(seen, self.box, self.at_least, self.min_iou)
        yield Row(stream_id=key[0], text=text, n=n, last_ts=instant.fromInternal(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.frames.clear()
        return iter([])

    def close(self) -> None:
        pass


def stable_text_states(
    frames: DataFrame, box: list[int], count: int = RECENT, at_least: int = OCCURRENCES,
    min_iou: float = MATCH_IOU, delay: str = "10 minutes", idle_ms: int = 3_600_000,
    buffer: int = BUFFER,
) -> DataFrame:
    """``stable_text_stream`` with list state and timers: a batch appends its frames instead of writing all anew.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which ``run_available`` sets.
    """
    buffer = max(buffer, count)
    wanted = latest_per_batch(frames.select("stream_id", *_ROW), buffer).withWatermark("ts", delay)
    return wanted.groupBy("stream_id").transformWithState(
        StableText(box, count, at_least, min_iou, buffer, idle_ms), _OUTPUT, "Update", "EventTime"
    )


def process_frames(frames: DataFrame, columns: list[str], factory: Callable) -> DataFrame:
    """One result per region of each frame, as frames come."""
    keep = ["stream_id", "frame_id", "ts", *G.BOX]
    return recognise(frames, columns, factory, keep, name="frames")


def reuse_stream(
    frames: DataFrame, keys: list[str] = ["stream_id", "hash"], delay: str = "10 minutes"
) -> DataFrame:
    """First frame of each content key within the watermark delay; only these need inference."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def running_latency(
    frames: DataFrame, width: str = "10 seconds", delay: str = "10 minutes"
) -> DataFrame:
    """Frames, mean, extremes and median of ``elapsed_ms`` per stream and time window."""
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    grouped = frames.withWatermark("ts", delay).groupBy(
        "stream_id", F.window("ts", width).alias("window")
    ).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg("elapsed_ms").alias("avg_ms"),
        F.min("elapsed_ms").alias("min_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.percentile_approx("elapsed_ms", 0.5, 10_000).alias("median_ms"),
    )
    return grouped.select(
        "stream_id", F.col("window.start").alias("window_start"), "frames",
        "avg_ms", "min_ms", "max_ms", "median_ms", (F.col("frames") / seconds).alias("fps"),
    )


# The state store that list state and timers need.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(
    stream: DataFrame, mode: str, name: str, folder: str | None = None, rocks: bool = False
) -> DataFrame:
    """Runs a stream over the input at hand and returns its output with ``batch_id``.

    Each micro-batch is written under its own number, so a repeated batch replaces itself. With a ``folder`` of an
    earlier run, the stream goes on from that run's progress and state. ``rocks`` takes the RocksDB state store.
    """
    spark = stream.sparkSession
    folder = folder or shared_path(spark, name)
    target, checkpoint = f"{folder}/rows", f"{folder}/progress"
    before = spark.conf.get(STORE)
    if rocks:
        spark.conf.set(STORE, ROCKS)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    try:
        query = (
            stream.writeStream.foreachBatch(write).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(target)


def latest_output(output: DataFrame, keys: list[str]) -> DataFrame:
    """The last row written per key by an update-mode stream."""
    fields = [c for c in output.columns if c not in keys]
    last = output.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch_id").alias("o"))
    return last.select(*keys, *[F.col(f"o.{c}").alias(c) for c in fields])


def late_rows(query) -> int:
    """Rows a running query has dropped for arriving behind the watermark."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet table, file or folder, as a stream."""
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may name one file as well as a folder of files.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .parquet(pattern)
    )
