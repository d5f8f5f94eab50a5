"""Recognition as batch inference: crops, routes, a model per Python worker, realignment.

A recogniser is given as ``factory() -> recognise`` where ``recognise`` maps a list of regions to
a list of (text, confidence). The factory runs once per Python worker and model name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxline.functions import geometry as G
from boxline.functions.text import split_lines, stem
from boxline.operators.hot import hot_keys, small
from boxline.session import shared_path

# Regions cropped from one copy of an image; crowded images are sent in several copies.
CROPS_PER_ROW = 256
# Rows of boxes that share one copy of an image in the join.
PARTS_PER_COPY = 64
# Crops given back to Spark at once.
CROP_BYTES, CROP_ROWS = 64_000_000, 10_000
# Fixed value: mean gray above this is an empty region.
EMPTY_GRAY = 240
EMPTY, KNOWN, MULTI, SINGLE = "empty", "known", "multi_line", "single_line"

_models: dict[str, Callable] = {}


def _model(name: str, factory: Callable) -> Callable:
    if name not in _models:
        _models[name] = factory()
    return _models[name]


def _guarded(recognise: Callable, items: list) -> list[tuple]:
    """(text, confidence, error, ms) per item; a failing batch is retried item by item."""
    start = time.perf_counter()
    try:
        found = list(recognise(items))
        if len(found) != len(items):
            raise ValueError("a recogniser must give one result per region")
        each = (time.perf_counter() - start) * 1000 / max(1, len(items))
        return [(text, conf, None, each) for text, conf in found]
    except Exception as error:
        if len(items) == 1:
            return [(None, None, str(error), (time.perf_counter() - start) * 1000)]
        return [row for item in items for row in _guarded(recognise, [item])]


_RESULT = [
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("time_ms", T.DoubleType()),
    T.StructField("worker_id", T.IntegerType()),
]


def _items(batch: pd.DataFrame, columns: list[str]) -> list:
    """What a recogniser sees of each row."""
    if len(columns) == 1:
        return batch[columns[0]].tolist()
    return list(batch[columns].itertuples(index=False, name=None))


def recognise(
    regions: DataFrame, columns: list[str], factory: Callable, keep: list[str],
    name: str = "default",
) -> DataFrame:
    """Runs a recogniser over rows; ``columns`` are what it sees, ``keep`` is what is passed on.

    Errors become a value of ``error``; the row stays. Filter and project before this call: Spark
    moves nothing below a Python stage.
    """
    wanted = list(dict.fromkeys([*keep, *columns]))
    source = regions.select(*wanted)
    schema = T.StructType([source.schema[c] for c in keep] + _RESULT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(name, factory)
        context = TaskContext.get()
        worker = context.partitionId() if context else 0
        for batch in batches:
            items = _items(batch, columns)
            done = _guarded(model, items) if items else []
            out = batch[keep].copy()
            for i, field in enumerate(["text", "confidence", "error", "time_ms"]):
                out[field] = pd.Series([d[i] for d in done], index=batch.index, dtype=object)
            for field in ("confidence", "time_ms"):
                out[field] = out[field].astype("float64")
            out["worker_id"] = np.int32(worker)
            yield out

    return source.mapInPandas(run, schema)


def image_boxes(
    images: DataFrame, regions: DataFrame, crops: int = CROPS_PER_ROW, carry: list[str] = [],
) -> DataFrame:
    """(image_id, height, width, nChannels, data, boxes): pixels beside at most ``crops`` boxes of their image.

    A box has region_idx, x1, y1, x2, y2 and the columns ``carry``. Boxes travel to the image; a crowded image
    is copied, so that its boxes spread over several tasks.
    """
    boxes = regions.withColumn("_part", F.floor(F.col("region_idx") / crops).cast("long"))
    grouped = boxes.groupBy("image_id", "_part").agg(
        F.collect_list(F.struct("region_idx", *G.BOX, *carry)).alias("boxes")
    )
    pixels = images.select(
        "image_id", "image.height", "image.width", "image.nChannels", "image.data"
    )
    crowded = hot_keys(regions.select("image_id"), ["image_id"], crops * PARTS_PER_COPY)
    if crowded is None:
        return grouped.join(pixels, "image_id", "left")
    share = F.ceil(F.col("_rows") / (crops * PARTS_PER_COPY)).cast("int")
    copies = small(crowded.select("image_id", share.alias("_copies")))
    copied = F.sequence(F.lit(0), F.coalesce(F.col("_copies") - 1, F.lit(0)))
    pixels = pixels.join(copies, "image_id", "left").withColumn("_copy", F.explode(copied)).drop("_copies")
    # Counts are estimates, so parts are dealt to however many copies there are.
    turn = F.floor(F.col("_part") / PARTS_PER_COPY) % F.coalesce("_copies", F.lit(1))
    grouped = grouped.join(copies, "image_id", "left").withColumn("_copy", turn.cast("int")).drop("_copies")
    return grouped.join(pixels, ["image_id", "_copy"], "left")


def crop_regions(images: DataFrame, regions: DataFrame, crops: int = CROPS_PER_ROW) -> DataFrame:
    """(image_id, region_idx, crop, crop_height, crop_width, channels, mean_gray).

    ``images`` has image_id and the ``image`` struct of Spark's reader; ``regions`` has image_id,
    a dense 0-based region_idx and a box. An empty or unreadable crop has a null ``crop``.
    """
    paired = image_boxes(images, regions, crops)
    schema = (
        "image_id long, region_idx long, crop binary, crop_height int, crop_width int, "
        "channels int, mean_gray double"
    )

    columns = [part.split()[0] for part in schema.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                pixels = _pixels(row)
                for box in row.boxes:
                    piece = _piece(pixels, box)
                    key = (row.image_id, box["region_idx"])
                    if piece is None:
                        rows.append((*key, None, 0, 0, 0, None))
                    else:
                        rows.append((
                            *key, piece.tobytes(), *piece.shape, float(_gray(piece).mean())
                        ))
                        held += piece.size
                if held > CROP_BYTES or len(rows) > CROP_ROWS:
                    yield _crop_frame(rows, columns)
                    rows, held = [], 0
        yield _crop_frame(rows, columns)

    return paired.mapInPandas(cut, schema)


def _crop_frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"mean_gray": "float64"})


def _piece(pixels: np.ndarray | None, box) -> np.ndarray | None:
    """The pixels of a box, clamped to the image; None when nothing is left."""
    if pixels is None or box["x2"] <= box["x1"] or box["y2"] <= box["y1"]:
        return None
    h, w = pixels.shape[:2]
    piece = pixels[
        max(0, min(box["y1"], h)):max(0, min(box["y2"], h)),
        max(0, min(box["x1"], w)):max(0, min(box["x2"], w)),
    ]
    return piece if piece.size else None


def _pixels(row) -> np.ndarray | None:
    if row.data is None or row.height is None or not row.height > 0:
        return None
    shape = (int(row.height), int(row.width), int(row.nChannels))
    return np.frombuffer(row.data, np.uint8).reshape(shape)


def _gray(pixels: np.ndarray) -> np.ndarray:
    """Gray values of a BGR or gray array."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return pixels[:, :, :3].astype(np.float32) @ np.array([0.114, 0.587, 0.299], np.float32)


_PROFILE = T.StructType([
    T.StructField("rows", T.ArrayType(T.IntegerType())),
    T.StructField("cols", T.ArrayType(T.IntegerType())),
    T.StructField("thumbnail", T.ArrayType(T.DoubleType())),
])


@F.pandas_udf(_PROFILE)
def ink_profiles(
    data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, dark: pd.Series
) -> pd.DataFrame:
    """Ink pixels per row and column (gray below ``dark``), and an 8 x 8 mean thumbnail."""
    out = []
    for raw, h, w, c, level in zip(data, height, width, channels, dark):
        if raw is None or not h > 0:
            out.append((None, None, None))
            continue
        gray = _gray(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), int(c)))
        ink = gray < level
        rows = np.array_split(np.arange(int(h)), 8)
        cols = np.array_split(np.arange(int(w)), 8)
        if int(h) >= 8 and int(w) >= 8:
            thumb = [float(gray[np.ix_(r, k)].mean()) for r in rows for k in cols]
        else:
            thumb = None
        out.append((ink.sum(1).tolist(), ink.sum(0).tolist(), thumb))
    return pd.DataFrame(out, columns=["rows", "cols", "thumbnail"])


def route(kind: Column, mean_gray: Column, known_text: Column) -> Column:
    """How an element is read: not at all, from the known texts, as several lines or as one."""
    return (
        F.when((kind == "input_box") & (mean_gray > EMPTY_GRAY), EMPTY)
        .when((kind == "send_button") & known_text.isNotNull(), KNOWN)
        .when(kind == "chat_message", MULTI)
        .otherwise(SINGLE)
    )


def recognise_elements(
    elements: DataFrame, columns: list[str], single: Callable, multi: Callable, keep: list[str]
) -> DataFrame:
    """Reads elements by route, in one pass over them.

    ``elements`` carries ``class``, ``mean_gray`` and ``known_text``. Empty and known elements reach no
    model.
    """
    routed = elements.withColumn(
        "route", route(F.col("class"), F.col("mean_gray"), F.col("known_text"))
    )
    keep = [*keep, "route"]
    source = routed.select(*dict.fromkeys([*keep, *columns, "known_text"]))
    schema = T.StructType([source.schema[c] for c in keep] + _RESULT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {SINGLE: _model("single", single), MULTI: _model("multi", multi)}
        context = TaskContext.get()
        worker = context.partitionId() if context else 0
        for batch in batches:
            names, known = batch["route"].to_numpy(), batch["known_text"].to_numpy()
            rows = [
                (text, 1.0, None, 0.0, None) if name == KNOWN else ("", 0.0, None, 0.0, None)
                for name, text in zip(names, known)
            ]
            for name, model in models.items():
                places = np.flatnonzero(names == name)
                if len(places):
                    done = _guarded(model, _items(batch.iloc[places], columns))
                    for place, result in zip(places, done):
                        rows[place] = (*result, worker)
            out = batch[keep].copy()
            for i, field in enumerate(_RESULT):
                kind = {"string": object, "double": "float64"}.get(field.dataType.typeName(), "Int32")
                out[field.name] = pd.Series([r[i] for r in rows], index=batch.index, dtype=kind)
            yield out

    return source.mapInPandas(run, schema)


def realign(
    inputs: DataFrame, results: DataFrame, keys: list[str], carry: list[str] = []
) -> DataFrame:
    """One row per input position: text, confidence and the results' columns ``carry``, blank where nothing was
    recognised."""
    joined = inputs.select(*keys).join(results.select(*keys, *carry, "text", "confidence"), keys, "left")
    return joined.select(
        *keys, *carry,
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def recognise_packs(
    packed: DataFrame, keys: list[str], column: str, factory: Callable,
    name: str = "packs",
) -> DataFrame:
    """One recogniser call per pack; its text is split over the lines of the pack.

    ``packed`` comes from ``pack_lines`` plus ``column``, what the recogniser sees of a line. The
    recogniser receives the list of line values of a pack, at most 20.
    """
    packs = packed.groupBy(*keys, "pack").agg(
        F.array_sort(F.collect_list(F.struct("line_no", column))).alias("_lines")
    ).withColumns({
        "values": F.transform("_lines", lambda s: s[column]),
        "line_nos": F.transform("_lines", lambda s: s["line_no"]),
    })
    read = recognise(packs, ["values"], factory, [*keys, "pack", "line_nos"], name=name)
    n = F.size("line_nos")
    texts = F.when(n == 1, F.array("text")).otherwise(split_lines(F.col("text"), n))
    return read.withColumn("_texts", texts).select(
        *keys, "pack", F.posexplode("line_nos").alias("_i", "line_no"), "_texts",
        "confidence", "error",
    ).select(
        *keys, "pack", "line_no", F.get("_texts", F.col("_i")).alias("text"), "confidence",
        "error",
    )


def group_by_source(results: DataFrame, part: int = 1_000) -> DataFrame:
    """Results of an image per source type as arrays of at most ``part`` entries.

    ``region_idx`` is dense per image, so the part number bounds each array.
    """
    return results.groupBy(
        "image_id", "source_type", F.floor(F.col("region_idx") / part).cast("long").alias("part")
    ).agg(
        F.array_sort(
            F.collect_list(F.struct("region_idx", "text", "confidence", *G.BOX))
        ).alias("results")
    )


def join_lines(lines: DataFrame, keys: list[str], part: int = 1_000) -> DataFrame:
    """Line texts joined by spaces, in parts of ``part`` lines (one part for ordinary images)."""
    return lines.groupBy(
        *keys, F.floor(F.col("line_no") / part).cast("long").alias("part")
    ).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]
            ), " ",
        ).alias("text")
    )


def attach_results(
    regions: DataFrame, results: DataFrame, keys: list[str] = ["image_id", "region_idx"],
) -> DataFrame:
    """Regions with their results, by the region key (never by text or class)."""
    return regions.join(results, keys, "left")


def standard_inputs(
    spark, arrays: DataFrame | None = None, paths: DataFrame | None = None,
    dicts: DataFrame | None = None, records: DataFrame | None = None,
) -> DataFrame:
    """Mixed inputs as (pos, source_id, image, metadata), invalid ones dropped.

    Each kind is a frame with ``pos`` and ``image`` (null when unreadable); paths carry ``path``,
    dicts may carry ``id`` and ``metadata``, records carry ``source_id``.
    """
    named = []
    if arrays is not None:
        named.append(arrays.withColumn("source_id", F.format_string("image_%d", "pos")))
    if paths is not None:
        named.append(paths.withColumn("source_id", stem(F.col("path"))).drop("path"))
    if dicts is not None:
        fallback = F.format_string("dict_%d", "pos")
        source = F.coalesce("id", fallback) if "id" in dicts.columns else fallback
        named.append(dicts.withColumn("source_id", source).drop("id"))
    if records is not None:
        named.append(records)
    merged = named[0]
    for other in named[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    if "metadata" not in merged.columns:
        merged = merged.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    readable = F.col("image").isNotNull() & (F.col("image.height") > 0)
    return merged.where(readable).select("pos", "source_id", "image", "metadata")


def timed(function: Callable, rounds: int = 1) -> Callable[[Iterator], Iterator]:
    """A ``mapInPandas`` body that times ``function`` on each value of column ``item``.

    Rows in: (engine, config, item_id, item). Rows out: one timing row per item and round.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                for turn in range(rounds):
                    start, ok = time.perf_counter(), True
                    try:
                        function(row.item)
                    except Exception:
                        ok = False
                    spent = (time.perf_counter() - start) * 1000
                    rows.append((row.engine, row.config, row.item_id, turn, spent, ok))
            yield pd.DataFrame(
                rows, columns=["engine", "config", "item_id", "round", "elapsed_ms", "ok"]
            )

    return run


def measured_calls(
    items: DataFrame, factory: Callable, rounds: int = 1, name: str = "measured"
) -> tuple[DataFrame, DataFrame, dict]:
    """(timings, counts, observed): calls ``factory()`` on every item for some rounds and tells what was called.

    ``items`` has (engine, config, item_id, item). The timings are written as a table, so every call is made once
    however often they are read; tasks that run again count once. ``counts`` has calls, items, rounds and failures per
    engine and config. ``observed`` has the calls and failures of all tasks, known at once without reading; it counts
    those of repeated tasks too.
    """
    spark = items.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return timed(_model(name, factory), rounds)(batches)

    seen = Observation()
    path = shared_path(spark, "timings")
    called = items.select("engine", "config", "item_id", "item").mapInPandas(run, TIMINGS)
    called.observe(
        seen, F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures")
    ).write.parquet(path)
    timings = spark.read.parquet(path)
    counts = timings.groupBy("engine", "config").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("round") == 0).alias("items"),
        (F.max("round") + 1).alias("rounds"), F.count_if(~F.col("ok")).alias("failures"),
    )
    return timings, counts, seen.get


TIMINGS = "engine string, config string, item_id long, round int, elapsed_ms double, ok boolean"
