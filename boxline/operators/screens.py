"""From pixels to text: line splitting, the text of regions, and detection with reading, each in one pass.

Detectors, readers and splitters are plug-ins that run inside tasks. A detector is given as ``factory() -> detect``,
where ``detect`` maps a list of pixel arrays to one list of boxes (x1, y1, x2, y2) per image, however many; a
reader as ``factory() -> read``, which maps a list of pixel arrays to (text, confidence) pairs. Factories run once
per Python worker and name. Pixels cross to Python once; what comes back are boxes and texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxline.functions.geometry import BOX
from boxline.functions.splitters import SPLITTERS, splitter
from boxline.operators.recognition import (
    CROP_BYTES, CROP_ROWS, _gray, _guarded, _model, _piece, _pixels, image_boxes,
)

# Gray below this is ink.
DARK = 128
MIN_LINE_HEIGHT, MIN_LINE_WIDTH = 15, 20
# Confidence below which a text is dropped.
MIN_CONFIDENCE = 0.5

_BOX = ", ".join(f"{c} int" for c in BOX)


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=schema.names).astype(object)
    for field in schema:
        if field.dataType.typeName() in ("integer", "long", "short"):
            out[field.name] = out[field.name].astype("Int64")
        elif field.dataType.typeName() == "double":
            out[field.name] = out[field.name].astype("float64")
    return out


def _schema(spark, text: str) -> T.StructType:
    return spark.createDataFrame([], text).schema


def split_regions(
    crops: DataFrame, method: str = "projection", splitters: dict[str, Callable] | None = None,
    min_height: int = MIN_LINE_HEIGHT, min_width: int = MIN_LINE_WIDTH, dark: int = DARK,
    keys: list[str] = ["image_id", "region_idx"],
) -> DataFrame:
    """(keys, method, line_no, x1, y1, x2, y2, confidence): text lines of cropped regions, in their coordinates.

    ``crops`` comes from ``crop_regions``. A column ``method`` names the splitter of each row, else ``method`` names
    that of all rows; rows of all methods are split in one pass. ``auto`` goes by a column ``edge_density`` (null:
    dense) and joins close lines. ``splitters`` adds splitters to the built-in ones or replaces them. An unknown
    name fails; a null method takes the argument, and a null crop has no lines.
    """
    known = SPLITTERS | (splitters or {})
    named = F.coalesce("method", F.lit(method)) if "method" in crops.columns else F.lit(method)
    density = F.col("edge_density").cast("double") if "edge_density" in crops.columns else F.lit(None).cast("double")
    source = crops.where(F.col("crop").isNotNull()).select(
        *keys, named.alias("rule"), density.alias("density"), F.col("crop").alias("data"),
        F.col("crop_height").alias("height"), F.col("crop_width").alias("width"),
        F.col("channels").alias("nChannels"),
    )
    out = "method string, line_no int, " + _BOX + ", confidence double"
    schema = T.StructType([source.schema[k] for k in keys] + list(_schema(crops.sparkSession, out)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                rule = splitter(row[len(keys)], row[len(keys) + 1], known)
                ink = _gray(_pixels(row)) < dark
                for i, line in enumerate(rule(ink, min_height, min_width), 1):
                    rows.append((*row[:len(keys)], row[len(keys)], i, *line))
            yield _frame(rows, schema)

    return source.mapInPandas(run, schema)


class _Reader:
    """Gathers pieces of pixels and reads them together, in calls of bounded size."""

    def __init__(self, read: Callable):
        self.read, self.pieces, self.rows, self.held = read, [], [], 0

    def add(self, piece: np.ndarray, row: tuple) -> bool:
        """Whether it is time to read."""
        self.pieces.append(piece)
        self.rows.append(row)
        self.held += piece.size
        return self.held > CROP_BYTES or len(self.rows) >= CROP_ROWS

    def done(self) -> list[tuple]:
        """(row, text, confidence, error) of all pieces added since the last call."""
        found = _guarded(self.read, self.pieces) if self.pieces else []
        out = [(row, text, conf, error) for row, (text, conf, error, _) in zip(self.rows, found)]
        self.pieces, self.rows, self.held = [], [], 0
        return out


def read_regions(
    images: DataFrame, regions: DataFrame, reader: Callable, classes: list[str] | None = None,
    method: str = "projection", splitters: dict[str, Callable] | None = None,
    min_height: int = MIN_LINE_HEIGHT, min_width: int = MIN_LINE_WIDTH, dark: int = DARK,
    carry: list[str] = ["det_id"], name: str = "regions",
) -> DataFrame:
    """Text of the lines of regions: crop, ink profile, smoothed runs, line crops, reading, in one pass.

    ``images`` has image_id and image; ``regions`` has image_id, a dense region_idx, class, a box and the columns
    ``carry``, and may have ``method`` and ``edge_density`` for the splitter (see ``split_regions``). One row per
    line: image_id, region_idx, carry, class, line_no (from 1), region_id (class and number), the line's box in
    image coordinates, ink (how sure the splitter is), text, confidence and error. Regions whose class isn't among
    ``classes``, that lie outside their image or have no line give no row; a reader's failure is told in
    ``error``. The result is keyed by the region, so equal classes of an image stay apart.
    """
    known = SPLITTERS | (splitters or {})
    wanted = regions if classes is None else regions.where(F.col("class").isin(classes))
    named = F.coalesce("method", F.lit(method)) if "method" in regions.columns else F.lit(method)
    density = F.col("edge_density").cast("double") if "edge_density" in regions.columns else F.lit(None).cast("double")
    wanted = wanted.withColumns({"_method": named, "_density": density})
    carried = [c for c in dict.fromkeys([*carry, "class"])]
    paired = image_boxes(images, wanted, carry=[*carried, "_method", "_density"])
    out = f"line_no int, region_id string, {_BOX}, ink double, text string, confidence double, error string"
    schema = T.StructType(
        [wanted.schema[c] for c in ["image_id", "region_idx", *carried]] + list(_schema(images.sparkSession, out))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reading = _Reader(_model(name, reader))

        def told() -> pd.DataFrame:
            return _frame([(*row, *rest) for row, *rest in reading.done()], schema)

        for batch in batches:
            for row in batch.itertuples(index=False):
                pixels = _pixels(row)
                for box in row.boxes:
                    piece = _piece(pixels, box)
                    if piece is None:
                        continue
                    rule = splitter(box["_method"], box["_density"], known)
                    left, top = max(0, box["x1"]), max(0, box["y1"])
                    for i, line in enumerate(rule(_gray(piece) < dark, min_height, min_width), 1):
                        x1, y1, x2, y2, sure = line
                        place = (left + x1, top + y1, left + x2, top + y2, sure)
                        label = f"{box['class']}_{i}"
                        key = (row.image_id, box["region_idx"], *(box[c] for c in carried), i, label)
                        if reading.add(piece[y1:y2, x1:x2], (*key, *place)):
                            yield told()
            yield told()

    return paired.mapInPandas(run, schema)


def read_images(
    images: DataFrame, detector: Callable | None, reader: Callable, min_confidence: float = MIN_CONFIDENCE,
    boxes: bool = False, confidences: bool = False, errors: bool = False, in_order: bool = True,
    name: str = "screens",
) -> DataFrame:
    """Detects, orders and reads all text of images in one pass: image_id, line_no, text, and what the flags add.

    ``images`` has image_id and image. Boxes are numbered from 1, from top to bottom and left to right by their
    centers (``in_order``), or as the detector gives them; equal centers keep the detector's order. Without a
    detector the image is one line. Blank texts and texts below ``min_confidence`` are dropped, whatever the flags;
    a reader that knows no confidence gives None, and such texts stay. ``boxes`` adds x1, y1, x2, y2, ``confidences``
    adds confidence (null when unknown). ``errors`` adds error, and rows for readings and images (line_no null)
    that failed, which are dropped otherwise. Unreadable images and boxes outside their image give no row.
    """
    source = images.select("image_id", "image.height", "image.width", "image.nChannels", "image.data")
    out = f"line_no int, text string, confidence double, {_BOX}, error string"
    schema = T.StructType([source.schema["image_id"], *_schema(images.sparkSession, out)])

    def located(batch: pd.DataFrame, detect: Callable | None) -> Iterator[tuple]:
        """(image_id, pixels, boxes, error) of each readable image."""
        ids, shown = [], []
        for row in batch.itertuples(index=False):
            pixels = _pixels(row)
            if pixels is not None:
                ids.append(row.image_id)
                shown.append(pixels)
        if detect is None:
            for key, pixels in zip(ids, shown):
                yield key, pixels, [(0, 0, pixels.shape[1], pixels.shape[0])], None
            return
        # A detector's answer has no confidence of its own here; a failing batch is tried image by image.
        found = _guarded(lambda items: [(b, None) for b in detect(items)], shown) if shown else []
        for key, pixels, (own, _, error, _) in zip(ids, shown, found):
            yield key, pixels, [] if own is None else [tuple(int(v) for v in b[:4]) for b in own], error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = None if detector is None else _model(f"{name}-detector", detector)
        reading = _Reader(_model(f"{name}-reader", reader))

        def told(failed: list[tuple] = []) -> pd.DataFrame:
            rows = list(failed)
            for (key, number, box), text, confidence, error in reading.done():
                if error is not None:
                    if errors:
                        rows.append((key, number, None, None, *box, error))
                elif text and (confidence is None or confidence >= min_confidence):
                    rows.append((key, number, text, confidence, *box, None))
            return _frame(rows, schema)

        for batch in batches:
            failed = []
            for key, pixels, own, error in located(batch, detect):
                if error is not None and errors:
                    failed.append((key, None, None, None, *[None] * 4, error))
                if in_order:
                    own = sorted(own, key=lambda b: (b[1] + b[3], b[0] + b[2]))
                for number, box in enumerate(own, 1):
                    piece = _piece(pixels, dict(zip(BOX, box)))
                    if piece is not None and reading.add(piece, (key, number, box)):
                        yield told()
            yield told(failed)

    shape = [*(["confidence"] if confidences else []), *(BOX if boxes else []), *(["error"] if errors else [])]
    return source.mapInPandas(run, schema).select("image_id", "line_no", "text", *shape)
