"""Regions to text lines, and detector boxes to recognised text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.functions.geometry import BOX
from boxline.functions.sizing import line_method
from boxline.operators.hot import lookup_join
from boxline.operators.lines import (
    MERGE_GAP, MIN_LINE_HEIGHT, component_lines, merge_close, projection_runs,
)
from boxline.operators.ordered import ranked
from boxline.operators.packing import pack_lines
from boxline.operators.recognition import realign, recognise, recognise_packs

# Region classes whose text is extracted.
TEXT_CLASSES = ["chat_area", "input_area", "side_info"]


def reading_order(boxes: DataFrame, keys: list[str] = ["image_id"], **options) -> DataFrame:
    """Numbers boxes from top to bottom, then left to right, by their centers ``cy``, ``cx``."""
    return ranked(boxes, keys, ["cy", "cx", "det_id"], "reading_no", **options)


def hybrid_lines(
    images: DataFrame, profiles: DataFrame, components: DataFrame,
    contours: DataFrame | None = None, min_height: int = MIN_LINE_HEIGHT, gap: int = MERGE_GAP,
    **options,
) -> DataFrame:
    """Lines per image by the method its edge density calls for, close lines merged.

    ``images`` has image_id and edge_density. Contour boxes (image_id, start, end) are an input,
    as Spark does no pixel work here; without them dense images take components.
    """
    chosen = images.select("image_id", line_method(F.col("edge_density")).alias("method"))
    if contours is None:
        chosen = chosen.withColumn(
            "method", F.when(F.col("method") == "contour", "component").otherwise(F.col("method"))
        )

    def of(rows: DataFrame, method: str) -> DataFrame:
        wanted = chosen.where(F.col("method") == method).select("image_id")
        return lookup_join(rows, wanted, ["image_id"])

    found = projection_runs(of(profiles, "projection"), min_height).select(
        "image_id", "start", "end"
    ).unionByName(
        component_lines(of(components, "component"), min_height, **options).select(
            "image_id", F.col("y1").alias("start"), F.col("y2").alias("end")
        )
    )
    if contours is not None:
        found = found.unionByName(of(contours, "contour").select("image_id", "start", "end"))
    return merge_close(found, F.lit(gap), strict=True, **options)


def region_lines(
    regions: DataFrame, profiles: DataFrame, classes: list[str] = TEXT_CLASSES,
    min_height: int = MIN_LINE_HEIGHT,
) -> DataFrame:
    """Text lines of the regions of some classes, in image coordinates, keyed by detection."""
    wanted = regions.where(F.col("class").isin(classes))
    keys = ["image_id", "det_id"]
    # A region has no more profile rows than pixels in height.
    own = lookup_join(profiles, wanted.select(*keys), keys, detect=False)
    runs = projection_runs(own, min_height, keys=keys)
    return lookup_join(runs, wanted.select(*keys, "class", *BOX), keys, detect=False).select(
        *keys, "class",
        F.col("x1"), (F.col("y1") + F.col("start")).alias("y1"),
        F.col("x2"), (F.col("y1") + F.col("end")).alias("y2"),
    )


def read_lines(
    boxes: DataFrame, column: str, factory: Callable, min_confidence: float = 0.5,
    keys: list[str] = ["image_id"], **options,
) -> DataFrame:
    """Boxes in reading order, recognised, blank and doubtful lines dropped."""
    ordered = reading_order(boxes, keys, **options)
    read = recognise(ordered, [column], factory, [*keys, "det_id", "reading_no"], name="lines")
    return read.where((F.col("text") != "") & (F.col("confidence") >= min_confidence))


def read_packed_lines(
    lines: DataFrame, column: str, factory: Callable, keys: list[str] = ["image_id"],
    strategy: str = "adaptive",
) -> DataFrame:
    """Multi-line text with few recogniser calls: pack, recognise, split, realign. Each line names its pack."""
    packed = pack_lines(lines, keys, strategy)
    content = lines.select(*keys, "line_no", column)
    read = recognise_packs(
        packed.join(content, [*keys, "line_no"]), keys, column, factory, name="packs"
    )
    return realign(lines, read, [*keys, "line_no"], ["pack"])
