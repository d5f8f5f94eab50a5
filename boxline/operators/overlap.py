"""Box overlap: query-box matches, close pairs, non-maximum suppression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.functions import geometry as G
from boxline.operators.hot import (
    BROADCAST_ROWS, HOT_ROWS, hot_keys, lookup_join, null_safe_join, split_hot,
)
from boxline.operators.ordered import first_rows
from boxline.session import Rounds

MATCH_IOU = 0.8
NMS_IOU, NMS_KEEP = 0.45, 300
# Two sides of up to this many distinct boxes per key are compared directly.
PAIR_ROWS = 1_000
# Boxes suppressed in one array per key; larger groups go in rounds of this many.
NMS_ROWS = 1_000


def overlap_match(
    boxes: DataFrame, queries: DataFrame, keys: list[str], min_iou: float = MATCH_IOU,
    limit: int = HOT_ROWS, hot: DataFrame | None = None,
) -> DataFrame:
    """Boxes whose IoU with the query box of their key exceeds ``min_iou``.

    ``queries`` has one box (q_x1, q_y1, q_x2, q_y2) per key.
    """
    joined = lookup_join(boxes, queries, keys, limit=limit, hot=hot)
    return joined.withColumn("iou", G.iou()).where(F.col("iou") > min_iou)


def _level(side: Column) -> Column:
    return F.floor(F.log2(side.cast("double"))).cast("int")


def _place(value: Column, level: Column) -> Column:
    """Grid cell of a coordinate at a size level; a cell is twice the level's smallest side."""
    return F.floor(value / F.pow(F.lit(2.0), level + 1)).cast("long")


def _blocked(left: DataFrame, right: DataFrame, keys: list[str], min_iou: float) -> DataFrame:
    """Pairs with IoU at or above ``min_iou`` of crowded keys, found through grid cells.

    Such boxes differ in width and height by at most 1 / min_iou, and their near corners by less
    than one cell, so the left box needs one cell and the right box its neighbours.
    """
    reach = math.ceil(math.log2(1 / min_iou))
    near = [F.lit(d) for d in (-1, 0, 1)]
    levels = [F.lit(d) for d in range(-reach, reach + 1)]

    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    left = left.where((w > 0) & (h > 0)).withColumns({"_lw": _level(w), "_lh": _level(h)})
    left = left.withColumns({
        "_cx": _place(F.col("x1"), F.col("_lw")), "_cy": _place(F.col("y1"), F.col("_lh")),
    })
    qw, qh = F.col("q_x2") - F.col("q_x1"), F.col("q_y2") - F.col("q_y1")
    cells = ["_lw", "_lh", "_cx", "_cy"]
    right = (
        right.where((qw > 0) & (qh > 0))
        .withColumn("_dw", F.explode(F.array(*levels)))
        .withColumn("_dh", F.explode(F.array(*levels)))
        .withColumns({"_lw": _level(qw) + F.col("_dw"), "_lh": _level(qh) + F.col("_dh")})
        .withColumn("_cx", F.explode(F.array(*[_place(F.col("q_x1"), F.col("_lw")) + d for d in near])))
        .withColumn("_cy", F.explode(F.array(*[_place(F.col("q_y1"), F.col("_lh")) + d for d in near])))
        .drop("_dw", "_dh")
    )
    joined = left.join(right, [*keys, *cells]).withColumn("iou", G.iou())
    return joined.where(F.col("iou") >= min_iou).drop(*cells)


def close_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], min_iou: float,
    limit: int = PAIR_ROWS,
) -> DataFrame:
    """Pairs of a left and a right box of the same key with IoU at or above ``min_iou``.

    Give distinct boxes on both sides. Keys with many boxes are joined through grid cells, so
    that only boxes near each other meet.
    """
    crowded = hot_keys(
        left.select(*keys).unionByName(right.select(*keys)), keys, limit
    )
    if crowded is None:
        joined = left.join(right, keys).withColumn("iou", G.iou())
        return joined.where(F.col("iou") >= min_iou)
    light_left, heavy_left = split_hot(left, crowded, keys)
    light_right, heavy_right = split_hot(right, crowded, keys)
    light = light_left.join(light_right, keys).withColumn("iou", G.iou())
    return light.where(F.col("iou") >= min_iou).unionByName(
        _blocked(heavy_left, heavy_right, keys, min_iou)
    )


def _overlaps(a: Column, b: Column) -> Column:
    return G.iou_of(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"], b["x2"], b["y2"])


_PAYLOAD = ["det_id", *G.BOX, "confidence"]


def _suppress(boxes: DataFrame, keys: list[str], min_iou: float, keep: int) -> DataFrame:
    """Greedy suppression of groups of bounded size: (keys, _kept array in confidence order)."""
    ranked = F.struct((-F.col("confidence")).alias("neg"), *_PAYLOAD)
    grouped = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(ranked)).alias("_all"))
    empty = F.filter("_all", lambda b: F.lit(False))

    def step(kept: Column, box: Column) -> Column:
        hidden = F.exists(kept, lambda k: _overlaps(k, box) > min_iou)
        return F.when(hidden | (F.size(kept) >= keep), kept).otherwise(
            F.concat(kept, F.array(box))
        )

    return grouped.select(*keys, F.aggregate("_all", empty, step).alias("_kept"))


def _opened(kept: DataFrame, keys: list[str]) -> DataFrame:
    return kept.select(*keys, F.explode("_kept").alias("b")).select(
        *keys, *[F.col(f"b.{c}").alias(c) for c in _PAYLOAD]
    )


def nms(
    detections: DataFrame, keys: list[str] = ["image_id", "class"], min_iou: float = NMS_IOU,
    keep: int = NMS_KEEP, limit: int = NMS_ROWS,
) -> DataFrame:
    """Greedy non-maximum suppression per key, at most ``keep`` boxes each.

    Give only ``image_id`` as key for class-agnostic suppression. Groups above ``limit`` boxes go
    in rounds: the best boxes of each group are suppressed, what they hide is dropped, and the
    next best follow until ``keep`` boxes stand or none is left.
    """
    rows = detections.select(*keys, *_PAYLOAD)
    crowded = hot_keys(rows, keys, limit)
    if crowded is None:
        return _opened(_suppress(rows, keys, min_iou, keep), keys)
    light, remaining = split_hot(rows, crowded, keys)
    result = _opened(_suppress(light, keys, min_iou, keep), keys)
    spark = detections.sparkSession
    left, stood = Rounds(spark, "nms-left"), Rounds(spark, "nms-kept")
    remaining, standing = left.write(remaining), None
    rank = [F.col("confidence").desc(), F.col("det_id")]
    while not remaining.isEmpty():
        head = first_rows(remaining, keys, rank, limit).drop("rank")
        kept = _suppress(head, keys, min_iou, keep)
        last = head.groupBy(*keys).agg(
            F.max(F.struct((-F.col("confidence")).alias("neg"), "det_id")).alias("_last")
        )
        kept = null_safe_join(kept, last, keys, "inner")
        if standing is not None:
            before = standing.select(*keys, F.col("_kept").alias("_old"))
            kept = null_safe_join(kept, before, keys, "left").withColumn(
                "_kept",
                F.slice(F.concat(F.coalesce("_old", F.slice("_kept", 1, 0)), "_kept"), 1, keep),
            ).drop("_old")
            done = null_safe_join(standing, kept.select(*keys), keys, "left_anti")
            kept = kept.unionByName(done.select(*kept.columns))
        standing = stood.write(kept)
        # One row of at most ``keep`` boxes per crowded key.
        state = F.broadcast(standing) if standing.count() * keep <= BROADCAST_ROWS else standing
        behind = F.struct((-F.col("confidence")).alias("neg"), "det_id") > F.col("_last")
        box = F.struct(*G.BOX)
        hidden = F.exists("_kept", lambda k: _overlaps(k, box) > min_iou)
        remaining = left.write(
            null_safe_join(remaining, state, keys, "inner")
            .where((F.size("_kept") < keep) & behind & ~hidden)
            .select(*rows.columns)
        )
    if standing is None:
        return result
    return result.unionByName(_opened(standing, keys))


def top_detections(detections: DataFrame, keep: int = NMS_KEEP) -> DataFrame:
    """The ``keep`` most confident detections of each image."""
    order = [F.col("confidence").desc(), F.col("det_id")]
    return first_rows(detections, ["image_id"], order, keep)
