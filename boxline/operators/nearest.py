"""Best and nearest elements per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.functions import geometry as G
from boxline.operators.hot import HOT_ROWS, lookup_join

AVATAR_REACH = 200


def by_confidence() -> Column:
    """Sort value that is largest for the best detection; lower ids win ties."""
    return F.struct(F.col("confidence"), -F.col("det_id"))


def best_per_image(detections: DataFrame, class_name: str, alias: str) -> DataFrame:
    """The most confident detection of a class per image, as a struct column."""
    payload = F.struct("det_id", *G.BOX, "confidence")
    return (
        detections.where(F.col("class") == class_name)
        .groupBy("image_id")
        .agg(F.max_by(payload, by_confidence()).alias(alias))
    )


def nearest_avatar(
    detections: DataFrame, reach: int = AVATAR_REACH, limit: int = HOT_ROWS,
    hot: DataFrame | None = None, detect: bool = True,
) -> DataFrame:
    """The avatar nearest to the best name of each image, if closer than ``reach`` pixels."""
    names = best_per_image(detections, "receiver_name", "name")
    avatars = detections.where(F.col("class") == "receiver_avatar").select(
        "image_id", "det_id", *G.BOX, "confidence",
        G.center_x().alias("cx"), G.center_y().alias("cy"),
    )
    name_cx = (F.col("name.x1") + F.col("name.x2")) / 2
    name_cy = (F.col("name.y1") + F.col("name.y2")) / 2
    squared = (name_cx - F.col("cx")) ** 2 + (name_cy - F.col("cy")) ** 2
    return (
        lookup_join(avatars, names, ["image_id"], limit=limit, hot=hot, detect=detect)
        .withColumn("d2", squared)
        .groupBy("image_id")
        .agg(
            F.first("name").alias("name"),
            F.min_by(
                F.struct("det_id", *G.BOX, F.sqrt("d2").alias("distance")),
                F.struct("d2", -F.col("confidence"), "det_id"),
            ).alias("avatar"),
        )
        .where(F.col("avatar.distance") < reach)
    )
