"""Model responses to boxes to YOLO label lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.functions import geometry as G
from boxline.functions.annotations import flat_objects, json_objects, label_line
from boxline.schemas import class_number

# Fixed value: boxes at or below this share of the image in width or height are dropped.
MIN_SHARE = 0.01


def parse_responses(responses: DataFrame) -> DataFrame:
    """Adds ``objects`` (array of class, bbox) and ``outcome``: json, pattern or unparsed."""
    parsed = responses.withColumn("_json", json_objects(F.col("response")))
    parsed = parsed.withColumn(
        "objects", F.coalesce("_json", flat_objects(F.col("response")))
    )
    outcome = (
        F.when(F.col("_json").isNotNull(), "json")
        .when(F.size("objects") > 0, "pattern")
        .otherwise("unparsed")
    )
    return parsed.withColumn("outcome", outcome).drop("_json")


def response_boxes(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per parsed object with a four-number box; other objects are skipped."""
    # The outer form keeps Spark from parsing once more to test for empty arrays.
    rows = parsed.select(
        *keys, "width", "height", F.posexplode_outer("objects").alias("seq", "o")
    ).where(F.size("o.bbox") == 4)
    return rows.select(
        *keys, "seq", "width", "height", F.col("o.class").alias("class"),
        *[F.get("o.bbox", F.lit(i)).alias(n) for i, n in enumerate(G.BOX)],
    )


def encode_yolo(boxes: DataFrame, wide: Column, high: Column) -> DataFrame:
    """Boxes of known classes as normalised label lines; tiny boxes are dropped."""
    known = boxes.withColumn("class_id", class_number(F.col("class"))).where(
        F.col("class_id").isNotNull()
    )
    scaled = known.withColumns(G.clamp_ordered(wide, high)).withColumns(G.yolo_box(wide, high))
    kept = scaled.where((F.col("w") > MIN_SHARE) & (F.col("h") > MIN_SHARE))
    return kept.withColumn("line", label_line(*[F.col(c) for c in ("class_id", "cx", "cy", "w", "h")]))


def label_dataset(responses: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(label lines, counts by outcome) of a response table."""
    parsed = parse_responses(responses)
    lines = encode_yolo(response_boxes(parsed, keys), F.col("width"), F.col("height"))
    counts = parsed.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("responses"), F.sum(F.size("objects")).alias("objects")
    )
    return lines, counts
