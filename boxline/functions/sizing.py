"""Sizes planned before inference: scales, tensor sides, height buckets, widths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def batch_scale(high: Column, target: int = 48) -> Column:
    """Scale of a crop in a batch row: small text grows freely, large text never grows."""
    ratio = F.lit(float(target)) / high
    return (
        F.when(high < 20, ratio)
        .when(high < 35, F.least(ratio, F.lit(1.5)))
        .otherwise(F.least(ratio, F.lit(1.0)))
    )


def recognition_size(
    wide: Column, high: Column, target: int = 48, max_width: int = 320, min_side: int = 16
) -> Column:
    """Struct (w, h) of the recognition tensor; an empty crop takes the full tensor."""
    scaled = (wide * (F.lit(float(target)) / high)).cast("int")
    empty = (wide <= 0) | (high <= 0)
    planned = F.greatest(F.lit(min_side), F.least(F.lit(max_width), scaled))
    return F.struct(
        F.when(empty, F.lit(max_width)).otherwise(planned).alias("w"),
        F.lit(max(min_side, target)).alias("h"),
    )


def detection_size(
    wide: Column, high: Column, max_side: int = 640, min_side: int = 320, fast: bool = True
) -> Column:
    """Struct (w, h) of the detector input, rounded up to multiples of 32."""
    long_side, short_side = F.greatest(wide, high), F.least(wide, high)
    shrink = F.lit(float(max_side)) / long_side
    ratio = F.when(long_side > max_side, shrink)
    if fast:
        ratio = (
            ratio.when(short_side < min_side, F.lit(float(min_side)) / short_side)
            .when(long_side > 480, F.lit(0.8))
        )
    ratio = ratio.otherwise(F.lit(1.0))

    def rounded(side: Column) -> Column:
        value = (F.ceil((side * ratio).cast("int") / 32) * 32).cast("int")
        return F.least(value, F.lit(640)) if fast else value

    return F.struct(rounded(wide).alias("w"), rounded(high).alias("h"))


def height_bucket(high: Column) -> Column:
    """small, medium or large; null from 100 pixels on."""
    return (
        F.when((high >= 0) & (high < 20), "small")
        .when((high >= 20) & (high < 35), "medium")
        .when((high >= 35) & (high < 100), "large")
    )


def estimated_chars(effective_width: Column, char_height: Column) -> Column:
    return F.greatest(F.lit(1), (effective_width / (char_height * 0.8)).cast("int"))


def is_blank_line(effective_width: Column, char_height: Column, density: Column) -> Column:
    return (effective_width < char_height) | (density < 0.01)


def is_text_component() -> Column:
    """Structure analysis rule for components (x, y, w, h, area)."""
    w, h = F.col("w"), F.col("h")
    return (F.col("area") > 20) & (h > 5) & (w > 3) & (h > w * 0.1) & (h < w * 10)


def is_line_component() -> Column:
    """Line splitter rule for components."""
    return (F.col("h") >= 8) & (F.col("w") >= 3) & (F.col("area") >= 20)


def effective_width(
    first: Column, last: Column, inked: Column, wide: Column, method: str = "adaptive"
) -> Column:
    """Text width of a line from its first, last and number of inked columns, padded by 20."""
    span = last - first + 1
    if method == "compact":
        used = inked
    elif method == "adaptive":
        loose = (span - inked) / span > 0.3
        used = F.when(loose, (inked * 1.2).cast("int")).otherwise(span)
    else:
        used = span
    return F.when(inked > 0, F.least(used + 20, wide)).otherwise(wide)


# Edge densities below which an image is simple, and from which it is dense.
SIMPLE_EDGES, DENSE_EDGES = 0.1, 0.3


def line_method(edge_density: Column) -> Column:
    """Line splitter for an image of this edge density."""
    return (
        F.when(edge_density < SIMPLE_EDGES, "projection")
        .when(edge_density < DENSE_EDGES, "component")
        .otherwise("contour")
    )
