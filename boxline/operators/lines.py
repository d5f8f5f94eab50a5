"""Text lines from ink profiles and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxline.functions.geometry import shifted
from boxline.functions.sizing import (
    effective_width, estimated_chars, is_blank_line, is_text_component,
)
from boxline.operators.hot import HOT_ROWS, lookup_join
from boxline.operators.ordered import OrderedGroups, ranked, slice_rows, with_group_totals

SLICE = 100_000
# Line rules of the projection splitter and of the multi-line engine.
PROJECTION_SHARE, ADAPTIVE_SHARE = 0.3, 0.1
MIN_LINE_HEIGHT = 15
MERGE_GAP = 5


def kernel_size(min_height: int = MIN_LINE_HEIGHT) -> int:
    """Odd width of the moving average."""
    size = max(3, min_height // 3)
    return size + 1 - size % 2


def smooth_profile(
    profiles: DataFrame, kernel: int, keys: list[str] = ["image_id"], size: int = SLICE
) -> DataFrame:
    """Moving average of ``ink`` along the dense position ``y``, zeros beyond both ends.

    The result keeps ``_slice`` for the steps that follow; drop it for output.
    """
    half = kernel // 2
    window = Window.partitionBy(*keys, "_slice").orderBy("y").rowsBetween(-half, half)
    return (
        slice_rows(profiles, "y", size, before=half, after=half)
        .withColumn("smoothed", F.sum("ink").over(window) / kernel)
        .where("_own")
        .drop("_own")
    )


def _runs(
    rows: DataFrame, keys: list[str], level: str, min_height: Column | int, size: int,
    extra: list[str],
) -> DataFrame:
    """Runs of consecutive positions with ``_above``, cut at slices and joined again."""
    inside = Window.partitionBy(*keys, "_slice").orderBy("y")
    starts = F.col("_above") & ~F.coalesce(F.lag("_above").over(inside), F.lit(False))
    local = (
        rows.withColumn("_starts", starts.cast("int"))
        .withColumn("_run", F.sum("_starts").over(inside))
        .where("_above")
        .groupBy(*keys, "_slice", "_run")
        .agg(
            F.min("y").alias("start"), (F.max("y") + 1).alias("end"),
            F.sum(level).alias("_ink"), *[F.first(c).alias(c) for c in extra],
        )
    )
    # Only runs that touch a cut can continue in the next slice; there are two per slice at most.
    at_cut = ((F.col("start") % size == 0) & (F.col("start") > 0)) | (F.col("end") % size == 0)
    local = local.withColumn("_place", F.when(at_cut, F.lit(-1)).otherwise(F.col("_slice")))
    across = Window.partitionBy(*keys, "_place").orderBy("start")
    joined = F.col("start") == F.lag("end").over(across)
    whole = (
        local.withColumn("_break", F.when(F.col("_place") >= 0, 1).when(joined, 0).otherwise(1))
        .withColumn("_island", F.sum("_break").over(across))
        .groupBy(*keys, "_place", "_island")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.sum("_ink").alias("_ink"), *[F.first(c).alias(c) for c in extra],
        )
    )
    height = F.col("end") - F.col("start")
    least = min_height if isinstance(min_height, Column) else F.lit(min_height)
    return whole.where(height >= least).select(
        *keys, "start", "end", (F.col("_ink") / height).alias("mean_ink"), *extra
    )


def projection_runs(
    profiles: DataFrame, min_height: int = MIN_LINE_HEIGHT, kernel: int | None = None,
    keys: list[str] = ["image_id"], size: int = SLICE,
) -> DataFrame:
    """Text lines of a profile: runs above 0.3 of the mean smoothed ink, of minimum height."""
    smoothed = smooth_profile(profiles, kernel or kernel_size(min_height), keys, size)
    rows = with_group_totals(smoothed, keys, {"_mean": F.avg("smoothed")})
    rows = rows.withColumn("_above", F.col("smoothed") > F.col("_mean") * PROJECTION_SHARE)
    return _runs(rows, keys, "smoothed", min_height, size, [])


def adaptive_runs(
    profiles: DataFrame, char_height: str = "char_height", keys: list[str] = ["image_id"],
    size: int = SLICE,
) -> DataFrame:
    """Text lines of the multi-line engine: runs above a tenth of the mean positive ink.

    ``char_height`` names a profile column; it sets the minimum height.
    """
    sliced = slice_rows(profiles, "y", size).drop("_own")
    positive = F.avg(F.when(F.col("ink") > 0, F.col("ink")))
    rows = with_group_totals(sliced, keys, {"_mean": positive})
    level = F.greatest(F.lit(1), (F.col("_mean") * ADAPTIVE_SHARE).cast("int"))
    rows = rows.withColumn("_above", F.coalesce(F.col("ink") > level, F.lit(False)))
    least = F.greatest(F.lit(8), (F.col(char_height) * 0.6).cast("int"))
    return _runs(rows, keys, "ink", least, size, [char_height])


def describe_lines(runs: DataFrame, wide: Column) -> DataFrame:
    """Adds center, height, confidence and ink ratio to runs found in row profiles.

    The confidence is the mean ink count capped at 1, so it is nearly always 1; the ink ratio
    tells full lines from sparse ones.
    """
    return runs.withColumns({
        "center_y": F.floor((F.col("start") + F.col("end")) / 2).cast("int"),
        "height": F.col("end") - F.col("start"),
        "confidence": F.least(F.lit(1.0), F.col("mean_ink")),
        "ink_ratio": F.col("mean_ink") / wide,
    })


def line_infos(runs: DataFrame, wide: Column, high: Column) -> DataFrame:
    """Padded line boxes of the multi-line engine with their character estimate.

    ``runs`` carries char_height, effective_width and mean_ink. Lines narrower than a character
    or with less than 1% ink are dropped as blank.
    """
    pad = F.greatest(F.lit(2), F.floor(F.col("char_height") / 8).cast("int"))
    density = F.col("mean_ink") / wide
    blank = is_blank_line(F.col("effective_width"), F.col("char_height"), density)
    return runs.where(~blank).withColumns({
        "y1": F.greatest(F.lit(0), F.col("start") - pad),
        "y2": F.least(high, F.col("end") + pad),
        "estimated_chars": estimated_chars(F.col("effective_width"), F.col("char_height")),
        "confidence": F.least(F.lit(1.0), density),
    })


def number_lines(
    lines: DataFrame, keys: list[str], order: list[str], limit: int = HOT_ROWS
) -> DataFrame:
    """Adds ``line_no`` (0-based per key) and ``region_id``, the class with the number from 1.

    The key must name the detection: the same ``region_id`` occurs once per detection of a class.
    """
    numbered = ranked(lines, keys, order, "_place", limit=limit)
    return numbered.withColumn("line_no", (F.col("_place") - 1).cast("long")).withColumn(
        "region_id", F.concat_ws("_", "class", "_place")
    ).drop("_place")


def merge_close(
    ranges: DataFrame, gap: Column, keys: list[str] = ["image_id"], strict: bool = False,
    limit: int = HOT_ROWS, hot: DataFrame | None = None,
) -> DataFrame:
    """Joins ranges (``start``, ``end``) whose distance to the range before is within ``gap``
    (below it when ``strict``). A merged range ends where its last member ends."""
    order = ["start", "end"]
    groups = OrderedGroups(ranges, keys, order, limit=limit, hot=hot).previous(
        {"_before": F.col("end")}
    )
    distance = F.col("start") - F.col("_before")
    near = distance < gap if strict else distance <= gap
    groups = groups.with_columns({"_break": F.when(near, 0).otherwise(1)})
    rows = groups.running_sum(F.col("_break"), "_island").frame()
    return rows.groupBy(*keys, "_island").agg(
        F.min("start").alias("start"),
        F.max_by("end", F.struct(*order)).alias("end"),
        F.count(F.lit(1)).alias("n_merged"),
    ).drop("_island")


def component_lines(
    components: DataFrame, min_height: int = MIN_LINE_HEIGHT, limit: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Lines of components (x, y, w, h, area, cy): a component joins the line of the one before
    when their centers differ by at most half the larger height."""
    keys = ["image_id"]
    groups = OrderedGroups(components, keys, ["cy", "comp_id"], limit=limit, hot=hot)
    groups = groups.previous({"_cy": F.col("cy"), "_h": F.col("h")})
    near = F.abs(F.col("cy") - F.col("_cy")) <= F.greatest("h", "_h") * 0.5
    groups = groups.with_columns({"_break": F.when(near, 0).otherwise(1)})
    rows = groups.running_sum(F.col("_break"), "_line").frame()
    lines = rows.groupBy(*keys, "_line").agg(
        F.min("x").alias("x1"),
        F.min("y").alias("y1"),
        F.max(F.col("x") + F.col("w")).alias("x2"),
        F.max(F.col("y") + F.col("h")).alias("y2"),
        F.count(F.lit(1)).alias("n_components"),
        F.sum("area").alias("_area"),
    )
    high = F.col("y2") - F.col("y1")
    space = (F.col("x2") - F.col("x1")) * high
    share = F.try_divide(F.col("_area"), space) * (F.col("n_components") / 10)
    return lines.where(high >= min_height).select(
        *keys, "x1", "y1", "x2", "y2", "n_components",
        F.floor((F.col("y1") + F.col("y2")) / 2).cast("int").alias("center_y"),
        high.alias("height"),
        F.least(F.lit(1.0), share).alias("confidence"),
    )


def _ranked_height(rank: Column) -> Column:
    """The height at a 0-based rank of the sorted (h, n) array."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("h"))
    return F.aggregate(
        "_heights", start,
        lambda s, x: F.struct(
            (s["seen"] + x["n"]).alias("seen"),
            F.when(s["h"].isNull() & (s["seen"] + x["n"] > rank), x["h"]).otherwise(s["h"]).alias("h"),
        ),
        lambda s: s["h"],
    )


def _summed(value) -> Column:
    """Sum of ``value(h) * n`` over the (h, n) array, in whole numbers."""
    return F.aggregate(
        "_heights", F.lit(0).cast("long"), lambda a, x: a + value(x["h"].cast("long")) * x["n"]
    )


def _whole_deviation(scatter: Column, n: Column) -> Column:
    """Whole part of sqrt(scatter) / n: the estimate in doubles may miss it by one."""
    near = F.floor(F.sqrt(scatter.cast("double")) / n)

    def reached(k: Column) -> Column:
        wide = k.cast("decimal(19,0)") * n
        return wide * wide <= scatter

    return F.when(reached(near + 1), near + 1).when(reached(near), near).otherwise(near - 1)


def text_structure(components: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Character height, line height, spacing and a ten-bin height histogram per image.

    Images without a usable component get the defaults 20, 30 and 10. Heights are pixel counts of
    one image, so once counted they are a short array per image, whatever its components. The
    deviation is cut to its whole part exactly: rounding never takes 7 for a little less than 7.
    """
    def whole(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")

    keys = ["image_id"]
    heights = components.where(is_text_component()).groupBy(*keys, "h").agg(
        F.count(F.lit(1)).alias("n")
    )
    shapes = heights.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("h", "n"))).alias("_heights"),
        F.sum("n").alias("num_chars"),
        F.min("h").alias("_low"),
        F.max("h").alias("_high"),
    )
    middle = (F.col("num_chars") - 1) / 2
    shapes = shapes.withColumns({
        "_char": (
            (_ranked_height(F.floor(middle)) + _ranked_height(F.ceil(middle))) / 2
        ).cast("int"),
        # Heights above the lowest one scatter as much, in smaller numbers.
        "_above": _summed(lambda h: h - F.col("_low")),
        "_squares": _summed(lambda h: (h - F.col("_low")) * (h - F.col("_low"))),
    })
    scatter = whole("num_chars") * whole("_squares") - whole("_above") * whole("_above")
    shapes = shapes.withColumn("_scatter", scatter).withColumn(
        "_std", _whole_deviation(F.col("_scatter"), F.col("num_chars"))
    )
    even = F.col("_low") == F.col("_high")
    low = F.when(even, F.col("_low") - 0.5).otherwise(F.col("_low"))
    step = F.when(even, F.lit(0.1)).otherwise((F.col("_high") - F.col("_low")) / 10)
    bins = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda i: F.aggregate(
            "_heights", F.lit(0).cast("long"),
            lambda a, x: a + F.when(
                F.least(F.lit(9), F.floor((x["h"] - low) / step).cast("int")) == i, x["n"]
            ).otherwise(0),
        ),
    )
    shapes = shapes.withColumn("height_distribution", bins)
    if images is not None:
        shapes = images.select(*keys).join(shapes, keys, "left")
    char = F.col("_char")
    return shapes.select(
        *keys,
        F.coalesce(char, F.lit(20)).alias("char_height"),
        F.col("_std").cast("int").alias("char_height_std"),
        F.coalesce((char * 1.2).cast("int"), F.lit(30)).alias("line_height"),
        F.when(char.isNull(), 10).otherwise(
            F.greatest(F.lit(5), (char * 0.3).cast("int"))
        ).alias("line_spacing"),
        F.coalesce(F.col("num_chars"), F.lit(0)).alias("num_chars"),
        "height_distribution",
    )


def profile_widths(
    profiles: DataFrame, keys: list[str], wide: Column, position: str = "x"
) -> DataFrame:
    """Span, compact and adaptive text width of each profile of column ink."""
    inked = F.when(F.col("ink") > 0, F.col(position))
    grouped = profiles.groupBy(*keys).agg(
        F.min(inked).alias("_first"), F.max(inked).alias("_last"), F.count(inked).alias("_inked"),
        F.first(wide).alias("_wide"),
    )
    ends = [F.col("_first"), F.col("_last"), F.col("_inked"), F.col("_wide")]
    return grouped.select(
        *keys,
        *[effective_width(*ends, method).alias(f"{method}_width")
          for method in ("span", "compact", "adaptive")],
    )


def to_image_boxes(lines: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Region-relative line boxes moved by their region's corner."""
    origin = regions.select(*keys, F.col("x1").alias("_dx"), F.col("y1").alias("_dy"))
    placed = lookup_join(lines, origin, keys)
    return placed.withColumns(shifted(F.col("_dx"), F.col("_dy"))).drop("_dx", "_dy")
