"""Box geometry on the pixel columns x1, y1, x2, y2 (origin top-left)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ["x1", "y1", "x2", "y2"]


def corners(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + name) for name in BOX)


def width(prefix: str = "") -> Column:
    x1, _, x2, _ = corners(prefix)
    return x2 - x1


def height(prefix: str = "") -> Column:
    _, y1, _, y2 = corners(prefix)
    return y2 - y1


def area(prefix: str = "") -> Column:
    return width(prefix).cast("long") * height(prefix)


def center_x(prefix: str = "") -> Column:
    x1, _, x2, _ = corners(prefix)
    return (x1 + x2) / 2


def center_y(prefix: str = "") -> Column:
    _, y1, _, y2 = corners(prefix)
    return (y1 + y2) / 2


def whole_center_x(prefix: str = "") -> Column:
    """Floored integer center."""
    return F.floor(center_x(prefix)).cast("int")


def whole_center_y(prefix: str = "") -> Column:
    return F.floor(center_y(prefix)).cast("int")


def _within(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def clamp_ordered(wide: Column, high: Column) -> dict[str, Column]:
    """Label-file clamp: the far corner never falls left of or above the near corner."""
    x1, y1, x2, y2 = corners()
    zero = F.lit(0)
    left, top = _within(x1, zero, wide), _within(y1, zero, high)
    return {
        "x1": left,
        "y1": top,
        "x2": _within(x2, left, wide),
        "y2": _within(y2, top, high),
    }


def clamp_plain(wide: Column, high: Column) -> dict[str, Column]:
    """Crop clamp: each corner to the image; the caller drops boxes left empty."""
    x1, y1, x2, y2 = corners()
    zero = F.lit(0)
    return {
        "x1": _within(x1, zero, wide),
        "y1": _within(y1, zero, high),
        "x2": _within(x2, zero, wide),
        "y2": _within(y2, zero, high),
    }


def clamp_pixels(wide: Column, high: Column) -> dict[str, Column]:
    """Clamp to the last pixel column and row."""
    return clamp_plain(wide - 1, high - 1)


def ordered_corners(xa: Column, ya: Column, xb: Column, yb: Column) -> dict[str, Column]:
    """Box of two opposite drag points."""
    return {
        "x1": F.least(xa, xb),
        "y1": F.least(ya, yb),
        "x2": F.greatest(xa, xb),
        "y2": F.greatest(ya, yb),
    }


def padded_quad(quad: Column, wide: Column, high: Column, padding: int = 2) -> dict[str, Column]:
    """Axis box around a four-point quad (array of [x, y]), padded and kept inside the image."""
    xs = F.transform(quad, lambda p: p[0])
    ys = F.transform(quad, lambda p: p[1])
    pad = F.lit(padding)
    return {
        "x1": F.greatest(F.lit(0), F.array_min(xs).cast("int") - pad),
        "y1": F.greatest(F.lit(0), F.array_min(ys).cast("int") - pad),
        "x2": F.least(wide, F.array_max(xs).cast("int") + pad),
        "y2": F.least(high, F.array_max(ys).cast("int") + pad),
    }


def is_valid_region() -> Column:
    x1, y1, x2, y2 = corners()
    return (x2 > x1) & (y2 > y1) & (x1 >= 0) & (y1 >= 0)


def is_valid_image(wide: Column, high: Column, low: int = 8, top: int = 4096) -> Column:
    return F.coalesce(wide.between(low, top) & high.between(low, top), F.lit(False))


def iou(left: str = "", right: str = "q_") -> Column:
    """Intersection over union of two boxes; 0 when they are disjoint or empty."""
    ax1, ay1, ax2, ay2 = corners(left)
    bx1, by1, bx2, by2 = corners(right)
    return iou_of(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2)


def iou_of(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    wide = F.least(ax2, bx2) - F.greatest(ax1, bx1)
    high = F.least(ay2, by2) - F.greatest(ay1, by1)
    shared = (wide * high).cast("double")
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - shared
    return F.when((wide < 0) | (high < 0) | (union <= 0), F.lit(0.0)).otherwise(shared / union)


def shifted(dx: Column, dy: Column, prefix: str = "") -> dict[str, Column]:
    """Region-relative box moved to image coordinates."""
    x1, y1, x2, y2 = corners(prefix)
    return {"x1": x1 + dx, "y1": y1 + dy, "x2": x2 + dx, "y2": y2 + dy}


def size_issue(wide: Column, high: Column, prefix: str = "") -> Column:
    """Size class of a drawn box: invalid, too_small or too_large, in this order."""
    w, h = width(prefix), height(prefix)
    return (
        F.when((w <= 0) | (h <= 0), "invalid_size")
        .when((w < 10) | (h < 10), "too_small")
        .when((w > wide * 0.8) | (h > high * 0.8), "too_large")
    )


def bounds_issue(wide: Column, high: Column, prefix: str = "") -> Column:
    x1, y1, x2, y2 = corners(prefix)
    return F.when((x1 < 0) | (y1 < 0) | (x2 > wide) | (y2 > high), "out_of_bounds")


def review_size_issue(prefix: str = "") -> Column:
    """Size class used by the review flag (limit 5 pixels)."""
    w, h = width(prefix), height(prefix)
    return F.when((w <= 0) | (h <= 0), "invalid_size").when((w < 5) | (h < 5), "too_small")


def yolo_box(wide: Column, high: Column) -> dict[str, Column]:
    """Normalised center and size of an already clamped box."""
    x1, y1, x2, y2 = corners()
    return {
        "cx": (x1 + x2) / 2 / wide,
        "cy": (y1 + y2) / 2 / high,
        "w": (x2 - x1) / wide,
        "h": (y2 - y1) / high,
    }
