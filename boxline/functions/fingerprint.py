"""Content fingerprints: average hash, digests, Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxline.functions.binding import bind


def mean_of(values: Column) -> Column:
    """Mean of an array of numbers."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return total / F.size(values)


def _over_mean(thumbnail: Column, body) -> Column:
    return bind(thumbnail, lambda t: bind(mean_of(t), lambda m: body(t, m)))


def average_hash(thumbnail: Column) -> Column:
    """Bits of an 8 x 8 gray thumbnail: '1' where a pixel lies above the mean."""
    return _over_mean(thumbnail, lambda pixels, mean: F.array_join(
        F.transform(pixels, lambda x: F.when(x.cast("double") > mean, "1").otherwise("0")), ""
    ))


def packed_hash(thumbnail: Column) -> Column:
    """The same 64 bits as one long, first pixel in the highest bit."""
    return _over_mean(thumbnail, lambda pixels, mean: F.aggregate(
        pixels,
        F.lit(0).cast("long"),
        lambda a, x: F.shiftleft(a, 1).bitwiseOR(
            F.when(x.cast("double") > mean, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ),
    ))


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def similarity(left: Column, right: Column, bits: int = 64) -> Column:
    return 1 - hamming(left, right) / bits


def digest(content: Column) -> Column:
    return F.md5(content)


def short_digest(content: Column) -> Column:
    """First 16 hex digits, the fallback key for content without a thumbnail."""
    return F.substring(F.md5(content), 1, 16)
