"""Image and label pairing, validation, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_share(stem: Column) -> Column:
    """A fixed number in 0..1 for a file stem: the first 8 hex digits of its md5."""
    return F.conv(F.substring(F.md5(stem), 1, 8), 16, 10).cast("double") / 4294967296.0


def split_of(stem: Column, train: float = 0.8, val: float = 0.2) -> Column:
    """train, val or test; the same stem always gets the same split."""
    share = split_share(stem)
    return (
        F.when(share < train, "train").when(share < train + val, "val").otherwise("test")
    )


def pair_labelled(images: DataFrame, validity: DataFrame) -> DataFrame:
    """Images with a valid label file."""
    valid = validity.where("is_valid").select("image_stem")
    return images.join(valid, "image_stem", "left_semi")


def pair_all(images: DataFrame, labels: DataFrame) -> DataFrame:
    """All images with their label columns, null where an image has none."""
    return images.join(labels, "image_stem", "left")


def unlabelled(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images without a label file, for the skip report."""
    return images.join(labels.select("image_stem"), "image_stem", "left_anti")


def new_classes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Classes of the second label table that the first lacks."""
    return after.select("class").distinct().join(
        before.select("class").distinct(), "class", "left_anti"
    )


def prepare_dataset(
    images: DataFrame, validity: DataFrame, train: float = 0.8, val: float = 0.2
) -> DataFrame:
    """The training manifest: validated pairs with their split."""
    return pair_labelled(images, validity).withColumn(
        "split", split_of(F.col("image_stem"), train, val)
    )
