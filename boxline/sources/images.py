"""Image folders as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxline.functions.geometry import is_valid_image
from boxline.functions.text import ending, stem
from boxline.schemas import IMAGE_ENDINGS


def scan_images(
    spark: SparkSession, folder: str, endings: list[str] = IMAGE_ENDINGS,
    max_images: int | None = None,
) -> DataFrame:
    """(path, stem, length, content) of the image files below a folder, endings in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = files.where(ending(F.col("path")).isin(endings)).select(
        "path", stem(F.col("path")).alias("stem"), "length", "content"
    )
    return found if max_images is None else found.orderBy("path").limit(max_images)


def decode_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, image, is_valid): decoded in the JVM; unreadable files stay, marked invalid."""
    read = spark.read.format("image").option("dropInvalid", False).option(
        "recursiveFileLookup", True
    ).load(folder)
    return read.select(
        F.col("image.origin").alias("path"), stem(F.col("image.origin")).alias("stem"), "image",
        is_valid_image(F.col("image.width"), F.col("image.height")).alias("is_valid"),
    )


def plain_base64(content: Column) -> Column:
    """Base64 without line breaks."""
    return F.translate(F.base64(content), "\r\n", "")


def encode_requests(images: DataFrame) -> DataFrame:
    """(stem, image_base64): one request row per image for an offline labelling job."""
    return images.select("stem", plain_base64(F.col("content")).alias("image_base64"))
