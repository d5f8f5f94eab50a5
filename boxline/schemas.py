"""Table schemas and the fixed class dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Detector class names; the position is the class id.
CLASSES = [
    "receiver_avatar",
    "receiver_name",
    "input_box",
    "send_button",
    "chat_message",
    "contact_item",
    "user_avatar",
]
# Classes that may occur once per image, and classes every image needs.
UNIQUE_CLASSES = ["receiver_name", "receiver_avatar", "input_box", "send_button"]
REQUIRED_CLASSES = ["receiver_name", "input_box"]
# Image file endings that are scanned.
IMAGE_ENDINGS = [".jpg", ".jpeg", ".png", ".bmp"]
# Side limits of a valid image.
MIN_SIDE, MAX_SIDE = 8, 4096

LABEL_JSON = T.StructType([
    T.StructField("objects", T.ArrayType(T.StructType([
        T.StructField("class", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.IntegerType())),
        T.StructField("confidence", T.DoubleType()),
    ]))),
])


def class_table(spark: SparkSession, classes: list[str] = CLASSES) -> DataFrame:
    """(class_id, class) for a class list."""
    return spark.createDataFrame(list(enumerate(classes)), "class_id int, class string")


def class_name(class_id: Column, classes: list[str] = CLASSES) -> Column:
    """Class name of an id; null for an id outside the dictionary, negative ids included."""
    names = F.array(*[F.lit(c) for c in classes])
    known = (class_id >= 0) & (class_id < len(classes))
    return F.when(known, F.get(names, class_id))


def class_number(name: Column, classes: list[str] = CLASSES) -> Column:
    """Class id of a name; null for an unknown name."""
    names = F.array(*[F.lit(c) for c in classes])
    position = F.array_position(names, name)
    return F.when(position > 0, (position - 1).cast("int"))
