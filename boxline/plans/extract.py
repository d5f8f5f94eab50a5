"""Screenshot to fields: one record per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.functions import geometry as G
from boxline.operators.hot import HOT_ROWS, hot_keys, null_safe_join, small, split_hot
from boxline.operators.nearest import nearest_avatar
from boxline.operators.ordered import first_rows, ranked
from boxline.session import pin

CONTACTS = 10
MESSAGES_PER_PART = 1_000


def _ordered():
    return [F.col("confidence").desc(), F.col("det_id")]


def top_contacts(detections: DataFrame, count: int = CONTACTS) -> DataFrame:
    """The most confident contacts of each image, as one array of at most ``count``."""
    rows = first_rows(
        detections.where(F.col("class") == "contact_item"), ["image_id"], _ordered(), count
    )
    return rows.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *G.BOX, "confidence"))).alias("contacts")
    )


def message_parts(
    detections: DataFrame, size: int = MESSAGES_PER_PART, limit: int = HOT_ROWS,
    hot: DataFrame | None = None, detect: bool = True,
) -> DataFrame:
    """All messages of each image by confidence, in arrays of at most ``size``."""
    rows = ranked(
        detections.where(F.col("class") == "chat_message"), ["image_id"], _ordered(), "rank",
        limit=limit, hot=hot, detect=detect,
    )
    return rows.groupBy(
        "image_id", F.floor((F.col("rank") - 1) / size).cast("int").alias("part")
    ).agg(
        F.array_sort(F.collect_list(F.struct("rank", *G.BOX, "confidence"))).alias("messages")
    )


def message_rows(
    detections: DataFrame, min_confidence: float = 0.5, limit: int = HOT_ROWS
) -> DataFrame:
    """One row per message with its rank by confidence within the image."""
    kept = detections.where(
        (F.col("confidence") >= min_confidence) & (F.col("class") == "chat_message")
    )
    return ranked(kept, ["image_id"], _ordered(), "rank", limit=limit).select(
        "image_id", "rank", "det_id", *G.BOX, "confidence"
    )


def _heads(kept: DataFrame, limit: int, hot: DataFrame | None) -> DataFrame:
    """Receiver, avatar, input box and top contacts per image.

    All of them come from one grouping by image; only the avatar, which depends on the receiver, meets
    the image again.
    """
    best = F.struct(F.col("confidence"), -F.col("det_id"))
    payload = F.struct("det_id", *G.BOX, "confidence")

    def first(name: str) -> Column:
        return F.max_by(payload, F.when(F.col("class") == name, best)).alias(name)

    heads = kept.groupBy("image_id").agg(first("receiver_name"), first("input_box")).select(
        "image_id", F.col("receiver_name").alias("receiver"), "input_box"
    )
    avatars = nearest_avatar(kept, limit=limit, hot=hot, detect=False).select("image_id", "avatar")
    for fields in (avatars, top_contacts(kept)):
        heads = null_safe_join(heads, fields, ["image_id"], "left")
    return heads.withColumn("contacts", F.coalesce("contacts", F.array()))


def image_fields(
    detections: DataFrame, min_confidence: float = 0.5, limit: int = HOT_ROWS
) -> DataFrame:
    """One row per image, whatever its size: receiver, avatar, input box and top contacts."""
    kept = detections.where(
        (F.col("confidence") >= min_confidence) & F.col("class").isNotNull()
    )
    hot = hot_keys(kept, ["image_id"], limit)
    return _heads(kept, limit, hot).select("image_id", "receiver", "avatar", "input_box", "contacts")


def extract_fields(
    detections: DataFrame, min_confidence: float = 0.5, limit: int = HOT_ROWS
) -> DataFrame:
    """Receiver, nearest avatar, input box, contacts and messages per image.

    An image with more than ``MESSAGES_PER_PART`` messages has several rows (``part`` 0..), each
    with the same fields and the next messages; ordinary images have one.
    """
    kept = detections.where(
        (F.col("confidence") >= min_confidence) & F.col("class").isNotNull()
    )
    # The hot images found here serve all steps.
    hot = hot_keys(kept, ["image_id"], limit)
    parts = message_parts(kept, limit=limit, hot=hot, detect=False)
    return _with_parts(_heads(kept, limit, hot), parts, hot).select(
        "image_id", F.coalesce("part", F.lit(0)).alias("part"), "receiver", "avatar",
        "input_box", "contacts", F.coalesce("messages", F.array()).alias("messages"),
    )


def _with_parts(heads: DataFrame, parts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Heads with their message parts; the many parts of a hot image stay where they are."""
    if hot is None:
        return null_safe_join(heads, parts, ["image_id"], "left")
    light_heads, hot_heads = split_hot(heads, hot, ["image_id"])
    light_parts, hot_parts = split_hot(parts, hot, ["image_id"])
    hot_heads = pin(hot_heads)
    with_messages = null_safe_join(hot_parts, small(hot_heads), ["image_id"], "inner")
    without = null_safe_join(
        hot_heads, hot_parts.select("image_id").distinct(), ["image_id"], "left_anti"
    )
    return (
        null_safe_join(light_heads, light_parts, ["image_id"], "left")
        .unionByName(with_messages)
        .unionByName(without, allowMissingColumns=True)
    )
