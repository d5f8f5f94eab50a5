"""Detection, frame, profile and text tables derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxline.schemas import class_name

WIDTH, HEIGHT = 800, 600


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """One detection per line item: the order is the image, the line number the class."""
    rows = table(spark, folder, "lineitem")
    # Unique within an image, and within a long at any scale of the tables.
    det_id = (
        F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") % 1_000 * 1_000
        + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")
    )
    x1 = (F.col("l_partkey") * 37) % 780 - 10
    y1 = (F.col("l_suppkey") * 53) % 580 - 10
    return rows.select(
        F.col("l_orderkey").alias("image_id"),
        det_id.alias("det_id"),
        (F.col("l_linenumber") - 1).alias("class_id"),
        class_name(F.col("l_linenumber") - 1).alias("class"),
        x1.cast("int").alias("x1"),
        y1.cast("int").alias("y1"),
        (x1 + F.col("l_quantity").cast("int") * 14 - 8).cast("int").alias("x2"),
        (y1 + (F.col("l_partkey") % 40) * 15 - 3).cast("int").alias("y2"),
        (((F.col("l_orderkey") * 7 + F.col("l_partkey") * 13) % 1000).cast("double") / 1000.0)
        .alias("confidence"),
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    """One image per order."""
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("image_id"))


def corrected_labels(labels: DataFrame) -> DataFrame:
    """A second label list: doubtful labels dropped, wide ones moved, sure ones renamed."""
    return labels.where(F.col("confidence") >= 0.05).withColumns({
        "class": F.when(F.col("confidence") >= 0.95, F.lit("user_avatar"))
        .otherwise(F.col("class")),
        "x2": F.when(F.col("x2") - F.col("x1") > 500, F.col("x2") - 20).otherwise(F.col("x2")),
    })


def truth_boxes(labels: DataFrame) -> DataFrame:
    """Truth for evaluation: the sure half of the detections, moved by their confidence."""
    shift = (F.col("confidence") * 20).cast("int")
    return labels.where(F.col("confidence") >= 0.5).select(
        "image_id", "class", F.col("det_id").alias("truth_id"),
        (F.col("x1") + shift).alias("q_x1"), F.col("y1").alias("q_y1"),
        (F.col("x2") + shift).alias("q_x2"), F.col("y2").alias("q_y2"),
    ).withColumnsRenamed({"q_x1": "x1", "q_y1": "y1", "q_x2": "x2", "q_y2": "y2"})


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model responses: one text per detection with its box and the box's lower half."""
    boxes = detections(spark, folder)
    middle = F.floor((F.col("y1") + F.col("y2")) / 2).cast("int")

    def flat(y1):
        return F.concat(
            F.lit("["), F.concat_ws(", ", "x1", y1.cast("string"), "x2", "y2"), F.lit("]")
        )

    def quoted(name, y1):
        return F.concat(
            F.lit('{"class": "'), name, F.lit('", "bbox": '), flat(y1), F.lit("}")
        )

    body = F.concat_ws(
        ", ", quoted(F.col("class"), F.col("y1")), quoted(F.lit("chat_message"), middle)
    )
    text = (
        F.when(
            F.col("confidence") < 0.33,
            F.concat(F.lit('```json {"objects": ['), body, F.lit("]} ```")),
        )
        .when(
            F.col("confidence") < 0.66,
            F.concat(F.lit('note {"objects": ['), body, F.lit("]} end")),
        )
        .otherwise(F.concat(
            F.col("class"), F.lit(": "), flat(F.col("y1")), F.lit("; unknown_part: "),
            flat(middle), F.lit("; chat_message: "), flat(middle),
        ))
    )
    return boxes.select(
        "image_id", "det_id", text.alias("response"),
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
    )


def zoned(events: DataFrame) -> DataFrame:
    """Events with ``ts`` as an instant; a zone-free time counts as UTC."""
    if dict(events.dtypes)["ts"] != "timestamp_ntz":
        return events
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
    return events.withColumn("ts", local.cast("timestamp"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """One recognised region per event; the user is the stream."""
    return frames_of(table(spark, folder, "events"))


def frames_of(events: DataFrame) -> DataFrame:
    event = F.col("event_id")
    x, y = (event % 5 * 4).cast("int"), (event % 3 * 3).cast("int")
    return events.select(
        F.col("user_id").alias("stream_id"), event.alias("frame_id"), "ts",
        x.alias("x1"), y.alias("y1"), (x + 100).alias("x2"), (y + 40).alias("y2"),
        F.col("event_type").alias("text"), F.col("value").alias("elapsed_ms"),
    )


def frame_regions(events: DataFrame) -> DataFrame:
    """Several recognised regions per frame: all events of a user on one day are one frame."""
    day = F.col("ts").cast("date")
    return frames_of(events).withColumns(
        {"frame_id": F.unix_date(day).cast("long"), "ts": day.cast("timestamp")}
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text line of a document; its length is the ink of a pixel row."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("image_id"),
        F.posexplode(F.split("text", "\n", -1)).alias("y", "line"),
    ).select("image_id", "y", F.length("line").alias("ink"))


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents with the sizes a line packer needs."""
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("image_id"),
        F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"),
    )
    wide = F.length("line")
    return rows.select(
        "image_id", "line_no", "line",
        (wide * 2 + 20).alias("effective_width"),
        (F.lit(14) + wide % 60).alias("char_height"),
    ).withColumn(
        "scaled_width",
        (F.col("effective_width") * (F.lit(48.0) / F.col("char_height"))).cast("int"),
    )


def components(spark: SparkSession, folder: str) -> DataFrame:
    """Detections with positive size as connected components."""
    rows = detections(spark, folder)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return rows.where((w > 0) & (h > 0)).select(
        "image_id", F.col("det_id").alias("comp_id"),
        F.col("x1").alias("x"), F.col("y1").alias("y"), w.alias("w"), h.alias("h"),
        F.floor(w * h / 2).cast("long").alias("area"),
        ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
    )


def ctc_steps(spark: SparkSession, folder: str) -> DataFrame:
    """One probability step per event; the user is the text line."""
    event = F.col("event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("line_id"), "ts", event.alias("step_id"),
        F.when(event % 4 == 0, 0).otherwise(event % 7).cast("int").alias("class_idx"),
        F.round(F.col("value") / 500.0, 6).alias("prob"),
    )


def timings(spark: SparkSession, folder: str) -> DataFrame:
    """Timing samples: the event type is the engine, errors are failed calls."""
    return table(spark, folder, "events").select(
        F.lit("engine").alias("engine"), F.col("event_type").alias("config"),
        F.col("user_id").alias("item_id"), F.col("event_id").alias("call_id"), "ts",
        F.col("value").alias("elapsed_ms"), (F.col("value") > 1.0).alias("ok"),
    )


def gray_images(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding of 64 numbers as a gray image of 8 x 8 pixels."""
    gray = F.transform(
        "embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int")
    )
    data = F.unhex(F.array_join(F.transform(gray, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.struct(
            F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"),
            data.alias("data"),
        ).alias("image"),
    )
