"""Label files and character dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxline.functions.annotations import is_label_line
from boxline.functions.text import stem
from boxline.schemas import LABEL_JSON

_PARTS = "(?U)\\s+"


def read_label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image_stem, line_no, line) of YOLO label files; a blank file gives one null line.

    Spark lists no zero-byte files. Our own writer ends each file with a line break; for files
    from elsewhere pass their names to ``label_file_validity``.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(
        F.col("_metadata.file_path").alias("path"), "value"
    )
    body = F.regexp_replace("value", "\\r?\\n$", "")
    lines = F.when(body != "", F.split(body, "\\r?\\n"))
    return files.select(
        "path", stem(F.col("path")).alias("image_stem"),
        F.posexplode_outer(lines).alias("line_no", "line"),
    ).select("path", "image_stem", F.col("line_no").cast("long").alias("line_no"), "line")


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """Label lines as typed columns; malformed fields are null."""
    parts = F.split(F.trim("line"), _PARTS)

    def field(i: int, kind: str) -> Column:
        return F.get(parts, F.lit(i)).try_cast(kind)

    return lines.where(F.col("line").isNotNull()).select(
        "image_stem", "line_no", field(0, "int").alias("class_id"),
        *[field(i + 1, "double").alias(n) for i, n in enumerate(["cx", "cy", "w", "h"])],
    )


def label_file_validity(
    lines: DataFrame, require_nonempty: bool = True, files: DataFrame | None = None
) -> DataFrame:
    """(image_stem, n_lines, is_valid): one bad line spoils its file.

    Empty files are invalid for training; pass ``require_nonempty=False`` for the labeller's rule.
    ``files`` (image_stem) lists files that must appear even when they hold nothing.
    """
    good = is_label_line(F.col("line"))
    per_file = lines.groupBy("image_stem").agg(
        F.count("line").alias("n_lines"),
        F.bool_and(F.when(F.col("line").isNotNull(), good)).alias("_good"),
    )
    if files is not None:
        per_file = files.select("image_stem").distinct().join(per_file, "image_stem", "full")
    count = F.coalesce("n_lines", F.lit(0))
    filled = (count > 0) if require_nonempty else F.lit(True)
    return per_file.select(
        "image_stem", count.alias("n_lines"),
        (F.coalesce("_good", F.lit(True)) & filled).alias("is_valid"),
    )


def read_label_json(spark: SparkSession, folder: str) -> DataFrame:
    """(image_stem, class, bbox, confidence) of JSON label files; a file without objects gives
    one row of nulls."""
    files = spark.read.schema(LABEL_JSON).option("multiLine", True).json(
        folder, pathGlobFilter="*.json"
    ).select(stem(F.col("_metadata.file_path")).alias("image_stem"), "objects")
    return _objects(files)


def parse_label_json(texts: DataFrame) -> DataFrame:
    """The same from a table (image_stem, value) that holds the JSON texts."""
    return _objects(texts.select("image_stem", F.from_json("value", LABEL_JSON)["objects"].alias("objects")))


def _objects(files: DataFrame) -> DataFrame:
    return files.select(
        "image_stem", F.explode_outer(F.coalesce("objects", F.array())).alias("o")
    ).select("image_stem", "o.class", "o.bbox", "o.confidence")


def read_character_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(class_idx, char) of a dictionary file: ``<blank>`` first, the characters, a space last."""
    return character_dictionary(spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split("value", "\\r?\\n")).alias("pos", "char")
    ))


def character_dictionary(lines: DataFrame) -> DataFrame:
    """The dictionary of lines (pos, char). There is one line per character of a script, so a single
    partition orders them.
    """
    stripped = lines.withColumn(
        "char", F.regexp_replace("char", "(?U)^\\s+|\\s+$", "")
    ).where(F.col("char") != "")
    order = Window.partitionBy(F.lit(0)).orderBy("pos")
    chars = stripped.select(F.row_number().over(order).alias("class_idx"), "char")
    ends = chars.agg(
        F.array(
            F.struct(F.lit(0).alias("class_idx"), F.lit("<blank>").alias("char")),
            F.struct(
                (F.coalesce(F.max("class_idx"), F.lit(0)) + 1).alias("class_idx"),
                F.lit(" ").alias("char"),
            ),
        ).alias("e")
    ).select(F.inline("e"))
    return chars.unionByName(ends)
