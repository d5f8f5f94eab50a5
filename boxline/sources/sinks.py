"""Writers: label files, reports, dataset folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.sources.label_files import LabelFiles


def write_label_files(lines: DataFrame, images: DataFrame, folder: str) -> None:
    """Writes label lines as ``split/image_stem.txt``, one file per image; images without a line get an empty file.

    Lines are streamed to their files, so no image is gathered into one row, and all files of the job appear or none
    (see ``label_files``). Earlier files of the folder are replaced. ``lines`` has image_stem, line_no, line;
    ``images`` has image_stem and split. ``folder`` is mounted on the driver and all executors.
    """
    images.sparkSession.dataSource.register(LabelFiles)
    rows = images.select("image_stem", "split").join(lines, "image_stem", "left")
    (
        rows.select("split", "image_stem", "line_no", "line")
        .repartition("split", "image_stem")
        .sortWithinPartitions("split", "image_stem", "line_no")
        .select("split", "image_stem", "line")
        .write.format("label_files").mode("overwrite").save(folder)
    )


def write_json(rows: DataFrame, folder: str, stamped: bool = False) -> None:
    """Predictions, reports or session records as JSON lines; ``stamped`` adds ``run_stamp``, when the job began."""
    if stamped:
        rows = rows.withColumn("run_stamp", F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))
    rows.write.mode("overwrite").json(folder)


def report_lines(stats: DataFrame, results: DataFrame) -> DataFrame:
    """Plain text report: a block of totals, then the results by source type.

    ``stats`` is one row (calls, regions, total_ms); each line keeps a sort key.
    """
    per_region = F.try_divide("total_ms", "regions")
    block = F.array(
        F.lit("recognition results"),
        F.lit("=" * 50),
        F.format_string("- calls: %d", F.col("calls")),
        F.format_string("- regions: %d", F.col("regions")),
        F.format_string("- total: %.1f ms", F.col("total_ms")),
        F.format_string("- mean: %.1f ms per region", per_region),
        F.format_string("- rate: %.1f regions per second", 1000 / per_region),
    )
    head = stats.select(F.posexplode(block).alias("i", "line")).select(
        F.lit("").alias("source_type"), F.lit(0).cast("long").alias("image_id"),
        F.col("i").cast("long").alias("region_idx"), "line",
    )
    body = results.select(
        "source_type", "image_id", "region_idx",
        F.format_string(
            "%s %d/%d: %s (confidence %.3f)",
            F.col("source_type"), F.col("image_id"), F.col("region_idx"), F.col("text"),
            F.col("confidence"),
        ).alias("line"),
    )
    return head.unionByName(body)


def write_report(lines: DataFrame, folder: str) -> None:
    """Report text in order, one file per range of lines."""
    lines.orderBy("source_type", "image_id", "region_idx").select("line").write.mode(
        "overwrite"
    ).text(folder)


def write_dataset(manifest: DataFrame, folder: str) -> None:
    """Dataset rows by split, as Parquet folders."""
    manifest.write.mode("overwrite").partitionBy("split").parquet(folder)
