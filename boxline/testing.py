"""Helpers for tests, bench and checks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str = "8") -> SparkSession:
    """A local session with its own checkpoint folder."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("boxline")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BOXLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(rows: list[tuple]) -> list[tuple]:
    """Rows in a fixed order with comparable values."""
    def value(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        if isinstance(v, (list, tuple)):
            return tuple(value(x) for x in v)
        return v

    return sorted((tuple(value(v) for v in row) for row in rows), key=repr)
