"""Session helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that later uses read one fixed result."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Results of a loop, each written as Parquet to the shared folder and read again.

    A checkpoint keeps the size that its plan was estimated to have. In a loop these estimates multiply from
    round to round, until planning takes longer than the work; what is read from a table has the table's own
    size. A result is deleted when the next but one is written, so use only the last two.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def write(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(0))
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(path)
