"""What a Python process keeps between tasks."""

from __future__ import annotations

import pickle
import sys
import types
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def kept() -> dict:
    """A store of this process. Task code is shipped by value, and module globals with it; this isn't."""
    return sys.modules.setdefault("_boxline_kept", types.ModuleType("_boxline_kept")).__dict__


def ship(spark: SparkSession, value) -> Callable:
    """A function that gives ``value`` in tasks, fetched once per process and unpacked by each task.

    A plain broadcast would need this package on the executors to unpack its classes.
    """
    share = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(share.value)
