"""Quantile sketches that merge, and measured calls."""

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from boxline.operators import metrics as M
from boxline.operators import recognition as R

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_merged_sketches_keep_their_bound(spark):
    rng = np.random.default_rng(4)
    rows = [
        (config, int(day), float(v), bool(rng.random() < 0.9))
        for config, values in (("even", rng.random(9000)), ("heavy", rng.pareto(1.1, 9000)), ("same", np.ones(300)))
        for day, v in zip(rng.integers(0, 12, len(values)), values)
    ] + [("failed", 1, 5.0, False)]
    timings = spark.createDataFrame(rows, "config string, day int, elapsed_ms double, ok boolean")
    daily = M.latency_sketches(timings, ["config", "day"])
    # Merged twice, by halves of the days and then in all.
    halves = M.merge_sketches(daily.withColumn("half", F.col("day") % 2), ["config", "half"])
    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r["config"]: r for r in M.sketch_quantiles(M.merge_sketches(halves, ["config"]), shares).collect()}
    for config in ("even", "heavy", "same"):
        own = np.sort([v for c, _, v, ok in rows if c == config and ok])
        assert got[config]["timed"] == len(own)
        assert got[config]["calls"] == sum(c == config for c, *_ in rows)
        for name, share in shares.items():
            low, high = (np.searchsorted(own, got[config][name], side) / len(own) for side in ("left", "right"))
            assert low - 0.005 <= share <= high + 0.005, (config, name)
    assert got["failed"]["median"] is None and got["failed"]["calls"] == 1
    assert M.merge_sketches(daily.limit(0), ["config"]).count() == 0


def odd_fails():
    def call(value):
        if value % 2:
            raise ValueError("odd")

    return call


def test_measured_calls(spark):
    items = spark.range(50).select(
        F.lit("e").alias("engine"), F.when(F.col("id") < 20, "few").otherwise("many").alias("config"),
        F.col("id").alias("item_id"), F.col("id").alias("item"),
    ).repartition(3)
    timings, counts, observed = R.measured_calls(items, odd_fails, rounds=4)
    assert observed == {"calls": 200, "failures": 100}
    got = {r["config"]: (r.calls, r["items"], r.rounds, r.failures) for r in counts.collect()}
    assert got == {"few": (80, 20, 4, 40), "many": (120, 30, 4, 60)}
    # The calls aren't made again: times stay as they are.
    assert timings.orderBy("item_id", "round").collect() == timings.orderBy("item_id", "round").collect()
    assert R.measured_calls(items.limit(0), odd_fails)[1].count() == 0
