"""Latency, throughput and result statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.operators.hot import HOT_ROWS, hot_keys, lookup_join, null_safe_join
from boxline.operators.ordered import OrderedGroups, ranked


def exact_quantiles(
    rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
    limit: int = HOT_ROWS, detect: bool = True,
) -> DataFrame:
    """Linearly interpolated quantiles per key, exact for groups of any size.

    Equal values are counted first; the running count over distinct values then shows which
    values hold the wanted ranks, so no task keeps a whole group in memory.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_c")
    )
    hot = hot_keys(counts, keys, limit) if detect else None
    ordered = OrderedGroups(counts, keys, [value], limit=limit, hot=hot, detect=False)
    cumulated = ordered.running_sum(F.col("_c"), "_cum").frame()
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = lookup_join(
        cumulated, totals, keys, limit=limit, hot=hot, detect=False, null_safe=True
    )

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_cum") > rank, F.col(value)))

    picked, results = [], []
    for name, share in quantiles.items():
        spot = (F.col("_n") - 1) * share
        picked += [at(F.floor(spot)).alias(f"_lo_{name}"), at(F.ceil(spot)).alias(f"_hi_{name}")]
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        part = (F.col("_n") - 1) * share
        results.append((low + (high - low) * (part - F.floor(part))).alias(name))
    return joined.groupBy(*keys).agg(F.first("_n").alias("_n"), *picked).select(*keys, *results)


def _spread(value: str) -> list[Column]:
    return [
        F.avg(value).alias("avg_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"),
        F.stddev_pop(value).alias("std_ms"), F.sum(value).alias("total_ms"),
    ]


def latency_summary(
    timings: DataFrame, keys: list[str], approximate: bool = False, limit: int = HOT_ROWS
) -> DataFrame:
    """Calls, successes, spread, quantiles, fps and throughput of timings (elapsed_ms, ok).

    Times of failed calls do not enter the statistics. Quantiles are exact; ``approximate`` takes
    Spark's sketch instead and needs no ordering.
    """
    timed = timings.withColumn("_t", F.when(F.col("ok"), F.col("elapsed_ms")))
    wanted = {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    sketch = [
        F.percentile_approx("_t", q, 10_000).alias(n) for n, q in wanted.items()
    ] if approximate else []
    base = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_calls"), F.count_if(F.col("ok")).alias("successful_calls"),
        *_spread("_t"), *sketch,
    )
    if not approximate:
        exact = exact_quantiles(timed, keys, "_t", wanted, limit)
        base = null_safe_join(base, exact, keys, "left")
    return base.withColumns({
        "success_rate": F.try_divide("successful_calls", "total_calls"),
        "fps": F.try_divide(F.lit(1000.0), F.col("avg_ms")),
        "throughput_per_second": F.try_divide(
            F.col("successful_calls"), F.col("total_ms") / 1000
        ),
    })


# Size of a quantile sketch: its values are off by about 0.4 % of the ranks at most.
SKETCH_SIZE = 800


def latency_sketches(timings: DataFrame, keys: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """(keys, calls, timed, sketch): partials of timings (elapsed_ms, ok) to be stored, of a few kB per key.

    Partials of days or runs merge into those of longer spans (``merge_sketches``) without the rows they came from.
    Times of failed calls do not enter.
    """
    value = F.when(F.col("ok"), F.col("elapsed_ms"))
    return timings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.count(value).alias("timed"),
        F.kll_sketch_agg_double(value, size).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer keys merged to one per ``keys``; they can be merged again."""
    return sketches.groupBy(*keys).agg(
        F.sum("calls").alias("calls"), F.sum("timed").alias("timed"),
        F.kll_merge_agg_double(F.when(F.col("timed") > 0, F.col("sketch"))).alias("sketch"),
    )


def sketch_quantiles(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Adds the quantiles of each sketch; null where no call succeeded."""
    return sketches.withColumns({
        name: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share)))
        for name, share in quantiles.items()
    })


def compare_modes(timings: DataFrame, keys: list[str], baseline: str, improved: str) -> DataFrame:
    """Mean, minimum and maximum time of two modes and the speedup of the second."""
    def stats(mode: str) -> list[Column]:
        value = F.when(F.col("mode") == mode, F.col("elapsed_ms"))
        return [
            F.avg(value).alias(f"{mode}_avg_ms"), F.min(value).alias(f"{mode}_min_ms"),
            F.max(value).alias(f"{mode}_max_ms"),
        ]

    grouped = timings.groupBy(*keys).agg(*stats(baseline), *stats(improved))
    return grouped.withColumns({
        f"{baseline}_fps": F.try_divide(F.lit(1000.0), F.col(f"{baseline}_avg_ms")),
        f"{improved}_fps": F.try_divide(F.lit(1000.0), F.col(f"{improved}_avg_ms")),
        "speedup": F.try_divide(F.col(f"{baseline}_avg_ms"), F.col(f"{improved}_avg_ms")),
    })


def worker_stats(results: DataFrame, keys: list[str]) -> DataFrame:
    """Regions and times per worker. Times are added as decimals of six places, in any order the same."""
    timed = results.groupBy(*keys, "worker_id").agg(
        F.count(F.lit(1)).alias("n_regions"), F.count("time_ms").alias("_timed"),
        F.min("time_ms").alias("min_ms"), F.max("time_ms").alias("max_ms"),
        F.sum(F.col("time_ms").cast("decimal(18,6)")).cast("double").alias("total_ms"),
    )
    return timed.select(
        *keys, "worker_id", "n_regions", F.try_divide("total_ms", "_timed").alias("avg_ms"), "min_ms",
        "max_ms", "total_ms",
    )


def worker_efficiency(results: DataFrame, keys: list[str]) -> DataFrame:
    """Serial time, parallel time, speedup and efficiency over the workers of each run."""
    return worker_stats(results, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("workers"),
        F.sum("n_regions").alias("n_regions"),
        F.sum("total_ms").alias("serial_ms"),
        F.max("total_ms").alias("parallel_ms"),
    ).withColumn(
        "speedup", F.coalesce(F.try_divide("serial_ms", "parallel_ms"), F.lit(1.0))
    ).withColumn("efficiency", F.col("speedup") / F.col("workers"))


def detections_per_image(images: DataFrame, detections: DataFrame) -> DataFrame:
    """Images, detections and their mean per image; images without detections count as 0."""
    counts = detections.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    filled = images.select("image_id").join(counts, "image_id", "left").select(
        F.coalesce("n", F.lit(0)).alias("n")
    )
    return filled.agg(
        F.count(F.lit(1)).alias("n_images"), F.sum("n").alias("total_detections"),
        F.avg("n").alias("avg_detections"),
    )


def extraction_report(results: DataFrame) -> DataFrame:
    """Regions, lines and time per scenario with a total row, means and lines per second.

    ``results`` has one row per region: scenario, lines_detected, time_ms.
    """
    rolled = results.rollup("scenario").agg(
        F.grouping("scenario").alias("is_total"),
        F.count(F.lit(1)).alias("regions"),
        F.sum("lines_detected").alias("lines"),
        F.sum("time_ms").alias("total_ms"),
    )
    return rolled.select(
        F.when(F.col("is_total") == 1, "total").otherwise(F.col("scenario")).alias("scenario"),
        "is_total", "regions", "lines", "total_ms",
        F.try_divide("total_ms", "regions").alias("ms_per_region"),
        F.try_divide("total_ms", "lines").alias("ms_per_line"),
        F.try_divide(F.col("lines") * 1000, F.col("total_ms")).alias("lines_per_second"),
    )


def call_log_stats(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, times, pixels, empty results and success rate of a recognition log."""
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.sum("time_ms").alias("total_ms"), F.avg("time_ms").alias("avg_ms"),
        F.min("time_ms").alias("min_ms"), F.max("time_ms").alias("max_ms"),
        F.avg("pixels").alias("avg_pixels"), F.sum("pixels").alias("total_pixels"),
        F.count_if(empty).alias("empty_results"),
    ).withColumn(
        "success_rate",
        F.try_divide(F.col("total_calls") - F.col("empty_results"), F.col("total_calls")),
    )


def stage_shares(stages: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Share of each named stage in the total, the rest, and throughput.

    ``stages`` has (stage, time_ms, n_regions) rows; the stage ``total`` holds the whole time.
    """
    def spent(stage: str) -> Column:
        return F.sum(F.when(F.col("stage") == stage, F.col("time_ms")).otherwise(0.0))

    grouped = stages.groupBy(*keys).agg(
        spent("total").alias("total_ms"),
        F.sum(F.when(F.col("stage") == "total", F.col("n_regions"))).alias("n_regions"),
        *[spent(n).alias(f"{n}_ms") for n in names],
    )
    known = sum((F.col(f"{n}_ms") for n in names), F.lit(0.0))
    return grouped.withColumn("other_ms", F.col("total_ms") - known).withColumns({
        **{f"{n}_share": F.try_divide(f"{n}_ms", "total_ms") for n in names},
        "ms_per_region": F.try_divide("total_ms", "n_regions"),
        "regions_per_second": F.try_divide(F.col("n_regions"), F.col("total_ms") / 1000),
    })


def scaling_sweep(runs: DataFrame, baseline: str) -> DataFrame:
    """Mean time per configuration and the speedup against the baseline configuration."""
    per = runs.groupBy("config").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("elapsed_ms").alias("avg_ms")
    )
    # The baseline is one row.
    base = per.where(F.col("config") == baseline).select(F.col("avg_ms").alias("_base"))
    return per.join(F.broadcast(base), F.lit(True), "left").select(
        "config", "runs", "avg_ms",
        F.try_divide(F.lit(1000.0), F.col("avg_ms")).alias("per_second"),
        F.try_divide("_base", "avg_ms").alias("speedup"),
    )


def most_common(
    rows: DataFrame, keys: list[str], value: str, first: str, at_least: int = 1
) -> DataFrame:
    """The most common value per key with its count; earlier first sight, then value, win ties."""
    counts = rows.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), F.min(first).alias("_first")
    )
    best = counts.groupBy(*keys).agg(
        F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "_first", value)).alias("b")
    )
    return best.select(*keys, f"b.{value}", "b.n").where(F.col("n") >= at_least)
