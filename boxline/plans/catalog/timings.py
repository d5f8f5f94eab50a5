"""Queries over timings and recognition logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.operators import metrics as M
from boxline.operators import recognition as R
from boxline.plans.catalog import views as V
from boxline.session import shared_path


def _rounded(frame, digits: int = 4):
    doubles = [f.name for f in frame.schema.fields if f.dataType.typeName() == "double"]
    return frame.withColumns({c: F.round(c, digits) for c in doubles})


def latency_summary(spark, folder):
    return _rounded(M.latency_summary(X.timings(spark, folder), ["config"]))


def latency_by_worker(spark, folder):
    return _rounded(M.latency_summary(X.timings(spark, folder), ["config", "item_id"]), 6)


def mode_comparison(spark, folder):
    rows = X.timings(spark, folder).withColumn(
        "mode", F.when(F.col("config") == "error", "uncached").otherwise("cached")
    )
    return _rounded(M.compare_modes(rows, ["engine"], "uncached", "cached"))


def _worker_results(spark, folder):
    """The user of an event is the worker that recorded it."""
    return X.timings(spark, folder).withColumnsRenamed(
        {"elapsed_ms": "time_ms", "item_id": "worker_id"}
    )


def worker_stats(spark, folder):
    # Not rounded: a mean of few times may lie half way between two roundings.
    return M.worker_stats(_worker_results(spark, folder), ["config"])


def worker_efficiency(spark, folder):
    return _rounded(M.worker_efficiency(_worker_results(spark, folder), ["config"]))


def extraction_report(spark, folder):
    rows = X.timings(spark, folder).select(
        F.col("config").alias("scenario"), (F.col("item_id") % 7).alias("lines_detected"),
        F.col("elapsed_ms").alias("time_ms"),
    )
    return _rounded(M.extraction_report(rows))


def call_log_stats(spark, folder):
    calls = X.timings(spark, folder).select(
        "config", F.col("elapsed_ms").alias("time_ms"), (F.col("item_id") * 48).alias("pixels"),
        F.when(F.col("ok"), F.col("config")).otherwise(F.lit("  ")).alias("text"),
    )
    return _rounded(M.call_log_stats(calls, ["config"]))


def stage_shares(spark, folder):
    """Views are concatenation, clicks recognition; a purchase closes with the whole time."""
    stage = (
        F.when(F.col("config") == "view", "concat").when(F.col("config") == "click", "ocr")
        .when(F.col("config") == "purchase", "total").otherwise("split")
    )
    rows = X.timings(spark, folder).select(
        "engine", stage.alias("stage"), F.col("elapsed_ms").alias("time_ms"),
        F.lit(1).alias("n_regions"),
    )
    return _rounded(M.stage_shares(rows, ["engine"], ["concat", "ocr", "split"]))


def scaling_sweep(spark, folder):
    return _rounded(M.scaling_sweep(X.timings(spark, folder), "view"))


def merged_quantiles(spark, folder):
    """Daily sketches, stored and merged: whether each quantile lies within one per cent of the exact ranks."""
    timings = X.timings(spark, folder).withColumn("day", F.col("ts").cast("date"))
    path = shared_path(spark, "sketches")
    M.latency_sketches(timings, ["config", "day"]).write.parquet(path)
    daily = spark.read.parquet(path)
    days = daily.groupBy("config").agg(F.count(F.lit(1)).alias("days"))
    merged = M.merge_sketches(daily, ["config"]).join(days, "config")
    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    found = M.sketch_quantiles(merged, shares)
    bounds = {
        f"{name}_{side}": min(1.0, max(0.0, share + step))
        for name, share in shares.items() for side, step in (("low", -0.01), ("high", 0.01))
    }
    exact = M.exact_quantiles(timings.where("ok"), ["config"], "elapsed_ms", bounds)
    return found.join(exact, "config").select("config", "days", "calls", "timed", *[
        F.col(name).between(F.col(f"{name}_low"), F.col(f"{name}_high")).alias(f"{name}_holds") for name in shares
    ])


def slow_or_failing():
    """A measured function of a text, which fails on texts of an odd number of lines."""
    def call(text):
        if text is None or text.count("\n") % 2:
            raise ValueError("odd")
        return len(text)

    return call


def measured_calls(spark, folder):
    """Calls of a function on every document, three rounds each: how many there were and how many failed."""
    docs = X.table(spark, folder, "documents").select(
        F.lit("lengths").alias("engine"), F.col("lang").alias("config"), F.col("doc_id").alias("item_id"),
        F.col("text").alias("item"),
    )
    return R.measured_calls(docs, slow_or_failing, rounds=3)[1]


QUERIES = {f.__name__: f for f in (
    latency_summary, latency_by_worker, mode_comparison, worker_stats, worker_efficiency,
    extraction_report, call_log_stats, stage_shares, scaling_sweep, merged_quantiles, measured_calls,
)}


def _latency(keys: str) -> str:
    return V.using(V.TIMINGS, "t AS (SELECT *, CASE WHEN ok THEN elapsed_ms END AS v FROM timings)") + f"""
SELECT {keys}, count(*) AS total_calls, count(*) FILTER (ok) AS successful_calls,
  round(avg(v), 4) AS avg_ms, round(min(v), 4) AS min_ms, round(max(v), 4) AS max_ms,
  round(stddev_pop(v), 4) AS std_ms, round(sum(v), 4) AS total_ms,
  round(quantile_cont(v, 0.5), 4) AS median_ms, round(quantile_cont(v, 0.95), 4) AS p95_ms,
  round(quantile_cont(v, 0.99), 4) AS p99_ms,
  round(count(*) FILTER (ok) / count(*), 4) AS success_rate, round(1000 / avg(v), 4) AS fps,
  round(count(*) FILTER (ok) / (sum(v) / 1000), 4) AS throughput_per_second
FROM t GROUP BY {keys}"""


_WORKERS = """w AS (SELECT config, elapsed_ms AS time_ms, item_id AS worker_id FROM timings),
stats AS (SELECT config, worker_id, count(*) AS n_regions,
    CAST(sum(CAST(time_ms AS DECIMAL(18, 6))) AS DOUBLE) / count(time_ms) AS avg_ms,
    min(time_ms) AS min_ms, max(time_ms) AS max_ms,
    CAST(sum(CAST(time_ms AS DECIMAL(18, 6))) AS DOUBLE) AS total_ms
  FROM w GROUP BY config, worker_id)"""

SQL = {
    "latency_summary": _latency("config"),
    "latency_by_worker": _latency("config, item_id").replace(", 4)", ", 6)"),
    "mode_comparison": V.using(V.TIMINGS, """m AS (SELECT engine,
    CASE WHEN config = 'error' THEN elapsed_ms END AS u,
    CASE WHEN config <> 'error' THEN elapsed_ms END AS c FROM timings)""") + """
SELECT engine, round(avg(u), 4) AS uncached_avg_ms, round(min(u), 4) AS uncached_min_ms,
  round(max(u), 4) AS uncached_max_ms, round(avg(c), 4) AS cached_avg_ms,
  round(min(c), 4) AS cached_min_ms, round(max(c), 4) AS cached_max_ms,
  round(1000 / avg(u), 4) AS uncached_fps, round(1000 / avg(c), 4) AS cached_fps,
  round(avg(u) / avg(c), 4) AS speedup
FROM m GROUP BY engine""",
    "worker_stats": V.using(V.TIMINGS, _WORKERS) + """
SELECT config, worker_id, n_regions, avg_ms, min_ms, max_ms, total_ms FROM stats""",
    "worker_efficiency": V.using(V.TIMINGS, _WORKERS) + """
SELECT config, count(*) AS workers, CAST(sum(n_regions) AS BIGINT) AS n_regions,
  round(sum(total_ms), 4) AS serial_ms, round(max(total_ms), 4) AS parallel_ms,
  round(sum(total_ms) / max(total_ms), 4) AS speedup,
  round(sum(total_ms) / max(total_ms) / count(*), 4) AS efficiency
FROM stats GROUP BY config""",
    "extraction_report": V.using(V.TIMINGS, """r AS (SELECT CASE WHEN grouping(config) = 1
      THEN 'total' ELSE config END AS scenario, CAST(grouping(config) AS TINYINT) AS is_total,
    count(*) AS regions, CAST(sum(item_id % 7) AS BIGINT) AS lines, sum(elapsed_ms) AS t
  FROM timings GROUP BY ROLLUP (config))""") + """
SELECT scenario, is_total, regions, lines, round(t, 4) AS total_ms,
  round(t / regions, 4) AS ms_per_region, round(t / lines, 4) AS ms_per_line,
  round(lines * 1000 / t, 4) AS lines_per_second FROM r""",
    "call_log_stats": V.using(V.TIMINGS) + """
SELECT config, count(*) AS total_calls, round(sum(elapsed_ms), 4) AS total_ms,
  round(avg(elapsed_ms), 4) AS avg_ms, round(min(elapsed_ms), 4) AS min_ms,
  round(max(elapsed_ms), 4) AS max_ms, round(avg(item_id * 48), 4) AS avg_pixels,
  CAST(sum(item_id * 48) AS BIGINT) AS total_pixels, count(*) FILTER (NOT ok) AS empty_results,
  round(count(*) FILTER (ok) / count(*), 4) AS success_rate
FROM timings GROUP BY config""",
    "stage_shares": V.using(V.TIMINGS, """s AS (SELECT engine,
    sum(elapsed_ms) FILTER (config = 'purchase') AS t,
    count(*) FILTER (config = 'purchase') AS n,
    sum(elapsed_ms) FILTER (config = 'view') AS c, sum(elapsed_ms) FILTER (config = 'click') AS o,
    sum(elapsed_ms) FILTER (config IN ('signup', 'error')) AS p FROM timings GROUP BY engine)""") + """
SELECT engine, round(t, 4) AS total_ms, n AS n_regions, round(c, 4) AS concat_ms,
  round(o, 4) AS ocr_ms, round(p, 4) AS split_ms, round(t - (c + o + p), 4) AS other_ms,
  round(c / t, 4) AS concat_share, round(o / t, 4) AS ocr_share, round(p / t, 4) AS split_share,
  round(t / n, 4) AS ms_per_region, round(n / (t / 1000), 4) AS regions_per_second FROM s""",
    "merged_quantiles": V.using(V.TIMINGS) + """
SELECT config, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS calls, count(*) FILTER (ok) AS timed,
  true AS median_holds, true AS p95_holds, true AS p99_holds
FROM timings GROUP BY config""",
    "measured_calls": """
SELECT 'lengths' AS engine, lang AS config, 3 * count(*) AS calls, count(*) AS items, 3 AS rounds,
  3 * count(*) FILTER (text IS NULL OR (length(text) - length(replace(text, chr(10), ''))) % 2 = 1) AS failures
FROM documents GROUP BY lang""",
    "scaling_sweep": V.using(V.TIMINGS, """per AS (SELECT config, count(*) AS runs,
    avg(elapsed_ms) AS a FROM timings GROUP BY config)""") + """
SELECT config, runs, round(a, 4) AS avg_ms, round(1000 / a, 4) AS per_second,
  round((SELECT a FROM per WHERE config = 'view') / a, 4) AS speedup FROM per""",
}
