"""Queries over line batches: batches, layout, limits, packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.operators import packing as K
from boxline.operators.hot import hot_keys
from boxline.plans.catalog import views as V

STRATEGIES = ["conservative", "balanced", "aggressive", "adaptive"]


def _batched(spark, folder):
    rows = X.components(spark, folder)
    return K.micro_batches(rows, ["image_id"], ["comp_id"], size=4)


def micro_batches(spark, folder):
    return _batched(spark, folder).select(
        "image_id", "comp_id", F.col("pos").cast("long").alias("pos"), "batch"
    )


def batch_layout(spark, folder):
    return K.batch_layout(_batched(spark, folder), ["image_id"], width="w").select(
        "image_id", "comp_id", "batch_x", "batch_width"
    )


def pack_limit(spark, folder):
    lines = X.text_lines(spark, folder)
    frames = [
        K.pack_limits(lines, strategy=s).withColumn("strategy", F.lit(s)) for s in STRATEGIES
    ]
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def pack_lines(spark, folder):
    return K.pack_lines(X.text_lines(spark, folder))


def pack_efficiency(spark, folder):
    return K.pack_efficiency(K.pack_lines(X.text_lines(spark, folder)), ["image_id"])


def strategy_sweep(spark, folder):
    """Calls per strategy over all images; a call counts 10 ms plus 1 ms per line."""
    lines = X.text_lines(spark, folder)
    long_images = hot_keys(lines, ["image_id"], K.SLICE)
    runs = None
    for strategy in STRATEGIES:
        packed = K.pack_lines(lines, strategy=strategy, hot=long_images, detect=False)
        per = K.pack_efficiency(packed, ["image_id"]).select(
            F.lit(strategy).alias("strategy"), "lines", "calls",
            (F.col("calls") * 10 + F.col("lines")).alias("time_ms"),
        )
        runs = per if runs is None else runs.unionByName(per)
    return K.best_strategy(runs).withColumns({
        "avg_efficiency": F.round("avg_efficiency", 6), "avg_time_ms": F.round("avg_time_ms", 6),
    })


QUERIES = {f.__name__: f for f in (
    micro_batches, batch_layout, pack_limit, pack_lines, pack_efficiency, strategy_sweep,
)}

_WANTED = {
    "conservative": "trunc(mw * 2.5::DOUBLE)",
    "balanced": "trunc(mw * 3 + (xw - mw) * 0.5::DOUBLE)",
    "aggressive": "xw * 6",
    "adaptive": """CASE WHEN mh < 20 THEN trunc(base * 1.5::DOUBLE)
      WHEN mh > 60 THEN trunc(base * 0.8::DOUBLE) ELSE base END""",
}


def _limits(strategy: str) -> str:
    return f"""limits_{strategy} AS (SELECT image_id,
    CAST(greatest(xw + 100, least({_WANTED[strategy]}, 8192)) AS INT) AS pack_limit
  FROM (SELECT *, trunc(mw * CASE WHEN mw / (mh * 20) < 1 THEN 8 WHEN mw / (mh * 20) < 2 THEN 5
      ELSE 3 END) AS base
    FROM (SELECT image_id, avg(effective_width) AS mw, max(effective_width) AS xw,
        avg(char_height) AS mh FROM text_lines GROUP BY image_id)))"""


def _packed(strategy: str) -> str:
    """The packs one line at a time: all images advance together."""
    return f"""packed_{strategy} AS (
  SELECT image_id, line_no, scaled_width AS w, 1 AS n, char_height AS sh, CAST(0 AS BIGINT) AS pack
  FROM text_lines WHERE line_no = 0
  UNION ALL
  SELECT l.image_id, l.line_no,
    CASE WHEN fits THEN p.w + 20 + l.scaled_width ELSE l.scaled_width END,
    CASE WHEN fits THEN p.n + 1 ELSE 1 END,
    CASE WHEN fits THEN p.sh + l.char_height ELSE l.char_height END,
    CASE WHEN fits THEN p.pack ELSE p.pack + 1 END
  FROM packed_{strategy} p
  JOIN text_lines l ON l.image_id = p.image_id AND l.line_no = p.line_no + 1
  JOIN limits_{strategy} m ON m.image_id = p.image_id,
  LATERAL (SELECT p.w + 20 + l.scaled_width <= m.pack_limit AND p.n < 20
    AND abs(l.char_height * p.n - p.sh) < p.sh AS fits))"""


def packed_lines(*strategies: str) -> str:
    """The lines of documents with their packs, as tables ``packed_<strategy>``."""
    parts = [V.TEXT_LINES]
    for s in strategies:
        parts += [_limits(s), _packed(s)]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _efficiency(strategy: str) -> str:
    return f"""(SELECT '{strategy}' AS strategy, image_id, count(*) AS lines, max(pack) + 1 AS calls
  FROM packed_{strategy} GROUP BY image_id)"""


SQL = {
    "micro_batches": V.using(V.DETECTIONS, V.COMPONENTS) + """
SELECT image_id, comp_id, pos, (pos - 1) // 4 AS batch FROM (SELECT image_id, comp_id,
  row_number() OVER (PARTITION BY image_id ORDER BY comp_id) AS pos FROM components)""",
    "batch_layout": V.using(V.DETECTIONS, V.COMPONENTS, """b AS (SELECT *, (pos - 1) // 4 AS batch
  FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY comp_id) AS pos
    FROM components))""") + """
SELECT image_id, comp_id, CAST(coalesce(sum(w + 5) OVER (PARTITION BY image_id, batch ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS batch_x,
  CAST(sum(w) OVER (PARTITION BY image_id, batch)
    + 5 * (count(*) OVER (PARTITION BY image_id, batch) - 1) AS BIGINT) AS batch_width
FROM b""",
    "pack_limit": V.using(V.TEXT_LINES, *[_limits(s) for s in STRATEGIES]) + "\nUNION ALL ".join(
        f"SELECT image_id, pack_limit, '{s}' AS strategy FROM limits_{s}" for s in STRATEGIES
    ),
    "pack_lines": packed_lines("adaptive") + """
SELECT image_id, line_no, CAST(scaled_width AS BIGINT) AS scaled_width, char_height, pack,
  pack_limit
FROM packed_adaptive JOIN text_lines USING (image_id, line_no)
JOIN limits_adaptive USING (image_id)""",
    "pack_efficiency": packed_lines("adaptive") + f"""
SELECT image_id, lines, calls, lines / calls AS efficiency, lines - calls AS calls_saved
FROM {_efficiency('adaptive')}""",
    "strategy_sweep": packed_lines(*STRATEGIES) + """, per AS (
  SELECT strategy, avg(lines / calls) AS e, avg(calls * 10 + lines) AS t,
    sum(calls) AS c, sum(lines) AS n
  FROM (""" + " UNION ALL ".join(f"SELECT * FROM {_efficiency(s)}" for s in STRATEGIES) + """)
  GROUP BY strategy)
SELECT strategy, round(e, 6) AS avg_efficiency, round(t, 6) AS avg_time_ms,
  CAST(c AS BIGINT) AS total_calls, CAST(n AS BIGINT) AS total_lines,
  e = max(e) OVER () AS is_best FROM per""",
}
