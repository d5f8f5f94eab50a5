"""Queries over profiles and components: text lines and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.functions import geometry as G
from boxline.functions.sizing import is_line_component, is_text_component
from boxline.operators import lines as L
from boxline.plans import page_text as P
from boxline.plans.catalog import views as V


def smooth_profile(spark, folder):
    return L.smooth_profile(X.profiles(spark, folder), 5).select(
        "image_id", "y", F.round("smoothed", 6).alias("smoothed")
    )


def line_runs(spark, folder):
    return L.projection_runs(X.profiles(spark, folder)).withColumn(
        "mean_ink", F.round("mean_ink", 4)
    )


def adaptive_line_runs(spark, folder):
    rows = X.profiles(spark, folder).withColumn("char_height", F.lit(14))
    return L.adaptive_runs(rows).drop("char_height").withColumn(
        "mean_ink", F.round("mean_ink", 4)
    )


def line_descriptions(spark, folder):
    described = L.describe_lines(_short_runs(spark, folder), F.lit(200))
    return described.select(
        "image_id", "start", "center_y", "height",
        *[F.round(c, 8).alias(c) for c in ("confidence", "ink_ratio")],
    )


def line_infos(spark, folder):
    rows = X.profiles(spark, folder)
    runs = L.adaptive_runs(rows.withColumn("char_height", F.lit(14))).withColumns({
        "char_height": F.lit(40), "effective_width": F.col("mean_ink").cast("int"),
    })
    return L.line_infos(runs, F.lit(700), F.lit(100)).select(
        "image_id", "y1", "y2", "estimated_chars", F.round("confidence", 5).alias("confidence")
    )


def line_numbers(spark, folder):
    lines = _region_lines(spark, folder)
    return L.number_lines(lines, ["image_id", "det_id"], ["y1", "y2"]).select(
        "image_id", "det_id", "line_no", "region_id", "y1"
    )


def _short_runs(spark, folder):
    return L.projection_runs(X.profiles(spark, folder), min_height=1, kernel=3)


def merge_close_lines(spark, folder):
    return L.merge_close(_short_runs(spark, folder), F.lit(3))


def component_lines(spark, folder):
    return L.component_lines(X.components(spark, folder)).select(
        "image_id", "x1", "y1", "x2", "y2", "n_components", "center_y", "height",
        F.round("confidence", 6).alias("confidence"),
    )


def component_filters(spark, folder):
    return X.components(spark, folder).groupBy("h").agg(
        F.count_if(is_text_component()).alias("structure"),
        F.count_if(is_line_component()).alias("splitter"),
    )


def text_structure(spark, folder):
    return L.text_structure(X.components(spark, folder), X.images(spark, folder)).withColumn(
        "height_distribution", F.array_join("height_distribution", ",")
    )


def profile_widths(spark, folder):
    return L.profile_widths(
        X.profiles(spark, folder), ["image_id"], F.lit(400), position="y"
    )


def reading_order(spark, folder):
    rows = X.detections(spark, folder).withColumns({"cy": G.center_y(), "cx": G.center_x()})
    return P.reading_order(rows).select(
        "image_id", "det_id", F.col("reading_no").cast("long").alias("reading_no")
    )


def hybrid_lines(spark, folder):
    parts = X.components(spark, folder)
    profiles = X.profiles(spark, folder)
    docs = X.table(spark, folder, "documents")
    density = F.col("n_chars") % 40 / 100.0
    images = docs.select(F.col("doc_id").alias("image_id"), density.alias("edge_density"))
    return P.hybrid_lines(images, profiles, parts, min_height=3)


def region_lines(spark, folder):
    return _region_lines(spark, folder)


def _region_lines(spark, folder):
    """Each document is an image with one region; its lines are found inside the region."""
    regions = X.table(spark, folder, "documents").select(
        F.col("doc_id").alias("image_id"), (F.col("doc_id") + 1).alias("det_id"),
        F.when(F.col("lang") == "en", "chat_area").otherwise("button_area").alias("class"),
        F.lit(20).alias("x1"), F.lit(40).alias("y1"), F.lit(320).alias("x2"), F.lit(900).alias("y2"),
    )
    profiles = X.profiles(spark, folder).withColumn("det_id", F.col("image_id") + 1)
    return P.region_lines(regions, profiles, min_height=3)


def shifted_lines(spark, folder):
    lines = L.projection_runs(X.profiles(spark, folder), min_height=3).select(
        "image_id", F.lit(0).alias("x1"), F.col("start").alias("y1"), F.lit(300).alias("x2"),
        F.col("end").alias("y2"),
    )
    regions = X.table(spark, folder, "documents").select(
        F.col("doc_id").alias("image_id"), (F.col("n_chars") % 100).cast("int").alias("x1"),
        (F.col("n_chars") % 50).cast("int").alias("y1"),
    )
    return L.to_image_boxes(lines, regions, ["image_id"])


QUERIES = {f.__name__: f for f in (
    smooth_profile, line_runs, adaptive_line_runs, merge_close_lines, component_lines,
    component_filters, text_structure, profile_widths, reading_order, hybrid_lines, region_lines,
    shifted_lines, line_descriptions, line_infos, line_numbers,
)}


def _runs(kernel: int, least: int, name: str = "runs", source: str = "profiles",
          keys: str = "image_id") -> str:
    half = kernel // 2
    return f"""{name}_s AS (SELECT {keys}, y, sum(ink) OVER (PARTITION BY {keys} ORDER BY y
    ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) / {kernel} AS sm FROM {source}),
{name}_a AS (SELECT *, sm > 0.3 * avg(sm) OVER (PARTITION BY {keys}) AS above FROM {name}_s),
{name}_i AS (SELECT *, y - row_number() OVER (PARTITION BY {keys} ORDER BY y) AS island
  FROM {name}_a WHERE above),
{name} AS (SELECT {keys}, min(y) AS start, max(y) + 1 AS "end", avg(sm) AS mean_ink
  FROM {name}_i GROUP BY {keys}, island HAVING max(y) + 1 - min(y) >= {least})"""


def _merged(source: str, near: str, name: str = "merged") -> str:
    return f"""{name}_b AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY image_id
    ORDER BY start, "end") {near} THEN 0 ELSE 1 END AS brk FROM {source}),
{name}_i AS (SELECT *, sum(brk) OVER (PARTITION BY image_id ORDER BY start, "end"
    ROWS UNBOUNDED PRECEDING) AS island FROM {name}_b),
{name} AS (SELECT image_id, min(start) AS start, arg_max("end", (start, "end")) AS "end",
    count(*) AS n_merged FROM {name}_i GROUP BY image_id, island)"""


def _clusters(least: int, source: str = "components") -> str:
    return f"""brk AS (SELECT *, CASE WHEN abs(cy - lag(cy) OVER o) <= 0.5 * greatest(h, lag(h) OVER o)
    THEN 0 ELSE 1 END AS brk FROM {source}
    WINDOW o AS (PARTITION BY image_id ORDER BY cy, comp_id)),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY image_id ORDER BY cy, comp_id
    ROWS UNBOUNDED PRECEDING) AS line FROM brk),
clusters AS (SELECT image_id, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2,
    count(*) AS n_components, sum(area) AS area FROM numbered GROUP BY image_id, line
  HAVING max(y + h) - min(y) >= {least})"""


_MEANS = """level AS (SELECT image_id,
    greatest(1, CAST(trunc(avg(ink) FILTER (ink > 0) * 0.1) AS INT)) AS level
  FROM profiles GROUP BY image_id)"""

_REGION_RUNS = V.using(
    V.PROFILES,
    """regions AS (SELECT doc_id AS image_id, doc_id + 1 AS det_id FROM documents
  WHERE lang = 'en')""",
    "own AS (SELECT p.*, det_id FROM profiles p JOIN regions USING (image_id))",
    _runs(3, 3, source="own", keys="image_id, det_id"),
)

SQL = {
    "line_descriptions": V.using(V.PROFILES, _runs(3, 1)) + """
SELECT image_id, start, CAST(floor((start + "end") / 2) AS INT) AS center_y,
  "end" - start AS height, round(least(1.0, mean_ink), 8) AS confidence,
  round(mean_ink / 200, 8) AS ink_ratio FROM runs""",
    "line_infos": V.using(V.PROFILES, _MEANS, """r AS (SELECT image_id, min(y) AS start,
    max(y) + 1 AS "end", avg(ink) AS mean_ink
  FROM (SELECT image_id, y, ink, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS island
    FROM profiles JOIN level USING (image_id) WHERE ink > level)
  GROUP BY image_id, island HAVING max(y) + 1 - min(y) >= 8)""") + """
SELECT image_id, CAST(greatest(0, start - 5) AS INT) AS y1, CAST(least(100, "end" + 5) AS INT) AS y2,
  greatest(1, CAST(trunc(trunc(mean_ink) / (40 * 0.8::DOUBLE)) AS INT)) AS estimated_chars,
  round(least(1.0, mean_ink / 700), 5) AS confidence
FROM r WHERE trunc(mean_ink) >= 40 AND mean_ink / 700 >= 0.01""",
    "line_numbers": _REGION_RUNS + """
SELECT image_id, det_id, n AS line_no, 'chat_area_' || (n + 1) AS region_id, CAST(40 + start AS INT) AS y1
FROM (SELECT *, row_number() OVER (PARTITION BY image_id, det_id ORDER BY start) - 1 AS n
  FROM runs)""",
    "smooth_profile": V.using(V.PROFILES) + """
SELECT image_id, y, round(sum(ink) OVER (PARTITION BY image_id ORDER BY y
  ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smoothed FROM profiles""",
    "line_runs": V.using(V.PROFILES, _runs(5, 15)) + """
SELECT image_id, start, "end", round(mean_ink, 4) AS mean_ink FROM runs""",
    "adaptive_line_runs": V.using(V.PROFILES, _MEANS) + """
SELECT image_id, min(y) AS start, max(y) + 1 AS "end", round(avg(ink), 4) AS mean_ink
FROM (SELECT image_id, y, ink, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS island
  FROM profiles JOIN level USING (image_id) WHERE ink > level)
GROUP BY image_id, island HAVING max(y) + 1 - min(y) >= 8""",
    "merge_close_lines": V.using(V.PROFILES, _runs(3, 1), _merged("runs", "<= 3")) + """
SELECT * FROM merged""",
    "component_lines": V.using(V.DETECTIONS, V.COMPONENTS, _clusters(15)) + """
SELECT image_id, x1, y1, x2, y2, n_components, CAST(floor((y1 + y2) / 2) AS INT) AS center_y,
  y2 - y1 AS height,
  round(least(1.0, CAST(area AS DOUBLE) / ((x2 - x1) * (y2 - y1)) * (n_components / 10)), 6)
    AS confidence
FROM clusters""",
    "component_filters": V.using(V.DETECTIONS, V.COMPONENTS) + """
SELECT h, count(*) FILTER (area > 20 AND h > 5 AND w > 3 AND h > w * 0.1 AND h < w * 10)
    AS structure,
  count(*) FILTER (h >= 8 AND w >= 3 AND area >= 20) AS splitter
FROM components GROUP BY h""",
    "text_structure": V.using(V.DETECTIONS, V.COMPONENTS, V.IMAGES, """used AS (
  SELECT * FROM components WHERE area > 20 AND h > 5 AND w > 3 AND h > w * 0.1 AND h < w * 10),
stats AS (SELECT image_id, count(*) AS n, CAST(trunc(median(h)) AS INT) AS ch,
    CAST(trunc(stddev_pop(h)) AS INT) AS sd, min(h) AS lo, max(h) AS hi
  FROM used GROUP BY image_id),
binned AS (SELECT image_id, least(9, CAST(floor((h - CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END)
    / CASE WHEN lo = hi THEN 0.1 ELSE (hi - lo) / 10 END) AS INT)) AS bin
  FROM used JOIN stats USING (image_id)),
bins AS (SELECT image_id, concat_ws(',', """ + ", ".join(
        f"count(*) FILTER (bin = {i})" for i in range(10)
    ) + """) AS height_distribution FROM binned GROUP BY image_id)""") + """
SELECT image_id, coalesce(ch, 20) AS char_height, sd AS char_height_std,
  coalesce(CAST(trunc(ch * 1.2::DOUBLE) AS INT), 30) AS line_height,
  CASE WHEN ch IS NULL THEN 10 ELSE greatest(5, CAST(trunc(ch * 0.3::DOUBLE) AS INT)) END
    AS line_spacing,
  coalesce(n, 0) AS num_chars, height_distribution
FROM images LEFT JOIN stats USING (image_id) LEFT JOIN bins USING (image_id)""",
    "profile_widths": V.using(V.PROFILES, """ends AS (SELECT image_id,
    min(y) FILTER (ink > 0) AS a, max(y) FILTER (ink > 0) AS b, count(*) FILTER (ink > 0) AS n
  FROM profiles GROUP BY image_id)""") + """
SELECT image_id,
  CASE WHEN n > 0 THEN least(b - a + 21, 400) ELSE 400 END AS span_width,
  CASE WHEN n > 0 THEN least(n + 20, 400) ELSE 400 END AS compact_width,
  CASE WHEN n > 0 THEN least(CASE WHEN (b - a + 1 - n) / (b - a + 1) > 0.3
    THEN CAST(trunc(n * 1.2::DOUBLE) AS INT) ELSE b - a + 1 END + 20, 400) ELSE 400 END
    AS adaptive_width
FROM ends""",
    "reading_order": V.using(V.DETECTIONS) + """
SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id
  ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, det_id) AS reading_no FROM detections""",
    "hybrid_lines": V.using(
        V.DETECTIONS, V.COMPONENTS, V.PROFILES,
        "chosen AS (SELECT doc_id AS image_id, n_chars % 40 < 10 AS simple FROM documents)",
        "own AS (SELECT p.* FROM profiles p JOIN chosen USING (image_id) WHERE simple)",
        "parts AS (SELECT c.* FROM components c JOIN chosen USING (image_id) WHERE NOT simple)",
        _runs(3, 3, source="own"), _clusters(3, "parts"),
        """found AS (SELECT image_id, start, "end" FROM runs
  UNION ALL SELECT image_id, y1, y2 FROM clusters)""",
        _merged("found", "< 5"),
    ) + "SELECT * FROM merged",
    "region_lines": _REGION_RUNS + """
SELECT image_id, det_id, 'chat_area' AS class, 20 AS x1, CAST(40 + start AS INT) AS y1,
  320 AS x2, CAST(40 + "end" AS INT) AS y2 FROM runs""",
    "shifted_lines": V.using(V.PROFILES, _runs(3, 3)) + """
SELECT image_id, CAST(n_chars % 100 AS INT) AS x1, CAST(start + n_chars % 50 AS INT) AS y1,
  CAST(300 + n_chars % 100 AS INT) AS x2, CAST("end" + n_chars % 50 AS INT) AS y2
FROM runs JOIN documents ON image_id = doc_id""",
}
