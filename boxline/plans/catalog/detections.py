"""Queries over detections: filters, geometry, ranks and field extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.functions import geometry as G
from boxline.functions import sizing as S
from boxline.operators.metrics import detections_per_image as per_image
from boxline.operators.nearest import nearest_avatar as nearest
from boxline.operators.ordered import ranked
from boxline.operators.overlap import top_detections as top
from boxline.plans.catalog import views as V
from boxline.plans.extract import extract_fields as fields
from boxline.schemas import class_table
from boxline.functions.text import rounded


def _size():
    return F.lit(X.WIDTH), F.lit(X.HEIGHT)


def _boxes(column: str):
    """An array of boxes as text, for comparison with SQL."""
    return F.array_join(
        F.transform(column, lambda b: F.concat_ws(",", b["x1"], b["y1"], b["x2"], b["y2"])), ";"
    )


def extract_fields(spark, folder):
    found = fields(X.detections(spark, folder))
    return found.select(
        "image_id", "part",
        *[F.col(f"receiver.{c}").alias(f"name_{c}") for c in (*G.BOX, "confidence")],
        *[F.col(f"avatar.{c}").alias(f"avatar_{c}") for c in G.BOX],
        *[F.col(f"input_box.{c}").alias(f"input_{c}") for c in G.BOX],
        _boxes("contacts").alias("contacts"), _boxes("messages").alias("messages"),
    )


_BOX_LIST = "string_agg(x1 || ',' || y1 || ',' || x2 || ',' || y2, ';' ORDER BY rank)"

_EXTRACT = V.using(V.DETECTIONS, f"""kept AS (SELECT * FROM detections WHERE confidence >= 0.5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, class
  ORDER BY confidence DESC, det_id) AS rank FROM kept),
best AS (SELECT * FROM ranked WHERE rank = 1),
avatar AS (SELECT * FROM (
  SELECT a.*, n.x1 IS NULL AS lone,
    sqrt(((n.x1 + n.x2) / 2 - (a.x1 + a.x2) / 2) ** 2
      + ((n.y1 + n.y2) / 2 - (a.y1 + a.y2) / 2) ** 2) AS distance,
    row_number() OVER (PARTITION BY a.image_id ORDER BY
      ((n.x1 + n.x2) / 2 - (a.x1 + a.x2) / 2) ** 2 + ((n.y1 + n.y2) / 2 - (a.y1 + a.y2) / 2) ** 2,
      a.confidence DESC, a.det_id) AS near
  FROM kept a JOIN best n ON a.image_id = n.image_id AND n.class = 'receiver_name'
  WHERE a.class = 'receiver_avatar') WHERE near = 1 AND distance < 200),
contacts AS (SELECT image_id, {_BOX_LIST} AS contacts FROM ranked
  WHERE class = 'contact_item' AND rank <= 10 GROUP BY image_id),
messages AS (SELECT image_id, CAST((rank - 1) // 1000 AS INT) AS part, {_BOX_LIST} AS messages
  FROM ranked WHERE class = 'chat_message' GROUP BY 1, 2)""") + """
SELECT i.image_id, coalesce(m.part, 0) AS part,
  n.x1 AS name_x1, n.y1 AS name_y1, n.x2 AS name_x2, n.y2 AS name_y2,
  n.confidence AS name_confidence,
  a.x1 AS avatar_x1, a.y1 AS avatar_y1, a.x2 AS avatar_x2, a.y2 AS avatar_y2,
  b.x1 AS input_x1, b.y1 AS input_y1, b.x2 AS input_x2, b.y2 AS input_y2,
  coalesce(c.contacts, '') AS contacts, coalesce(m.messages, '') AS messages
FROM (SELECT DISTINCT image_id FROM kept) i
LEFT JOIN best n ON n.image_id = i.image_id AND n.class = 'receiver_name'
LEFT JOIN avatar a ON a.image_id = i.image_id
LEFT JOIN best b ON b.image_id = i.image_id AND b.class = 'input_box'
LEFT JOIN contacts c ON c.image_id = i.image_id
LEFT JOIN messages m ON m.image_id = i.image_id"""


def confidence_rank(spark, folder):
    kept = X.detections(spark, folder).where(F.col("confidence") >= 0.5)
    order = [F.col("confidence").desc(), F.col("det_id")]
    return ranked(kept, ["image_id", "class"], order, "rank").select(
        "image_id", "class", "det_id", "confidence", F.col("rank").cast("long").alias("rank")
    )


def class_filter(spark, folder):
    found = X.detections(spark, folder).where(F.col("confidence") >= 0.25).drop("class")
    named = found.join(F.broadcast(class_table(spark)), "class_id")
    return named.where(F.col("class").isin("chat_message", "input_box", "contact_item")).select(
        "image_id", "det_id", "class", rounded(F.col("confidence")).alias("confidence")
    )


def box_geometry(spark, folder):
    return X.detections(spark, folder).select(
        "det_id", G.width().alias("width"), G.height().alias("height"), G.area().alias("area"),
        G.center_x().alias("cx"), G.center_y().alias("cy"),
        G.whole_center_x().alias("icx"), G.whole_center_y().alias("icy"),
    )


def clamp_boxes(spark, folder):
    rows = X.detections(spark, folder)
    forms = {"o": G.clamp_ordered(*_size()), "p": G.clamp_plain(*_size()), "l": G.clamp_pixels(*_size())}
    return rows.select("det_id", *[
        value.alias(f"{form}_{name}") for form, box in forms.items() for name, value in box.items()
    ])


_CLAMP = V.using(V.DETECTIONS) + """SELECT det_id,
  greatest(0, least(800, x1)) AS o_x1, greatest(0, least(600, y1)) AS o_y1,
  greatest(greatest(0, least(800, x1)), least(800, x2)) AS o_x2,
  greatest(greatest(0, least(600, y1)), least(600, y2)) AS o_y2,
  greatest(0, least(800, x1)) AS p_x1, greatest(0, least(600, y1)) AS p_y1,
  greatest(0, least(800, x2)) AS p_x2, greatest(0, least(600, y2)) AS p_y2,
  greatest(0, least(799, x1)) AS l_x1, greatest(0, least(599, y1)) AS l_y1,
  greatest(0, least(799, x2)) AS l_x2, greatest(0, least(599, y2)) AS l_y2
FROM detections"""


def drawn_boxes(spark, folder):
    rows = X.detections(spark, folder)
    dragged = G.ordered_corners(F.col("x2"), F.col("y1"), F.col("x1"), F.col("y2"))
    quad = F.array(
        F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2")
    )
    return rows.select(
        "det_id",
        *[v.alias(f"d_{n}") for n, v in dragged.items()],
        *[v.alias(f"q_{n}") for n, v in G.padded_quad(quad, *_size()).items()],
    )


_DRAWN = V.using(V.DETECTIONS) + """SELECT det_id,
  least(x1, x2) AS d_x1, least(y1, y2) AS d_y1, greatest(x1, x2) AS d_x2,
  greatest(y1, y2) AS d_y2,
  greatest(0, least(x1, x2) - 2) AS q_x1, greatest(0, least(y1, y2) - 2) AS q_y1,
  least(800, greatest(x1, x2) + 2) AS q_x2, least(600, greatest(y1, y2) + 2) AS q_y2
FROM detections"""


def region_validity(spark, folder):
    return X.detections(spark, folder).groupBy("class").agg(
        F.count(F.lit(1)).alias("regions"), F.count_if(G.is_valid_region()).alias("valid")
    )


def resize_plan(spark, folder):
    rows = X.detections(spark, folder).where(G.is_valid_region())
    w, h = G.width(), G.height()
    return rows.select(
        "det_id",
        F.round(S.batch_scale(h), 6).alias("scale"),
        S.recognition_size(w, h)["w"].alias("rec_w"),
        S.detection_size(w, h)["w"].alias("fast_w"), S.detection_size(w, h)["h"].alias("fast_h"),
        S.detection_size(w, h, fast=False)["w"].alias("full_w"),
        S.detection_size(w, h, fast=False)["h"].alias("full_h"),
        S.estimated_chars(w, h).alias("chars"),
    )


def _det_side(side: str, fast: bool) -> str:
    ratio = "CASE WHEN greatest(w, h) > 640 THEN 640.0::DOUBLE / greatest(w, h)"
    if fast:
        ratio += (
            " WHEN least(w, h) < 320 THEN 320.0::DOUBLE / least(w, h)"
            " WHEN greatest(w, h) > 480 THEN 0.8::DOUBLE"
        )
    ratio += " ELSE 1.0::DOUBLE END"
    value = f"CAST(ceil(trunc({side} * ({ratio})) / 32) * 32 AS INT)"
    return f"least({value}, 640)" if fast else value


_RESIZE = V.using(V.DETECTIONS, """sized AS (SELECT det_id, x2 - x1 AS w, y2 - y1 AS h
  FROM detections WHERE x2 > x1 AND y2 > y1 AND x1 >= 0 AND y1 >= 0)""") + f"""
SELECT det_id,
  round(CASE WHEN h < 20 THEN 48.0::DOUBLE / h WHEN h < 35 THEN least(48.0::DOUBLE / h, 1.5)
    ELSE least(48.0::DOUBLE / h, 1.0) END, 6) AS scale,
  greatest(16, least(320, CAST(trunc(w * (48.0::DOUBLE / h)) AS INT))) AS rec_w,
  {_det_side('w', True)} AS fast_w, {_det_side('h', True)} AS fast_h,
  {_det_side('w', False)} AS full_w, {_det_side('h', False)} AS full_h,
  greatest(1, CAST(trunc(w / (h * 0.8::DOUBLE)) AS INT)) AS chars
FROM sized"""


def height_buckets(spark, folder):
    rows = X.detections(spark, folder).where(G.is_valid_region())
    return rows.withColumn("bucket", S.height_bucket(G.height())).groupBy("class", "bucket").agg(
        F.count(F.lit(1)).alias("n")
    )


def nearest_avatar(spark, folder):
    found = nearest(X.detections(spark, folder))
    return found.select(
        "image_id", F.col("name.det_id").alias("name_id"), F.col("avatar.det_id").alias("avatar_id"),
        F.round("avatar.distance", 6).alias("distance"),
    )


_NEAREST = V.using(V.DETECTIONS) + """
SELECT image_id, name_id, avatar_id, round(distance, 6) AS distance FROM (
  SELECT a.image_id, n.det_id AS name_id, a.det_id AS avatar_id,
    sqrt(((n.x1 + n.x2) / 2 - (a.x1 + a.x2) / 2) ** 2
      + ((n.y1 + n.y2) / 2 - (a.y1 + a.y2) / 2) ** 2) AS distance,
    row_number() OVER (PARTITION BY a.image_id ORDER BY
      ((n.x1 + n.x2) / 2 - (a.x1 + a.x2) / 2) ** 2 + ((n.y1 + n.y2) / 2 - (a.y1 + a.y2) / 2) ** 2,
      a.confidence DESC, a.det_id) AS near
  FROM detections a JOIN (SELECT *, row_number() OVER (PARTITION BY image_id
      ORDER BY confidence DESC, det_id) AS rank FROM detections WHERE class = 'receiver_name') n
    ON a.image_id = n.image_id AND n.rank = 1
  WHERE a.class = 'receiver_avatar') WHERE near = 1 AND distance < 200"""


def top_detections(spark, folder):
    return top(X.detections(spark, folder)).select(
        "image_id", "det_id", F.col("rank").cast("long").alias("rank")
    )


def detections_per_image(spark, folder):
    return per_image(X.images(spark, folder), X.detections(spark, folder)).withColumn(
        "avg_detections", F.round("avg_detections", 6)
    )


QUERIES = {f.__name__: f for f in (
    extract_fields, confidence_rank, class_filter, box_geometry, clamp_boxes, drawn_boxes,
    region_validity, resize_plan, height_buckets, nearest_avatar, top_detections,
    detections_per_image,
)}

SQL = {
    "extract_fields": _EXTRACT,
    "confidence_rank": V.using(V.DETECTIONS) + """
SELECT image_id, class, det_id, confidence, row_number() OVER (
  PARTITION BY image_id, class ORDER BY confidence DESC, det_id) AS rank
FROM detections WHERE confidence >= 0.5""",
    "class_filter": V.using(V.DETECTIONS) + """
SELECT image_id, det_id, class, confidence FROM detections
WHERE confidence >= 0.25 AND class IN ('chat_message', 'input_box', 'contact_item')""",
    "box_geometry": V.using(V.DETECTIONS) + """
SELECT det_id, x2 - x1 AS width, y2 - y1 AS height,
  CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
  CAST(floor((x1 + x2) / 2) AS INT) AS icx, CAST(floor((y1 + y2) / 2) AS INT) AS icy
FROM detections""",
    "clamp_boxes": _CLAMP,
    "drawn_boxes": _DRAWN,
    "region_validity": V.using(V.DETECTIONS) + """
SELECT class, count(*) AS regions,
  count(*) FILTER (x2 > x1 AND y2 > y1 AND x1 >= 0 AND y1 >= 0) AS valid
FROM detections GROUP BY class""",
    "resize_plan": _RESIZE,
    "height_buckets": V.using(V.DETECTIONS) + """
SELECT class, CASE WHEN y2 - y1 < 20 THEN 'small' WHEN y2 - y1 < 35 THEN 'medium'
    WHEN y2 - y1 < 100 THEN 'large' END AS bucket, count(*) AS n
FROM detections WHERE x2 > x1 AND y2 > y1 AND x1 >= 0 AND y1 >= 0 GROUP BY 1, 2""",
    "nearest_avatar": _NEAREST,
    "top_detections": V.using(V.DETECTIONS) + """
SELECT image_id, det_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id
  ORDER BY confidence DESC, det_id) AS rank FROM detections) WHERE rank <= 300""",
    "detections_per_image": V.using(V.DETECTIONS, V.IMAGES) + """
SELECT count(*) AS n_images, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_detections,
  round(avg(coalesce(n, 0)), 6) AS avg_detections
FROM images LEFT JOIN (SELECT image_id, count(*) AS n FROM detections GROUP BY image_id)
  USING (image_id)""",
}
