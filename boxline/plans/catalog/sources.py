"""Queries over label texts, dictionaries, image sizes and results joined by region."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.functions import geometry as G
from boxline.functions import text as T
from boxline.operators import recognition as R
from boxline.operators import reuse
from boxline.operators.overlap import top_detections as top
from boxline.plans import extract
from boxline.plans.catalog import views as V
from boxline.sources import labels as L


def _text(column: str):
    return F.col(column).cast("string")


def label_lines(spark, folder):
    """Label lines of all detections, some with a class that is no number."""
    rows = X.detections(spark, folder).select(
        _text("image_id").alias("image_stem"), F.col("det_id").alias("line_no"),
        F.concat_ws(
            " ", F.when(F.col("det_id") % 11 == 0, "x").otherwise(_text("class_id")),
            _text("x1"), _text("y1"), _text("x2"), _text("y2"),
        ).alias("line"),
    )
    return L.parse_label_lines(rows)


def label_objects(spark, folder):
    """Objects of one JSON text per detection."""
    rows = X.detections(spark, folder).select(
        F.concat_ws("-", "image_id", "det_id").alias("image_stem"),
        F.to_json(F.struct(F.array(F.struct(
            "class", F.array(*G.BOX).alias("bbox"), "confidence"
        )).alias("objects"))).alias("value"),
    )
    return L.parse_label_json(rows).select(
        "image_stem", "class", F.array_join("bbox", ",").alias("bbox"), "confidence"
    )


def image_validity(spark, folder):
    """Pages as images: the URL gives the width, the markup the height."""
    return X.table(spark, folder, "pages").select(
        "page_id", G.is_valid_image(F.length("url"), F.length("html")).alias("is_valid")
    )


def character_classes(spark, folder):
    """A dictionary of all characters of documents, the frequent ones first; white space doesn't count."""
    letters = X.table(spark, folder, "documents").select(F.explode(F.split("text", "")).alias("char"))
    # One row per character of a script after counting.
    counted = letters.groupBy("char").agg(F.count(F.lit(1)).alias("n"))
    return L.character_dictionary(counted.select("char", F.struct(-F.col("n"), F.col("char")).alias("pos")))


def attached_results(spark, folder):
    """Lines with the results of long lines, by region."""
    lines = X.text_lines(spark, folder)
    results = lines.where(F.length("line") > 40).select(
        "image_id", "line_no", F.md5("line").alias("text"),
        T.preview(F.col("line")).alias("preview"),
    )
    return R.attach_results(lines.select("image_id", "line_no"), results, ["image_id", "line_no"])


def added_texts(spark, folder):
    """Known texts of event types, of which some are replaced and one is new."""
    events = X.table(spark, folder, "events").select(F.col("event_type").alias("hash")).distinct()
    known = events.select("hash", F.upper("hash").alias("text"))
    added = events.where(F.length("hash") > 5).select("hash", F.reverse("hash").alias("text"))
    return reuse.with_added(known, added, "hash")


def top_crowded(spark, folder):
    """The 300 best detections of ten crowded images, so that the limit is reached."""
    crowded = X.detections(spark, folder).withColumn("image_id", F.col("image_id") % 10)
    return top(crowded).select("image_id", "det_id", "rank")


def message_rows(spark, folder):
    return extract.message_rows(X.detections(spark, folder)).select(
        "image_id", "rank", "det_id", "confidence"
    )


def image_fields(spark, folder):
    return extract.image_fields(X.detections(spark, folder)).select(
        "image_id", F.col("receiver.det_id").alias("receiver"),
        F.col("input_box.det_id").alias("input_box"), F.size("contacts").alias("contacts"),
    )


QUERIES = {f.__name__: f for f in (
    label_lines, label_objects, image_validity, character_classes, attached_results, added_texts,
    top_crowded, message_rows, image_fields,
)}

SQL = {
    "label_lines": V.using(V.DETECTIONS) + """
SELECT CAST(image_id AS VARCHAR) AS image_stem, det_id AS line_no,
  CASE WHEN det_id % 11 <> 0 THEN class_id END AS class_id, CAST(x1 AS DOUBLE) AS cx,
  CAST(y1 AS DOUBLE) AS cy, CAST(x2 AS DOUBLE) AS w, CAST(y2 AS DOUBLE) AS h FROM detections""",
    "label_objects": V.using(V.DETECTIONS) + """
SELECT image_id || '-' || det_id AS image_stem, class, x1 || ',' || y1 || ',' || x2 || ',' || y2 AS bbox,
  confidence FROM detections""",
    "image_validity": """
SELECT page_id, coalesce(length(url) BETWEEN 8 AND 4096 AND length(html) BETWEEN 8 AND 4096, false)
  AS is_valid FROM pages""",
    "character_classes": r"""WITH l AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS char FROM documents),
  n AS (SELECT char, count(*) AS n FROM l WHERE unicode(char) NOT IN (9, 10, 11, 12, 13, 32, 133, 160, 5760, 8232,
      8233, 8239, 8287, 12288) AND unicode(char) NOT BETWEEN 8192 AND 8202 GROUP BY char),
  c AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, char) AS INT) AS class_idx, char FROM n)
SELECT * FROM c UNION ALL SELECT 0, '<blank>' UNION ALL SELECT coalesce(max(class_idx), 0) + 1, ' ' FROM c""",
    "attached_results": V.using(V.TEXT_LINES) + """
SELECT image_id, line_no, CASE WHEN length(line) > 40 THEN md5(line) END AS text,
  CASE WHEN length(line) > 40 THEN line[1:30] END AS preview FROM text_lines""",
    "added_texts": """
SELECT DISTINCT event_type AS hash, CASE WHEN length(event_type) > 5 THEN reverse(event_type)
  ELSE upper(event_type) END AS text FROM events""",
    "top_crowded": V.using(V.DETECTIONS) + """
SELECT image_id % 10 AS image_id, det_id, row_number() OVER (
  PARTITION BY image_id % 10 ORDER BY confidence DESC, det_id) AS rank
FROM detections QUALIFY rank <= 300""",
    "message_rows": V.using(V.DETECTIONS) + """
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_id) AS rank,
  det_id, confidence FROM detections WHERE class = 'chat_message' AND confidence >= 0.5""",
    "image_fields": V.using(V.DETECTIONS) + """
SELECT image_id,
  max_by(det_id, (confidence, -det_id)) FILTER (class = 'receiver_name') AS receiver,
  max_by(det_id, (confidence, -det_id)) FILTER (class = 'input_box') AS input_box,
  CAST(least(10, count(*) FILTER (class = 'contact_item')) AS INT) AS contacts
FROM detections WHERE confidence >= 0.5 GROUP BY image_id""",
}
