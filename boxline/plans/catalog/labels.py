"""Queries over labels: quality, corrections, responses, datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.functions import text as T
from boxline.operators import quality as Q
from boxline.plans import dataset as D
from boxline.plans.autolabel import encode_yolo, label_dataset, parse_responses, response_boxes
from boxline.plans.catalog import views as V
from boxline.sources.images import plain_base64
from boxline.sources.labels import label_file_validity as validity


def _size():
    return F.lit(X.WIDTH), F.lit(X.HEIGHT)


def box_issues(spark, folder):
    found = Q.box_issues(X.detections(spark, folder), *_size())
    return found.where(F.size("issues") > 0).select(
        "image_id", "det_id", F.array_join("issues", ",").alias("issues")
    )


def class_distribution(spark, folder):
    return Q.class_distribution(X.detections(spark, folder))


def duplicate_unique(spark, folder):
    return Q.duplicate_unique(X.detections(spark, folder))


def missing_required(spark, folder):
    return Q.missing_required(X.images(spark, folder), X.detections(spark, folder))


def area_stats(spark, folder):
    return Q.area_stats(X.detections(spark, folder)).withColumns({
        "avg_area": F.round("avg_area", 4), "area_std": F.round("area_std", 4),
    })


def needs_review(spark, folder):
    return Q.needs_review(X.images(spark, folder), X.detections(spark, folder))


def recommendations(spark, folder):
    return Q.recommendations(X.images(spark, folder), X.detections(spark, folder))


def validation_report(spark, folder):
    report = Q.validation_report(X.images(spark, folder), X.detections(spark, folder), *_size())
    entries = F.array_sort(F.map_entries("class_distribution"))
    return report.select(
        F.col("image_info.image_id").alias("image_id"),
        F.col("image_info.size").alias("size"),
        F.col("image_info.total_labels").alias("total_labels"),
        F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
        .alias("classes"),
        F.array_join(
            F.transform("potential_issues", lambda i: F.concat_ws(":", i["type"], i["class"])), ","
        ).alias("issues"),
        F.col("statistics.max_area").alias("max_area"),
        F.array_join("recommendations", ",").alias("advice"),
    )


def batch_summary(spark, folder):
    labels = X.detections(spark, folder)
    labelled = labels.select("image_id").distinct()
    images = X.images(spark, folder)
    # Images without any label have no label file: they count as failed.
    failed = images.join(labelled, "image_id", "left_anti")
    return Q.batch_summary(Q.needs_review(labelled, labels), failed)


def _diff(spark, folder):
    labels = X.detections(spark, folder)
    return Q.label_diff(labels, X.corrected_labels(labels))


def label_diff(spark, folder):
    return _diff(spark, folder)


def corrections(spark, folder):
    return Q.corrections(_diff(spark, folder)).withColumn(
        "corrected_classes", F.array_join("corrected_classes", ",")
    )


def session_statistics(spark, folder):
    return Q.session_statistics(_diff(spark, folder))


def class_accuracy(spark, folder):
    return Q.class_accuracy(_diff(spark, folder))


def spec_violations(spark, folder):
    labels = X.detections(spark, folder).withColumn("seq", F.col("det_id"))
    return Q.spec_violations(labels, *_size()).select(
        "image_id", "det_id", "outside", "out_of_order", "unknown_class"
    )


def new_classes(spark, folder):
    labels = X.detections(spark, folder)
    sure = labels.where(F.col("class") != "user_avatar")
    return D.new_classes(sure, X.corrected_labels(sure))


def yolo_encode(spark, folder):
    return encode_yolo(X.detections(spark, folder), *_size()).select("image_id", "det_id", "line")


_YOLO = """clamped AS (SELECT {keys}, class_id, greatest(0, least(800, x1)) AS x1,
  greatest(0, least(600, y1)) AS y1,
  greatest(greatest(0, least(800, x1)), least(800, x2)) AS x2,
  greatest(greatest(0, least(600, y1)), least(600, y2)) AS y2 FROM {source})"""
_YOLO_LINE = """printf('%d %.6f %.6f %.6f %.6f', class_id, (x1 + x2) / 2 / 800,
  (y1 + y2) / 2 / 600, (x2 - x1) / 800, (y2 - y1) / 600)"""
_YOLO_KEPT = "(x2 - x1) / 800 > 0.01 AND (y2 - y1) / 600 > 0.01"


def parsed_responses(spark, folder):
    parsed = parse_responses(X.responses(spark, folder))
    return response_boxes(parsed, ["image_id", "det_id", "outcome"]).drop("width", "height")


_PARSED = V.using(V.DETECTIONS, V.RESPONSES, """objects AS (
  SELECT image_id, det_id, 'json' AS outcome,
    unnest(regexp_extract_all(response, '"class": "(\\w+)"', 1)) AS class,
    unnest(regexp_extract_all(response, '\\[(-?\\d+), (-?\\d+), (-?\\d+), (-?\\d+)\\]', 0)) AS box,
    unnest(range(0, 2)) AS seq
  FROM responses WHERE contains(response, '"objects"')
  UNION ALL
  SELECT * FROM (SELECT image_id, det_id, 'pattern' AS outcome, c[i] AS class, b[i] AS box,
      count(*) FILTER (c[i] <> 'unknown_part') OVER (PARTITION BY det_id, image_id ORDER BY i) - 1
        AS seq
    FROM (SELECT image_id, det_id,
        regexp_extract_all(response, '(\\w+): \\[(\\d+), (\\d+), (\\d+), (\\d+)\\]', 1) AS c,
        regexp_extract_all(response, '\\w+: (\\[\\d+, \\d+, \\d+, \\d+\\])', 1) AS b
      FROM responses WHERE NOT contains(response, '"objects"')),
    LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)) WHERE class <> 'unknown_part'),
boxes AS (SELECT image_id, det_id, outcome, CAST(seq AS INT) AS seq, class,
  CAST(string_split(trim(box, '[]'), ', ') AS INT[]) AS b FROM objects)""")


def response_labels(spark, folder):
    lines, _ = label_dataset(X.responses(spark, folder), ["image_id", "det_id"])
    return lines.select("image_id", "det_id", "seq", "line")


def response_outcomes(spark, folder):
    return label_dataset(X.responses(spark, folder), ["image_id", "det_id"])[1]


def _label_file_lines(spark, folder):
    """Label lines written without clamping, so that boxes outside the image spoil their file."""
    rows = X.detections(spark, folder)
    wide, high = _size()
    share = [(F.col("x1") + F.col("x2")) / 2 / wide, (F.col("y1") + F.col("y2")) / 2 / high,
             (F.col("x2") - F.col("x1")) / wide, (F.col("y2") - F.col("y1")) / high]
    return rows.select(
        F.col("image_id").cast("string").alias("image_stem"),
        F.format_string("%d %.6f %.6f %.6f %.6f", F.col("class_id"), *share).alias("line"),
    )


def label_file_validity(spark, folder):
    return validity(_label_file_lines(spark, folder))


_VALID = """validity AS (SELECT CAST(image_id AS VARCHAR) AS image_stem, count(*) AS n_lines,
  bool_and(round((x1 + x2) / 2 / 800, 6) BETWEEN 0 AND 1
    AND round((y1 + y2) / 2 / 600, 6) BETWEEN 0 AND 1
    AND round((x2 - x1) / 800, 6) BETWEEN 0 AND 1 AND round((y2 - y1) / 600, 6) BETWEEN 0 AND 1)
    AS is_valid
  FROM detections GROUP BY image_id)"""
_SHARE = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) / 4294967296.0"
_SPLIT = f"""CASE WHEN {_SHARE} < {{1}} THEN 'train' WHEN {_SHARE} < {{2}} THEN 'val'
  ELSE 'test' END"""


def training_manifest(spark, folder):
    images = X.images(spark, folder).select(F.col("image_id").cast("string").alias("image_stem"))
    return D.prepare_dataset(images, validity(_label_file_lines(spark, folder)))


def dataset_split(spark, folder):
    docs = X.table(spark, folder, "documents")
    stem = F.col("doc_id").cast("string")
    return docs.select("doc_id", D.split_of(stem, 0.8, 0.15).alias("split"))


def pairing_left(spark, folder):
    images = X.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("image_stem"), "lang"
    )
    labels = X.table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("image_stem"), "quality"
    )
    return D.pair_all(images, labels)


def unlabelled_report(spark, folder):
    images = X.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("image_stem"), "source"
    )
    labels = X.table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("image_stem")
    )
    return D.unlabelled(images, labels)


def request_table(spark, folder):
    return X.table(spark, folder, "pages").select(
        "page_id", plain_base64(F.encode("html", "utf-8")).alias("content_base64")
    )


def file_names(spark, folder):
    return X.table(spark, folder, "pages").select(
        "page_id", T.stem(F.col("url")).alias("stem"), T.base_name(F.col("url")).alias("name"),
        T.ending(F.col("url")).alias("ending"),
    )


QUERIES = {f.__name__: f for f in (
    box_issues, class_distribution, duplicate_unique, missing_required, area_stats, needs_review,
    recommendations, validation_report, batch_summary, label_diff, corrections,
    session_statistics, class_accuracy, spec_violations, new_classes, yolo_encode,
    parsed_responses, response_labels, response_outcomes, label_file_validity, training_manifest,
    dataset_split, pairing_left, unlabelled_report, request_table, file_names,
)}

_UNIQUE = "('receiver_name', 'receiver_avatar', 'input_box', 'send_button')"
_DUPLICATES = f"""duplicates AS (SELECT image_id, class, count(*) AS n FROM detections
  WHERE class IN {_UNIQUE} GROUP BY image_id, class HAVING count(*) > 1)"""
_MISSING = """missing AS (SELECT i.image_id, r.class FROM images i,
    (VALUES ('receiver_name'), ('input_box')) r(class)
  WHERE NOT EXISTS (SELECT 1 FROM detections d WHERE d.image_id = i.image_id
    AND d.class = r.class))"""
_DIFF = """diff AS (SELECT image_id, class, x1, y1, x2, y2, least(o, c) AS kept,
    greatest(c - o, 0) AS added, greatest(o - c, 0) AS removed
  FROM (SELECT image_id, class, x1, y1, x2, y2, CAST(sum(o) AS BIGINT) AS o,
      CAST(sum(c) AS BIGINT) AS c
    FROM (SELECT image_id, class, x1, y1, x2, y2, 1 AS o, 0 AS c FROM detections
      UNION ALL SELECT image_id, class, x1, y1, x2, y2, 0, 1 FROM corrected)
    GROUP BY ALL))"""
_CORRECTIONS = """corrections AS (SELECT image_id, sum(changed) > 0 AS corrected,
    coalesce(string_agg(class, ',' ORDER BY class) FILTER (before = 0 AND after > 0), '')
      AS corrected_classes
  FROM (SELECT image_id, class, sum(kept + removed) AS before, sum(kept + added) AS after,
      sum(added + removed) AS changed FROM diff GROUP BY ALL) GROUP BY image_id)"""


def _review(images: str) -> str:
    def n(name: str) -> str:
        return f"coalesce(n_{name}, 0)"

    missing = ", ".join(
        f"CASE WHEN {n(c)} = 0 THEN '{c}' END" for c in ("receiver_name", "input_box")
    )
    repeated = ", ".join(
        f"CASE WHEN {n(c)} > 1 THEN '{c}' END"
        for c in ("receiver_name", "receiver_avatar", "input_box", "send_button")
    )
    return f"""counted AS (SELECT image_id, count(*) AS n_labels,
    count(*) FILTER (x2 <= x1 OR y2 <= y1) AS n_invalid,
    count(*) FILTER (x2 > x1 AND y2 > y1 AND (x2 - x1 < 5 OR y2 - y1 < 5)) AS n_small,
    count(*) FILTER (class = 'receiver_name') AS n_receiver_name,
    count(*) FILTER (class = 'receiver_avatar') AS n_receiver_avatar,
    count(*) FILTER (class = 'input_box') AS n_input_box,
    count(*) FILTER (class = 'send_button') AS n_send_button
  FROM detections GROUP BY image_id),
reasons AS (SELECT image_id, coalesce(n_labels, 0) AS n_labels, concat_ws('; ',
    'missing: ' || nullif(concat_ws(', ', {missing}), ''),
    'repeated: ' || nullif(concat_ws(', ', {repeated}), ''),
    'size: ' || nullif(concat_ws(', ', CASE WHEN n_invalid > 0 THEN n_invalid || ' invalid_size'
      END, CASE WHEN n_small > 0 THEN n_small || ' too_small' END), ''),
    CASE WHEN n_labels IS NULL THEN 'no elements' WHEN n_labels > 20 THEN 'too many elements' END
  ) AS reason FROM {images} LEFT JOIN counted USING (image_id)),
review AS (SELECT image_id, n_labels, reason <> '' AS needs_review,
    CASE WHEN reason <> '' THEN reason ELSE 'labels look normal' END AS reason FROM reasons)"""


SQL = {
    "box_issues": V.using(V.DETECTIONS, """issues AS (SELECT image_id, det_id, concat_ws(',',
    CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'invalid_size'
      WHEN x2 - x1 < 10 OR y2 - y1 < 10 THEN 'too_small'
      WHEN x2 - x1 > 640 OR y2 - y1 > 480 THEN 'too_large' END,
    CASE WHEN x1 < 0 OR y1 < 0 OR x2 > 800 OR y2 > 600 THEN 'out_of_bounds' END) AS issues
  FROM detections)""") + "SELECT * FROM issues WHERE issues <> ''",
    "class_distribution": V.using(V.DETECTIONS) + """
SELECT image_id, class, count(*) AS n FROM detections GROUP BY image_id, class""",
    "duplicate_unique": V.using(V.DETECTIONS, _DUPLICATES) + """
SELECT image_id, class, n, 'high' AS severity FROM duplicates""",
    "missing_required": V.using(V.DETECTIONS, V.IMAGES, _MISSING) + """
SELECT image_id, class, 'medium' AS severity FROM missing""",
    "area_stats": V.using(V.DETECTIONS) + """
SELECT image_id, round(avg(a), 4) AS avg_area, min(a) AS min_area, max(a) AS max_area,
  round(stddev_pop(a), 4) AS area_std
FROM (SELECT image_id, CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS a FROM detections)
GROUP BY image_id""",
    "needs_review": V.using(V.DETECTIONS, V.IMAGES, _review("images")) + "SELECT * FROM review",
    "recommendations": V.using(V.DETECTIONS, V.IMAGES, _DUPLICATES, _MISSING) + """
SELECT image_id, coalesce(h, 0) + coalesce(m, 0) AS n_issues,
  CASE WHEN h > 0 THEN 'check; correct' WHEN m > 0 THEN 'check' ELSE 'confirm' END AS advice
FROM images LEFT JOIN (SELECT image_id, count(*) AS h FROM duplicates GROUP BY 1) USING (image_id)
LEFT JOIN (SELECT image_id, count(*) AS m FROM missing GROUP BY 1) USING (image_id)""",
    "validation_report": V.using(V.DETECTIONS, V.IMAGES, _DUPLICATES, _MISSING, """
classes AS (SELECT image_id, CAST(sum(n) AS BIGINT) AS total_labels,
    string_agg(class || '=' || n, ',' ORDER BY class) AS classes
  FROM (SELECT image_id, class, count(*) AS n FROM detections GROUP BY ALL) GROUP BY image_id),
issues AS (SELECT image_id, string_agg(type || ':' || class, ',' ORDER BY type, class) AS issues,
    max(type = 'duplicate_unique_element') AS severe
  FROM (SELECT image_id, class, 'duplicate_unique_element' AS type FROM duplicates
    UNION ALL SELECT image_id, class, 'missing_required_element' FROM missing) GROUP BY image_id),
areas AS (SELECT image_id, max(CAST((x2 - x1) * (y2 - y1) AS BIGINT)) AS max_area
  FROM detections GROUP BY image_id)""") + """
SELECT image_id, '800x600' AS size, coalesce(total_labels, 0) AS total_labels, classes, issues,
  max_area, CASE WHEN issues IS NULL THEN 'confirm' WHEN severe THEN 'check,correct'
    ELSE 'check' END AS advice
FROM images LEFT JOIN classes USING (image_id) LEFT JOIN issues USING (image_id)
LEFT JOIN areas USING (image_id)""",
    "batch_summary": V.using(
        V.DETECTIONS, V.IMAGES, "labelled AS (SELECT DISTINCT image_id FROM detections)",
        _review("labelled"),
    ) + """
SELECT successful + failed AS total_processed, successful, failed, needs_review
FROM (SELECT count(*) AS successful, count(*) FILTER (needs_review) AS needs_review FROM review),
  (SELECT count(*) AS failed FROM images WHERE image_id NOT IN (SELECT image_id FROM labelled))""",
    "label_diff": V.using(V.DETECTIONS, V.CORRECTED, _DIFF) + "SELECT * FROM diff",
    "corrections": V.using(V.DETECTIONS, V.CORRECTED, _DIFF, _CORRECTIONS) + """
SELECT * FROM corrections""",
    "session_statistics": V.using(V.DETECTIONS, V.CORRECTED, _DIFF, _CORRECTIONS) + """
SELECT count(*) AS total_validated, count(*) FILTER (corrected) AS total_corrected,
  printf('%.2f%%', (1 - count(*) FILTER (corrected) / count(*)) * 100) AS overall_accuracy,
  printf('%.2f%%', count(*) FILTER (corrected) / count(*) * 100) AS correction_rate
FROM corrections""",
    "class_accuracy": V.using(V.DETECTIONS, V.CORRECTED, _DIFF) + """
SELECT class, CAST(sum(kept + removed) AS BIGINT) AS total, CAST(sum(removed) AS BIGINT) AS errors,
  printf('%.2f%%', sum(kept) / nullif(sum(kept + removed), 0) * 100) AS accuracy
FROM diff GROUP BY class""",
    "spec_violations": V.using(V.DETECTIONS, """checked AS (SELECT image_id, det_id,
    x1 < 0 OR y1 < 0 OR x2 > 800 OR y2 > 600 AS outside,
    coalesce(y1 < lag(y1) OVER (PARTITION BY image_id, class ORDER BY det_id), false)
      AS out_of_order, class IS NULL AS unknown_class FROM detections)""") + """
SELECT * FROM checked WHERE outside OR out_of_order OR unknown_class""",
    "new_classes": V.using(V.DETECTIONS, V.CORRECTED) + """
SELECT DISTINCT class FROM corrected WHERE class NOT IN (SELECT class FROM detections
  WHERE class <> 'user_avatar')""",
    "yolo_encode": V.using(
        V.DETECTIONS, _YOLO.format(keys="image_id, det_id", source="detections")
    ) + f"SELECT image_id, det_id, {_YOLO_LINE} AS line FROM clamped WHERE {_YOLO_KEPT}",
    "parsed_responses": _PARSED + """
SELECT image_id, det_id, outcome, seq, class, b[1] AS x1, b[2] AS y1, b[3] AS x2, b[4] AS y2
FROM boxes""",
    "response_labels": _PARSED + ", " + "flat AS (SELECT image_id, det_id, seq, b[1] AS x1, "
    "b[2] AS y1, b[3] AS x2, b[4] AS y2, list_position(['receiver_avatar', 'receiver_name', "
    "'input_box', 'send_button', 'chat_message', 'contact_item', 'user_avatar'], class) - 1 "
    "AS class_id FROM boxes),\n" + _YOLO.format(keys="image_id, det_id, seq", source="flat")
    + f"\nSELECT image_id, det_id, seq, {_YOLO_LINE} AS line FROM clamped WHERE {_YOLO_KEPT}",
    "response_outcomes": _PARSED + """, per AS (
  SELECT image_id, det_id, CASE WHEN contains(any_value(response), '"objects"') THEN 'json'
    WHEN count(outcome) > 0 THEN 'pattern' ELSE 'unparsed' END AS outcome, count(outcome) AS n
  FROM responses LEFT JOIN boxes USING (image_id, det_id) GROUP BY image_id, det_id)
SELECT outcome, count(*) AS responses, CAST(sum(n) AS BIGINT) AS objects FROM per
GROUP BY outcome""",
    "label_file_validity": V.using(V.DETECTIONS, _VALID) + "SELECT * FROM validity",
    "training_manifest": V.using(V.DETECTIONS, V.IMAGES, _VALID) + f"""
SELECT image_stem, {_SPLIT.format('image_stem', 0.8, 1.0)} AS split
FROM (SELECT CAST(image_id AS VARCHAR) AS image_stem FROM images) JOIN validity USING (image_stem)
WHERE is_valid""",
    "dataset_split": f"""
SELECT doc_id, {_SPLIT.format('CAST(doc_id AS VARCHAR)', 0.8, 0.95)} AS split FROM documents""",
    "pairing_left": """
SELECT CAST(d.doc_id AS VARCHAR) AS image_stem, lang, quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "unlabelled_report": """
SELECT CAST(doc_id AS VARCHAR) AS image_stem, source FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "request_table": "SELECT page_id, base64(encode(html)) AS content_base64 FROM pages",
    "file_names": r"""
SELECT page_id, regexp_replace(name, '(.)\.[^.]*$', '\1') AS stem, name,
  lower(regexp_extract(url, '(\.[^./]*)$', 1)) AS ending
FROM (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)""",
}
