"""Queries over overlapping boxes: matches, suppression, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.functions import geometry as G
from boxline.operators import evaluation as E
from boxline.operators import overlap as O
from boxline.plans.catalog import views as V
from boxline.schemas import class_table


def overlap_match(spark, folder):
    """Boxes that nearly cover the most confident box of their image."""
    rows = X.detections(spark, folder)
    best = rows.groupBy("image_id").agg(
        F.max_by(F.struct("det_id", *G.BOX), F.struct("confidence", -F.col("det_id"))).alias("b")
    ).select(
        "image_id", F.col("b.det_id").alias("query_id"),
        *[F.col(f"b.{c}").alias(f"q_{c}") for c in G.BOX],
    )
    return O.overlap_match(rows, best, ["image_id"]).select(
        "image_id", "query_id", "det_id", F.round("iou", 6).alias("iou")
    )


def nms(spark, folder):
    return O.nms(X.detections(spark, folder))


def nms_agnostic(spark, folder):
    return O.nms(X.detections(spark, folder), ["image_id"])


def _sides(spark, folder):
    rows = X.detections(spark, folder).where("x2 > x1 AND y2 > y1")
    truths = X.truth_boxes(rows)
    return rows, truths


def truth_matches(spark, folder):
    predictions, truths = _sides(spark, folder)
    return E.match_truth(predictions, truths).withColumn("iou", F.round("iou", 6))


def evaluation_counts(spark, folder):
    predictions, truths = _sides(spark, folder)
    return E.true_positives(E.match_truth(predictions, truths))


def evaluate_detections(spark, folder):
    predictions, truths = _sides(spark, folder)
    scores = E.evaluate(predictions, truths, class_table(spark))
    names = [c for c in scores.columns if c != "class"]
    return scores.select("class", *[F.round(c, 6).alias(c) for c in names])


def assigned_truths(spark, folder):
    """Predictions and truths of any class matched one to one at two levels, where many contest a truth."""
    found = E.assign_truths(*_sides(spark, folder), levels=[0.1, 0.3], keys=["image_id"])
    return found.withColumn("iou", F.round("iou", 6))


QUERIES = {f.__name__: f for f in (
    overlap_match, nms, nms_agnostic, truth_matches, evaluation_counts, evaluate_detections,
    assigned_truths,
)}

_SIDES = """p AS (SELECT * FROM detections WHERE x2 > x1 AND y2 > y1),
t AS (SELECT image_id, class, det_id AS truth_id, x1 + CAST(trunc(confidence * 20) AS INT) AS tx1,
    y1 AS ty1, x2 + CAST(trunc(confidence * 20) AS INT) AS tx2, y2 AS ty2
  FROM p WHERE confidence >= 0.5)"""
_MATCHES = f"""pairs AS (SELECT p.image_id, p.class, p.det_id, t.truth_id, p.confidence,
    {V.iou('p.', 't.t')} AS iou
  FROM p JOIN t ON p.image_id = t.image_id AND p.class = t.class),
matches AS (SELECT * FROM pairs WHERE iou >= 0.5 QUALIFY row_number() OVER (
  PARTITION BY image_id, class, det_id ORDER BY iou DESC, truth_id) = 1)"""
_LEVELS = ", ".join(f"({v})" for v in E.IOU_LEVELS)
_TP = f"""tp AS (SELECT class, level, bucket, count(*) AS tp FROM (
    SELECT class, level, CAST(round(confidence * 1000) AS INT) AS bucket
    FROM matches, (SELECT CAST(v AS DOUBLE) AS level FROM (VALUES {_LEVELS}) l(v))
    WHERE iou >= level QUALIFY row_number() OVER (PARTITION BY image_id, class, truth_id, level
      ORDER BY confidence DESC, det_id) = 1) GROUP BY ALL)"""
_CURVE = f"""grid AS (SELECT class, level, bucket, n FROM (SELECT class,
      CAST(round(confidence * 1000) AS INT) AS bucket, count(*) AS n FROM p GROUP BY ALL),
    (SELECT CAST(v AS DOUBLE) AS level FROM (VALUES {_LEVELS}) l(v))),
sums AS (SELECT g.class, g.level, g.bucket, n_truth, sum(coalesce(tp, 0)) OVER w AS tp,
    sum(n) OVER w AS n
  FROM grid g LEFT JOIN tp ON tp.class = g.class AND tp.level = g.level AND tp.bucket = g.bucket
  JOIN (SELECT class, count(*) AS n_truth FROM t GROUP BY class) c ON c.class = g.class
  WINDOW w AS (PARTITION BY g.class, g.level ORDER BY g.bucket DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT *, tp / n AS prec, tp / n_truth AS rec FROM sums),
steps AS (SELECT *, max(prec) OVER (PARTITION BY class, level ORDER BY bucket DESC
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env,
    rec - coalesce(lag(rec) OVER (PARTITION BY class, level ORDER BY bucket DESC), 0) AS gained
  FROM curve),
ap AS (SELECT class, level, sum(env * gained) AS ap FROM steps GROUP BY ALL),
best AS (SELECT class, prec, rec FROM curve WHERE level = 0.5 QUALIFY row_number() OVER (
  PARTITION BY class ORDER BY 2 * prec * rec / (prec + rec + 1e-6) DESC, bucket DESC) = 1),
scores AS (SELECT a.class, max(ap) FILTER (level = 0.5) AS ap50, sum(ap) / 10 AS ap50_95,
    any_value(prec) AS prec, any_value(rec) AS rec
  FROM ap a JOIN best b ON a.class = b.class GROUP BY a.class)"""



def _nms(keys: str) -> str:
    """Suppression one rank at a time: all groups advance together."""
    same = " AND ".join(f"k.{c} = r.{c}" for c in keys.split(", "))
    box = "{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'det_id': det_id, 'confidence': confidence}"
    return f"""WITH RECURSIVE {V.DETECTIONS},
ranked AS (SELECT {keys}, {box} AS box, row_number() OVER (PARTITION BY {keys}
    ORDER BY confidence DESC, det_id) AS rank FROM detections),
kept AS (SELECT {keys}, rank, [box] AS kept FROM ranked WHERE rank = 1
  UNION ALL SELECT {', '.join('k.' + c for c in keys.split(', '))}, r.rank,
    CASE WHEN len(kept) >= 300 OR list_bool_or(list_transform(kept, lambda b:
      {V.iou('b.', 'r.box.')} > 0.45)) THEN kept ELSE list_append(kept, r.box) END
  FROM kept k JOIN ranked r ON {same} AND r.rank = k.rank + 1),
last AS (SELECT {keys}, arg_max(kept, rank) AS kept FROM kept GROUP BY {keys})
SELECT {keys}, b.det_id, b.x1, b.y1, b.x2, b.y2, b.confidence
FROM (SELECT {keys}, unnest(kept) AS b FROM last)"""


SQL = {
    "nms": _nms("image_id, class"),
    "nms_agnostic": _nms("image_id"),
    "overlap_match": V.using(V.DETECTIONS, """best AS (SELECT image_id, det_id AS query_id,
    x1 AS q_x1, y1 AS q_y1, x2 AS q_x2, y2 AS q_y2 FROM detections QUALIFY row_number() OVER (
    PARTITION BY image_id ORDER BY confidence DESC, det_id) = 1)""") + f"""
SELECT image_id, query_id, det_id, round(iou, 6) AS iou FROM (SELECT b.image_id, query_id, det_id,
  {V.iou('d.', 'b.q_')} AS iou FROM detections d JOIN best b ON d.image_id = b.image_id)
WHERE iou > 0.8""",
    "truth_matches": V.using(V.DETECTIONS, _SIDES, _MATCHES) + """
SELECT image_id, class, det_id, truth_id, round(iou, 6) AS iou, confidence FROM matches""",
    "assigned_truths": V.using(V.DETECTIONS, _SIDES).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
pairs AS (SELECT p.image_id, p.det_id, t.truth_id, p.confidence, {V.iou('p.', 't.t')} AS iou,
    tx1, ty1, tx2, ty2
  FROM p JOIN t ON p.image_id = t.image_id),
wishes AS (SELECT image_id, level, det_id, confidence,
    list(struct_pack(truth_id := truth_id, iou := iou) ORDER BY iou DESC, tx1, ty1, tx2, ty2, truth_id) AS options
  FROM pairs, (VALUES (0.1::DOUBLE), (0.3::DOUBLE)) l(level) WHERE iou >= level GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (PARTITION BY image_id, level ORDER BY confidence DESC, det_id) AS turn
  FROM wishes),
taken AS (SELECT image_id, level, turn, det_id, confidence, options[1] AS pick, [options[1].truth_id] AS gone
  FROM turns WHERE turn = 1
  UNION ALL SELECT image_id, level, turn, det_id, confidence, pick,
    CASE WHEN pick IS NULL THEN gone ELSE list_append(gone, pick.truth_id) END
  FROM (SELECT t.image_id, t.level, t.turn, t.det_id, t.confidence, k.gone,
      list_filter(t.options, lambda o: NOT list_contains(k.gone, o.truth_id))[1] AS pick
    FROM taken k JOIN turns t ON t.image_id = k.image_id AND t.level = k.level AND t.turn = k.turn + 1))
SELECT image_id, level, det_id, pick.truth_id AS truth_id, round(pick.iou, 6) AS iou, confidence
FROM taken WHERE pick IS NOT NULL""",
    "evaluation_counts": V.using(V.DETECTIONS, _SIDES, _MATCHES, _TP) + "SELECT * FROM tp",
    "evaluate_detections": V.using(V.DETECTIONS, _SIDES, _MATCHES, _TP, _CURVE) + """
SELECT class, round(ap50, 6) AS ap50, round(ap50_95, 6) AS ap50_95, round(prec, 6) AS precision,
  round(rec, 6) AS recall, round(2 * prec * rec / (prec + rec + 1e-6), 6) AS f1
FROM (SELECT * FROM scores UNION ALL
  SELECT 'all', avg(ap50), avg(ap50_95), avg(prec), avg(rec) FROM scores)""",
}
