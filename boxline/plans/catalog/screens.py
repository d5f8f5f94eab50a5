"""Queries from pixels to text: line splitters by name, the text of regions, detection with reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.operators import screens as S
from boxline.operators.recognition import crop_regions
from boxline.plans.catalog import views as V

DARK = 127


def split_regions(spark, folder):
    """Lines of whole images; a quarter of the images takes each splitter, the last one by edge density."""
    images = X.gray_images(spark, folder)
    number = F.col("image_id")
    regions = images.select(
        "image_id", F.lit(0).cast("long").alias("region_idx"), F.lit(0).alias("x1"), F.lit(0).alias("y1"),
        F.lit(8).alias("x2"), F.lit(8).alias("y2"),
    )
    crops = crop_regions(images, regions).withColumns({
        "method": F.when(number % 4 == 0, "projection").when(number % 4 == 1, "component")
        .when(number % 4 == 2, "contour").otherwise("auto"),
        "edge_density": (number % 10) / 20,
    })
    found = S.split_regions(crops, min_height=2, min_width=2, dark=DARK)
    return found.drop("region_idx").withColumn("confidence", F.round("confidence", 9))


def _regions(images):
    boxes = F.array(*[
        F.struct(F.lit(name).alias("class"), *(F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), box)))
        for name, box in (
            ("chat_area", (0, 0, 8, 5)), ("input_area", (2, 3, 99, 99)), ("send_button", (0, 0, 8, 8)),
            ("chat_area", (-3, 4, 5, 8)), ("side_info", (5, 5, 5, 9)),
        )
    ])
    return images.select("image_id", F.posexplode(boxes).alias("at", "b")).select(
        "image_id", F.col("at").cast("long").alias("region_idx"), (F.col("at") * 10).alias("det_id"), "b.*"
    )


def pixel_reader():
    """Reads a piece as its size and the sum of its pixels; the darker, the surer."""
    def read(pieces):
        return [
            (f"{p.shape[1]}x{p.shape[0]}:{int(p.sum())}", float((p < 127).sum()) / p[..., 0].size) for p in pieces
        ]

    return read


def row_detector():
    """Boxes around stretches of pixel rows with four dark pixels or more."""
    def detect(images):
        import numpy as np

        out = []
        for pixels in images:
            ink = pixels[..., 0] < 127
            full = np.concatenate([[0], (ink.sum(axis=1) >= 4).astype(int), [0]])
            edges = np.flatnonzero(np.diff(full))
            boxes = []
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                columns = np.flatnonzero(ink[a:b].any(axis=0))
                boxes.append((int(columns[0]), a, int(columns[-1]) + 1, b))
            out.append(boxes[::-1])
        return out

    return detect


def read_regions(spark, folder):
    """Text lines of the regions of some classes, from pixels."""
    images = X.gray_images(spark, folder)
    read = S.read_regions(
        images, _regions(images), pixel_reader, ["chat_area", "input_area", "side_info"], min_height=2,
        min_width=2, dark=DARK,
    )
    return read.drop("error").withColumns({c: F.round(c, 9) for c in ("ink", "confidence")})


def read_screens(spark, folder):
    """All text of images, from pixels: detected, ordered, read, doubtful lines dropped."""
    read = S.read_images(
        X.gray_images(spark, folder), row_detector, pixel_reader, 0.6, boxes=True, confidences=True
    )
    return read.withColumn("confidence", F.round("confidence", 9))


QUERIES = {f.__name__: f for f in (split_regions, read_regions, read_screens)}

_PIXELS = """px AS (SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x,
    CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5::DOUBLE) AS INT) AS g
  FROM embeddings, range(0, 64) AS r(i))"""


def _projection(source: str) -> str:
    """Runs of rows of ``source`` (k, y, ink, wide) whose smoothed ink is above 0.3 of the mean, two rows at least."""
    return f"""sm AS (SELECT k, y, wide, sum(ink) OVER (PARTITION BY k ORDER BY y
      ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0::DOUBLE AS s FROM {source}),
  ab AS (SELECT *, s > avg(s) OVER (PARTITION BY k) * 0.3::DOUBLE AS above FROM sm),
  isl AS (SELECT *, y - row_number() OVER (PARTITION BY k ORDER BY y) AS island FROM ab WHERE above),
  proj AS (SELECT k, min(y) AS y1, max(y) + 1 AS y2, min(wide) AS wide, least(1.0::DOUBLE, avg(s)) AS c
    FROM isl GROUP BY k, island HAVING count(*) >= 2)"""


def _parts(name: str, source: str) -> str:
    """Boxes of 8-connected pixels of ``source`` (image_id, x, y)."""
    return f"""{name}_reach AS (SELECT image_id, y * 8 + x AS a, x, y FROM {source}
    UNION SELECT r.image_id, r.a, p.x, p.y FROM {name}_reach AS r JOIN {source} AS p
      ON r.image_id = p.image_id AND abs(r.x - p.x) <= 1 AND abs(r.y - p.y) <= 1),
  {name}_label AS (SELECT image_id, x, y, min(a) AS root FROM {name}_reach GROUP BY 1, 2, 3),
  {name} AS (SELECT image_id, root, min(x) AS x, min(y) AS y, max(x) + 1 - min(x) AS w,
      max(y) + 1 - min(y) AS h, count(*) AS area FROM {name}_label GROUP BY 1, 2)"""


SQL = {
    "split_regions": "WITH RECURSIVE " + _PIXELS + """,
  ink AS (SELECT image_id, x, y FROM px WHERE g < 127),
  rws AS (SELECT image_id AS k, y, count(*) FILTER (g < 127) AS ink, 8 AS wide FROM px GROUP BY 1, 2),
  """ + _projection("rws") + """,
  """ + _parts("part", "ink") + """,
  grown AS (SELECT DISTINCT p.image_id, p.x, p.y FROM px AS p JOIN ink AS i ON p.image_id = i.image_id
    AND abs(p.x - i.x) <= 2 AND abs(p.y - i.y) <= 1),
  blank AS (SELECT image_id, x, y FROM px EXCEPT SELECT image_id, x, y FROM grown),
  shut AS (SELECT image_id, x, y FROM grown EXCEPT
    SELECT p.image_id, p.x, p.y FROM px AS p JOIN blank AS b ON p.image_id = b.image_id
      AND abs(p.x - b.x) <= 2 AND abs(p.y - b.y) <= 1),
  """ + _parts("whole", "shut") + """,
  kept AS (SELECT *, y + h // 2 AS cy FROM part WHERE h >= 8 AND w >= 3 AND area >= 20),
  cut AS (SELECT *, CASE WHEN cy - lag(cy) OVER o <= greatest(h, lag(h) OVER o) * 0.5::DOUBLE THEN 0 ELSE 1
      END AS b FROM kept WINDOW o AS (PARTITION BY image_id ORDER BY cy, x, y, w, h, area)),
  grp AS (SELECT *, sum(b) OVER (PARTITION BY image_id ORDER BY cy, x, y, w, h, area) AS line FROM cut),
  comp AS (SELECT image_id, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2,
      least(1.0::DOUBLE, CAST(sum(area) AS DOUBLE) / ((max(x + w) - min(x)) * (max(y + h) - min(y)))
        * count(*) / 10) AS c FROM grp GROUP BY image_id, line),
  raw AS (SELECT 'projection' AS rule, k AS image_id, 0 AS x1, y1, 8 AS x2, y2, c, y1 AS o FROM proj
    UNION ALL SELECT 'component', image_id, x1, y1, x2, y2, c, y1 FROM comp WHERE y2 - y1 >= 2
    UNION ALL SELECT 'contour', image_id, x, y, x + w, y + h, least(1.0::DOUBLE, 2.0::DOUBLE * area / (w * h)),
      y + h // 2 FROM whole WHERE h >= 2 AND w >= 2),
  chosen AS (SELECT vec_id AS image_id, CASE vec_id % 4 WHEN 0 THEN 'projection' WHEN 1 THEN 'component'
      WHEN 2 THEN 'contour' ELSE 'auto' END AS method, vec_id % 10 / 20.0::DOUBLE AS density FROM embeddings),
  mine AS (SELECT raw.*, method FROM raw JOIN chosen USING (image_id) WHERE rule = CASE WHEN method <> 'auto'
      THEN method WHEN density < 0.1 THEN 'projection' WHEN density < 0.3 THEN 'component' ELSE 'contour' END),
  gaps AS (SELECT *, CASE WHEN method = 'auto' AND y1 - lag(y2) OVER n < 5 THEN 0 ELSE 1 END AS b
    FROM mine WINDOW n AS (PARTITION BY image_id ORDER BY o, x1)),
  groups AS (SELECT *, sum(b) OVER (PARTITION BY image_id ORDER BY o, x1) AS line FROM gaps)
SELECT image_id, method, CAST(line AS INT) AS line_no, CAST(min(x1) AS INT) AS x1,
  CAST(arg_min(y1, (o, x1)) AS INT) AS y1, CAST(max(x2) AS INT) AS x2, CAST(arg_max(y2, (o, x1)) AS INT) AS y2,
  round(max(c), 9) AS confidence
FROM groups GROUP BY image_id, method, line""",
    "read_regions": V.using(_PIXELS, """reg(nth, class, x1, y1, x2, y2) AS (VALUES (0, 'chat_area', 0, 0, 8, 5),
    (1, 'input_area', 2, 3, 8, 8), (3, 'chat_area', 0, 4, 5, 8))""", """
  inside AS (SELECT image_id * 10 + nth AS k, image_id, nth, class, x1, px.y - y1 AS y, y1, x2, px.x, g
    FROM px JOIN reg ON x >= x1 AND x < x2 AND y >= y1 AND y < y2)""", """
  rws AS (SELECT k, y, count(*) FILTER (g < 127) AS ink, any_value(x2 - x1) AS wide FROM inside GROUP BY k, y)""",
        _projection("rws")) + """
SELECT image_id, CAST(nth AS BIGINT) AS region_idx, CAST(nth * 10 AS INT) AS det_id, class,
  CAST(line AS INT) AS line_no, class || '_' || line AS region_id, CAST(any_value(x1) AS INT) AS x1,
  CAST(any_value(y1) + l1 AS INT) AS y1, CAST(any_value(x2) AS INT) AS x2,
  CAST(any_value(y1) + l2 AS INT) AS y2, round(any_value(c), 9) AS ink,
  any_value(x2 - x1) || 'x' || (l2 - l1) || ':' || sum(g) AS text,
  round(CAST(count(*) FILTER (g < 127) AS DOUBLE) / count(*), 9) AS confidence
FROM inside JOIN (SELECT k AS pk, y1 AS l1, y2 AS l2, c, row_number() OVER (PARTITION BY k ORDER BY y1) AS line
  FROM proj) ON k = pk AND y >= l1 AND y < l2
GROUP BY image_id, nth, class, line, l1, l2""",
    "read_screens": V.using(_PIXELS, """rws AS (SELECT image_id, y, count(*) FILTER (g < 127) AS n FROM px
    GROUP BY 1, 2)""", """isl AS (SELECT image_id, y, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS i
  FROM rws WHERE n >= 4)""", """box AS (SELECT image_id, min(isl.y) AS y1, max(isl.y) + 1 AS y2, min(x) AS x1,
    max(x) + 1 AS x2 FROM isl JOIN px USING (image_id) WHERE px.y = isl.y AND g < 127 GROUP BY image_id, i)""",
        """numbered AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y1 + y2, x1 + x2) AS line_no
  FROM box)""", """seen AS (SELECT image_id, line_no, any_value(x2 - x1) || 'x' || any_value(y2 - y1) || ':' || sum(g)
    AS text, CAST(count(*) FILTER (g < 127) AS DOUBLE) / count(*) AS c, any_value(x1) AS x1, any_value(y1) AS y1,
    any_value(x2) AS x2, any_value(y2) AS y2
  FROM numbered JOIN px USING (image_id) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2
  GROUP BY image_id, line_no)""") + """
SELECT image_id, CAST(line_no AS INT) AS line_no, text, round(c, 9) AS confidence, CAST(x1 AS INT) AS x1,
  CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2
FROM seen WHERE c >= 0.6""",
}
