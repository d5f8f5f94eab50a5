"""Queries over recognition: regions, routes, packs, realignment.

The recognisers here are stand-ins whose text follows from what they see, so that SQL can say what
the dataflow must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.functions import geometry as G
from boxline.operators import recognition as R
from boxline.plans import page_text as P
from boxline.plans.catalog import views as V
from boxline.plans.catalog.packs import packed_lines


def size_reader():
    """Gives ``<width>x<height>``; confidence falls with the area."""
    def read(regions):
        return [(f"{w}x{h}", 1 - w * h / 480000) for w, h in regions]
    return read


def area_reader():
    def read(regions):
        return [(f"area {w * h}", 0.5) for w, h in regions]
    return read


def joining_reader():
    """Reads a pack of lines as their texts with bars between them, like one wide image."""
    def read(packs):
        return [("|".join(lines), 0.9) for lines in packs]
    return read


def label_reader():
    def read(labels):
        return [(f"<{label}>", len(label) / 16) for label in labels]
    return read


def _regions(spark, folder):
    return X.detections(spark, folder).select(
        "image_id", "det_id", "class", "confidence", *G.BOX,
        G.is_valid_region().alias("is_valid"), G.width().alias("w"), G.height().alias("h"),
    )


def recognise_regions(spark, folder):
    """Every region has a row; invalid regions keep their place and get a blank."""
    regions = _regions(spark, folder)
    read = R.recognise(
        regions.where("is_valid"), ["w", "h"], size_reader, ["image_id", "det_id"], name="size"
    )
    return R.realign(regions, read, ["image_id", "det_id"])


def recognise_elements(spark, folder):
    """Routes: blank input boxes and known buttons never reach a model."""
    regions = _regions(spark, folder).where("is_valid")
    gray = F.lit(255) - F.col("confidence") * 60
    elements = regions.withColumns({
        "mean_gray": gray,
        "known_text": F.when(F.col("w") > 300, F.lit("send")),
    })
    return R.recognise_elements(
        elements, ["w", "h"], size_reader, area_reader, ["image_id", "det_id", "class"]
    ).select("image_id", "det_id", "class", "route", "text")


def recognise_packs(spark, folder):
    """Lines without a bar in them, packed, read in one call per pack, split and realigned."""
    lines = X.text_lines(spark, folder).withColumn(
        "line", F.md5("line")
    )
    return P.read_packed_lines(lines, "line", joining_reader)


def read_lines(spark, folder):
    rows = X.detections(spark, folder).withColumns({"cy": G.center_y(), "cx": G.center_x()})
    return P.read_lines(rows, "class", label_reader, min_confidence=0.7).select(
        "image_id", "det_id", F.col("reading_no").cast("long").alias("reading_no"), "text",
        "confidence",
    )


def group_by_source(spark, folder):
    rows = X.text_lines(spark, folder).join(
        X.table(spark, folder, "documents").select(F.col("doc_id").alias("image_id"), "lang"),
        "image_id",
    )
    results = rows.select(
        "image_id", F.col("lang").alias("source_type"), F.col("line_no").alias("region_idx"),
        F.md5("line").alias("text"), F.lit(0.9).alias("confidence"),
        F.lit(0).alias("x1"), F.col("line_no").alias("y1"), F.col("effective_width").alias("x2"),
        (F.col("line_no") + 1).alias("y2"),
    )
    return R.group_by_source(results).select(
        "image_id", "source_type", "part", F.size("results").alias("n"),
        F.array_join(F.transform("results", lambda r: r["text"]), ",").alias("texts"),
    )


def standard_inputs(spark, folder):
    """Pages as path inputs, documents as dict inputs; empty contents are skipped."""
    def image(text):
        return F.when(F.length(text) > 0, F.struct(
            F.length(text).alias("height"), F.lit(1).alias("width"),
        ))

    paths = X.table(spark, folder, "pages").select(
        F.col("page_id").alias("pos"), F.col("url").alias("path"), image(F.col("html")).alias("image")
    )
    dicts = X.table(spark, folder, "documents").select(
        (F.col("doc_id") + 1_000_000).alias("pos"),
        F.when(F.col("lang") == "en", F.col("source")).alias("id"),
        image(F.col("text")).alias("image"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )
    return R.standard_inputs(spark, paths=paths, dicts=dicts).select(
        "pos", "source_id", F.col("image.height").alias("height"),
        F.col("metadata")["lang"].alias("lang"),
    )


def ink_thumbnails(spark, folder):
    """Embeddings as 8 x 8 gray images: ink per row and column, and the thumbnail's sum."""
    gray = F.transform(
        "embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int")
    )
    data = F.unhex(F.array_join(F.transform(gray, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    rows = X.table(spark, folder, "embeddings").select("vec_id", data.alias("data"))
    profile = R.ink_profiles(F.col("data"), F.lit(8), F.lit(8), F.lit(1), F.lit(127))
    return rows.select("vec_id", profile.alias("p")).select(
        "vec_id", F.array_join("p.rows", ",").alias("rows"),
        F.array_join("p.cols", ",").alias("cols"),
        F.aggregate("p.thumbnail", F.lit(0.0), lambda a, x: a + x).cast("long").alias("gray_sum"),
    )


def crop_grays(spark, folder):
    """Two regions of each such image, cropped in Python; an empty box gives no crop."""
    gray = F.transform(
        "embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int")
    )
    data = F.unhex(F.array_join(F.transform(gray, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    vectors = X.table(spark, folder, "embeddings")
    images = vectors.select(
        F.col("vec_id").alias("image_id"),
        F.struct(
            F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"),
            data.alias("data"),
        ).alias("image"),
    )
    boxes = F.array(
        F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(8).alias("x2"), F.lit(2).alias("y2")),
        F.struct(F.lit(0).alias("x1"), F.lit(6).alias("y1"), F.lit(99).alias("x2"), F.lit(99).alias("y2")),
        F.struct(F.lit(5).alias("x1"), F.lit(5).alias("y1"), F.lit(5).alias("x2"), F.lit(9).alias("y2")),
    )
    regions = vectors.select(
        F.col("vec_id").alias("image_id"), F.posexplode(boxes).alias("region_idx", "b")
    ).select("image_id", F.col("region_idx").cast("long").alias("region_idx"), "b.*")
    return R.crop_regions(images, regions).select(
        "image_id", "region_idx", "crop_height", "crop_width",
        F.round("mean_gray", 4).alias("mean_gray"),
    )


QUERIES = {f.__name__: f for f in (
    recognise_regions, recognise_elements, recognise_packs, read_lines, group_by_source,
    standard_inputs, ink_thumbnails, crop_grays,
)}

_SIZED = """sized AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h,
    x2 > x1 AND y2 > y1 AND x1 >= 0 AND y1 >= 0 AS is_valid FROM detections)"""
_GRAY = """gray AS (SELECT vec_id, list_transform(embedding, lambda v:
    CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5::DOUBLE) AS INT)) AS g FROM embeddings)"""

SQL = {
    "recognise_regions": V.using(V.DETECTIONS, _SIZED) + """
SELECT image_id, det_id, CASE WHEN is_valid THEN w || 'x' || h ELSE '' END AS text,
  CASE WHEN is_valid THEN 1 - w * h / 480000.0::DOUBLE ELSE 0 END AS confidence
FROM sized""",
    "recognise_elements": V.using(V.DETECTIONS, _SIZED, """routed AS (SELECT *, CASE
    WHEN class = 'input_box' AND 255 - confidence * 60 > 240 THEN 'empty'
    WHEN class = 'send_button' AND w > 300 THEN 'known'
    WHEN class = 'chat_message' THEN 'multi_line' ELSE 'single_line' END AS route
  FROM sized WHERE is_valid)""") + """
SELECT image_id, det_id, class, route, CASE route WHEN 'empty' THEN '' WHEN 'known' THEN 'send'
  WHEN 'multi_line' THEN 'area ' || w * h ELSE w || 'x' || h END AS text
FROM routed""",
    "recognise_packs": packed_lines("adaptive") + """
SELECT image_id, line_no, pack, md5(line) AS text, CAST(0.9 AS DOUBLE) AS confidence
FROM packed_adaptive JOIN text_lines USING (image_id, line_no)""",
    "read_lines": V.using(V.DETECTIONS) + """
SELECT image_id, det_id, reading_no, '<' || class || '>' AS text,
  length(class) / 16.0::DOUBLE AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (y1 + y2) / 2, (x1 + x2) / 2,
  det_id) AS reading_no FROM detections) WHERE length(class) / 16.0 >= 0.7""",
    "group_by_source": V.using(V.TEXT_LINES) + """
SELECT image_id, lang AS source_type, line_no // 1000 AS part, count(*) AS n,
  string_agg(md5(line), ',' ORDER BY line_no) AS texts
FROM text_lines JOIN documents ON image_id = doc_id GROUP BY 1, 2, 3""",
    "standard_inputs": r"""
SELECT page_id AS pos, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')
    AS source_id, length(html) AS height, NULL AS lang
FROM pages WHERE length(html) > 0
UNION ALL SELECT doc_id + 1000000, coalesce(CASE WHEN lang = 'en' THEN source END,
    'dict_' || (doc_id + 1000000)), length(text), lang FROM documents WHERE length(text) > 0""",
    "ink_thumbnails": V.using(_GRAY) + """
SELECT vec_id,
  array_to_string(list_transform(range(0, 8), lambda r: len(list_filter(g[r * 8 + 1:r * 8 + 8],
    lambda x: x < 127))), ',') AS rows,
  array_to_string(list_transform(range(0, 8), lambda c: len(list_filter(range(0, 8),
    lambda r: g[r * 8 + c + 1] < 127))), ',') AS cols,
  CAST(list_sum(g) AS BIGINT) AS gray_sum
FROM gray""",
    "crop_grays": V.using(_GRAY) + """
SELECT vec_id AS image_id, CAST(0 AS BIGINT) AS region_idx, 2 AS crop_height, 8 AS crop_width,
  round(list_avg(g[1:16]), 4) AS mean_gray FROM gray
UNION ALL SELECT vec_id, 1, 2, 8, round(list_avg(g[49:64]), 4) FROM gray
UNION ALL SELECT vec_id, 2, 0, 0, NULL FROM gray""",
}
