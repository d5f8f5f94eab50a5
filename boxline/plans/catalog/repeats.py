"""Queries over repeated content: fingerprints, reuse, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.functions import fingerprint as P
from boxline.functions.binding import bind
from boxline.operators import decode as D
from boxline.operators import reuse as R
from boxline.plans.catalog import views as V

DICTIONARY = ["<blank>", "a", "b", "c", " "]


def fingerprint(spark, folder):
    rows = X.table(spark, folder, "embeddings")
    return rows.select("vec_id", P.average_hash(F.col("embedding")).alias("bits"))


def _text_thumbnail(text):
    """64 equal stretches of a whole text; the letters in each stand for gray values."""
    width = F.greatest(F.lit(1), F.floor(F.length(text) / 64).cast("int"))
    return bind(width, lambda w: F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.length(F.translate(
            F.substring(text, i * w + 1, F.when(i < 63, w).otherwise(F.lit(2147483647))), " ", "",
        )),
    ))


def near_duplicates(spark, folder):
    """Documents whose fingerprints differ in at most three bits."""
    rows = X.table(spark, folder, "documents").select(
        P.packed_hash(_text_thumbnail(F.col("text"))).alias("fingerprint")
    )
    return R.near_duplicates(rows, max_distance=3).select(
        F.lpad(F.bin("left"), 64, "0").alias("left"), F.lpad(F.bin("right"), 64, "0").alias("right"),
        "n_left", "n_right", F.round("similarity", 6).alias("similarity"),
    )


def _items(spark, folder):
    """Lines of documents as items with a content key."""
    return X.text_lines(spark, folder).select(
        "image_id", "line_no", "line", P.digest(F.col("line")).alias("hash")
    )


def hit_labels(spark, folder):
    return R.label_hits(_items(spark, folder), "hash", ["image_id", "line_no"]).select(
        "image_id", "line_no", "is_hit"
    )


def hit_statistics(spark, folder):
    return R.hit_statistics(_items(spark, folder), "hash").withColumn(
        "hit_rate", F.round("hit_rate", 6)
    )


def reuse_results(spark, folder):
    """A stand-in recogniser gives the length of a line; it sees each distinct line once."""
    items = _items(spark, folder)

    def compute(todo):
        return todo.select(
            "hash", F.concat(F.lit("read:"), F.md5("line")).alias("text"),
            F.length("line").alias("size"),
        )

    return R.reuse_results(items, "hash", compute).select("image_id", "line_no", "text", "size")


def reuse_known(spark, folder):
    """As above, with the lines of conversations as results of an earlier run."""
    items = _items(spark, folder)
    turns = X.table(spark, folder, "conversations").select(
        F.explode(F.split("text", "\n", -1)).alias("line")
    )
    known = turns.select(P.digest(F.col("line")).alias("hash")).distinct().withColumn(
        "origin", F.lit("earlier")
    )
    return R.reuse_results(
        items, "hash", lambda todo: todo.select("hash", F.lit("new").alias("origin")), known
    ).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


def known_regions(spark, folder):
    regions = X.table(spark, folder, "events").select(
        "event_id", P.short_digest(F.col("event_type")).alias("hash")
    )
    table = X.table(spark, folder, "events").select(
        P.short_digest(F.col("event_type")).alias("hash"), F.upper("event_type").alias("text")
    ).where(F.col("text") != "VIEW").distinct()
    return R.known_regions(regions, table, "hash").select("event_id", "known_text")


def _dictionary(spark):
    return spark.createDataFrame(list(enumerate(DICTIONARY)), "class_idx int, char string")


def ctc_decode(spark, folder):
    return D.decode_steps(
        X.ctc_steps(spark, folder), _dictionary(spark), ["ts", "step_id"]
    ).withColumn("confidence", F.round("confidence", 6))


def ctc_matrix(spark, folder):
    """Each embedding as a matrix of 16 steps with 4 classes."""
    rows = X.table(spark, folder, "embeddings").select(
        "vec_id",
        F.transform(
            F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice("embedding", t * 4 + 1, 4)
        ).alias("matrix"),
    )
    return D.decode_matrix(rows, "matrix", DICTIONARY).select(
        "vec_id", "text", F.round("confidence", 5).alias("confidence")
    )


QUERIES = {f.__name__: f for f in (
    fingerprint, near_duplicates, hit_labels, hit_statistics, reuse_results, reuse_known,
    known_regions, ctc_decode, ctc_matrix,
)}

_BITS = """bits AS (SELECT vec_id, list_aggregate(list_transform(embedding, lambda x:
    CASE WHEN CAST(x AS DOUBLE) > list_avg(CAST(embedding AS DOUBLE[])) THEN '1' ELSE '0' END),
    'string_agg', '') AS bits FROM embeddings)"""

_TEXT_BITS = """thumbs AS (SELECT doc_id, list_transform(range(0, 64), lambda i: length(replace(
    substr(text, i * w + 1, CASE WHEN i < 63 THEN w ELSE length(text) END), ' ', ''))) AS t
  FROM (SELECT doc_id, text, greatest(1, length(text) // 64) AS w FROM documents)),
bits AS (SELECT doc_id, list_aggregate(list_transform(t, lambda x:
    CASE WHEN x > list_avg(t) THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM thumbs)"""

SQL = {
    "fingerprint": V.using(_BITS) + "SELECT vec_id, bits FROM bits",
    "near_duplicates": V.using(_TEXT_BITS, """d AS (SELECT bits, count(*) AS n,
    CASE WHEN bits[1] = '1' THEN 0 ELSE 1 END AS positive FROM bits GROUP BY bits)""") + """
SELECT a.bits AS "left", b.bits AS "right", a.n AS n_left, b.n AS n_right,
  round(1 - bit_count(xor(CAST(a.bits AS BIT), CAST(b.bits AS BIT))) / 64, 6) AS similarity
FROM d a JOIN d b ON (a.positive, a.bits) < (b.positive, b.bits)
WHERE bit_count(xor(CAST(a.bits AS BIT), CAST(b.bits AS BIT))) <= 3""",
    "hit_labels": V.using(V.TEXT_LINES) + """
SELECT image_id, line_no, row_number() OVER (PARTITION BY line ORDER BY image_id, line_no) > 1
  AS is_hit FROM text_lines""",
    "hit_statistics": V.using(V.TEXT_LINES) + """
SELECT count(*) AS requests, count(*) - count(DISTINCT line) AS hits,
  count(DISTINCT line) AS misses,
  round((count(*) - count(DISTINCT line)) / count(*), 6) AS hit_rate FROM text_lines""",
    "reuse_results": V.using(V.TEXT_LINES) + """
SELECT image_id, line_no, 'read:' || md5(line) AS text, CAST(length(line) AS INT) AS size
FROM text_lines""",
    "reuse_known": V.using(V.TEXT_LINES) + """
SELECT CASE WHEN line IN (SELECT unnest(string_split(text, chr(10))) FROM conversations)
  THEN 'earlier' ELSE 'new' END AS origin, count(*) AS n FROM text_lines GROUP BY 1""",
    "known_regions": """
SELECT event_id, CASE WHEN event_type <> 'view' THEN upper(event_type) END AS known_text
FROM events""",
    "ctc_decode": V.using(V.STEPS, """kept AS (SELECT * FROM (SELECT *,
    lag(class_idx) OVER (PARTITION BY line_id ORDER BY ts, step_id) AS last FROM steps)
  WHERE class_idx <> 0 AND class_idx < 5 AND class_idx IS DISTINCT FROM last)""") + """
SELECT line_id, CAST(0 AS INT) AS part, coalesce(text, '') AS text,
  round(coalesce(confidence, 0), 6) AS confidence
FROM (SELECT DISTINCT line_id FROM steps) LEFT JOIN (SELECT line_id,
    string_agg(['<blank>', 'a', 'b', 'c', ' '][class_idx + 1], '' ORDER BY ts, step_id) AS text,
    avg(prob) AS confidence FROM kept GROUP BY line_id) USING (line_id)""",
    "ctc_matrix": V.using("""s AS (SELECT vec_id, t, m, list_position(p, m) - 1 AS idx FROM (
    SELECT vec_id, t, p, list_max(p) AS m FROM (
      SELECT vec_id, t, embedding[t * 4 + 1:t * 4 + 4] AS p
      FROM embeddings, (SELECT unnest(range(0, 16)) AS t)))),
kept AS (SELECT * FROM (SELECT *, lag(idx) OVER (PARTITION BY vec_id ORDER BY t) AS last FROM s)
  WHERE idx <> 0 AND idx < 5 AND idx IS DISTINCT FROM last)""") + """
SELECT vec_id, coalesce(text, '') AS text, round(coalesce(c, 0), 5) AS confidence
FROM embeddings LEFT JOIN (SELECT vec_id,
    string_agg(['<blank>', 'a', 'b', 'c', ' '][idx + 1], '' ORDER BY t) AS text,
    avg(CAST(m AS DOUBLE)) AS c FROM kept GROUP BY vec_id) USING (vec_id)""",
}
