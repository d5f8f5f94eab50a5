"""Queries over recognised text: cleaning, splitting, error rates, joining."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxline import fixtures as X
from boxline.functions import text as T
from boxline.operators.evaluation import character_error_rate
from boxline.operators.recognition import join_lines
from boxline.plans.catalog import views as V


def text_normalise(spark, folder):
    docs = X.table(spark, folder, "documents")
    return docs.select("doc_id", F.md5(T.normalise(F.col("text"))).alias("digest"))


def error_rate(spark, folder):
    """Character errors of a recogniser that drops every letter e, per role."""
    rows = X.table(spark, folder, "conversations").select(
        "role", F.col("text").alias("truth"),
        F.translate("text", "e", "").alias("predicted"),
    )
    return character_error_rate(rows, ["role"]).withColumn("cer", F.round("cer", 6))


def text_preview(spark, folder):
    rows = X.table(spark, folder, "conversations")
    share = F.length("text") / 1999.0
    return rows.select(
        "conv_id", "turn", T.preview(F.col("text")).alias("preview"),
        F.round(T.rounded(share), 3).alias("share"), T.percent(share).alias("percent"),
    )


def _combined(spark, folder):
    """Each message as a combined text of its lines, with the number of lines it came from."""
    rows = X.table(spark, folder, "conversations")
    lines = F.split("text", "\n", -1)
    return rows.select(
        "conv_id", "turn", "role",
        F.when(F.col("role") == "user", F.array_join(lines, "|"))
        .otherwise(F.array_join(lines, "   ")).alias("text"),
        F.size(lines).alias("n"),
    )


def _split_rows(rows, parts):
    return rows.select("conv_id", "turn", "role", F.posexplode(parts).alias("part", "text"))


def split_batch(spark, folder):
    rows = _combined(spark, folder)
    return _split_rows(rows, T.split_batch(F.col("text"), F.col("n")))


def split_lines(spark, folder):
    rows = _combined(spark, folder)
    return _split_rows(rows, T.split_lines(F.col("text"), F.col("n")))


def joined_lines(spark, folder):
    lines = X.text_lines(spark, folder).withColumnRenamed("line", "text")
    return join_lines(lines, ["image_id"]).withColumn("text", F.md5("text"))


QUERIES = {f.__name__: f for f in (
    text_normalise, error_rate, text_preview, split_batch, split_lines, joined_lines,
)}

_COMBINED = """combined AS (SELECT conv_id, turn, role, len(string_split(text, chr(10))) AS n,
    CASE WHEN role = 'user' THEN replace(text, chr(10), '|')
      ELSE replace(text, chr(10), '   ') END AS text
  FROM conversations)"""


def _cut() -> str:
    return """list_transform(range(0, n), lambda i: trim(substr(text, i * (length(text) // n) + 1,
      CASE WHEN i < n - 1 THEN length(text) // n ELSE length(text) END)))"""


def _batch_case() -> str:
    branches = []
    for sep in T.BATCH_SEPARATORS:
        p = f"string_split(text, '{sep}')"
        branches.append(f"""WHEN contains(text, '{sep}') AND abs(len({p}) - n) <= 1 THEN
      CASE WHEN len({p}) > n THEN {p}[1:n - 1] || [array_to_string({p}[n:], '{sep}')]
        WHEN len({p}) < n THEN {p} || ['' FOR k IN range(1)] ELSE {p} END""")
    p = r"regexp_split_to_array(text, '\s{2,}')"
    branches.append(f"""WHEN abs(len({p}) - n) <= 1 THEN
      CASE WHEN len({p}) < n THEN {p} || [''] ELSE {p}[1:n] END""")
    body = "\n    ".join(branches).replace("['' FOR k IN range(1)]", "['']")
    return f"""CASE WHEN text = '' THEN list_transform(range(0, n), lambda i: '')
    WHEN n = 1 THEN [text] {body} ELSE {_cut()} END"""


def _line_case() -> str:
    branches = [
        f"WHEN contains(text, '{sep}') AND len(string_split(text, '{sep}')) = n "
        f"THEN string_split(text, '{sep}')"
        for sep in T.LINE_SEPARATORS
    ]
    body = "\n    ".join(branches)
    return f"""CASE WHEN text = '' THEN list_transform(range(0, n), lambda i: '') {body}
    WHEN length(text) > n * 2 THEN {_cut()}
    ELSE [text] || list_transform(range(1, n), lambda i: '') END"""


def _opened(case: str) -> str:
    space = r"'^\s+|\s+$'"
    return V.using(_COMBINED, f"parts AS (SELECT *, {case} AS p FROM combined)") + f"""
SELECT conv_id, turn, role, CAST(i - 1 AS INT) AS part,
  CASE WHEN n = 1 THEN p[i] ELSE regexp_replace(p[i], {space}, '', 'g') END AS text
FROM parts, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)"""


SQL = {
    "text_normalise": r"""
SELECT doc_id, md5(regexp_replace(translate(regexp_replace(text,
  '^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\v]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\v]+$',
  '', 'g'), '""" + T.WIDE_CHARS + "', '" + T.NARROW_CHARS + r"""'),
  '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\v]+',
  ' ', 'g')) AS digest FROM documents""",
    "error_rate": """
SELECT role, CAST(sum(length(text) - length(replace(text, 'e', ''))) AS BIGINT) AS edits,
  CAST(sum(length(text)) AS BIGINT) AS chars,
  round(sum(length(text) - length(replace(text, 'e', ''))) / sum(length(text)), 6) AS cer
FROM conversations GROUP BY role""",
    "text_preview": """
SELECT conv_id, turn, substr(text, 1, 30) AS preview,
  round(round_even(length(text) / 1999.0::DOUBLE, 3), 3) AS share,
  printf('%.2f%%', length(text) / 1999.0::DOUBLE * 100) AS percent
FROM conversations""",
    "split_batch": _opened(_batch_case()),
    "split_lines": _opened(_line_case()).replace("CASE WHEN n = 1 THEN p[i] ELSE", "CASE WHEN false THEN p[i] ELSE"),
    "joined_lines": V.using(V.TEXT_LINES) + """
SELECT image_id, CAST(line_no // 1000 AS BIGINT) AS part,
  md5(string_agg(line, ' ' ORDER BY line_no)) AS text
FROM text_lines GROUP BY 1, 2""",
}
