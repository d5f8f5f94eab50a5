"""One query per operator, over whole tables, and SQL where it can give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxline.llm import (
    decontaminate, extract, jaccard, lblm, mixing, pseudonyms, quality, rules, runs, shards, spelling,
    tokens, topk,
)
from boxline.session import shared_path

# Shares of all tokens that the mix should have.
TARGETS = {"good": 0.87, "poor": 0.08, "toxic": 0.05}

# A stand-in for a secret that a user supplies.
PSEUDONYM_KEY = b"catalogue query"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Token rates of all documents for a target mix of good, poor and toxic text."""
    marks = table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
        .when(F.col("quality") == 0, "poor").alias("domain"),
    )
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rated = mixing.mix(docs, marks, TARGETS)
    return rated.select(
        "doc_id", F.col("_tokens").alias("n_tokens"),
        *(F.col("_posterior")[k].alias(f"p_{name}") for k, name in enumerate(TARGETS)),
        F.col("_rate").alias("rate"), F.col("_copies").alias("copies"),
    )


def op2_log_bilinear_model(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probability of every document, learned outside one seventh."""
    return lblm.language_model_scores(table(spark, folder, "documents").select("doc_id", "text"))


def op3_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, rule posterior and verdict of every document."""
    judged = rules.judge(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "p_good",
    )


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and test item whose text it holds, with the alignment."""
    found = decontaminate.benchmark_matches(
        table(spark, folder, "documents").select("doc_id", "text"),
        table(spark, folder, "benchmark"),
    )
    return found.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", F.col("m.item").alias("item_id"), F.col("m.score").alias("score"),
        F.col("m.seeds").alias("n_seeds"), F.col("m.start").alias("start_word"),
        F.col("m.end").alias("end_word"),
    )


def op5_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data under pseudonyms, and how much there was."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    total = sum((F.col(f"n_{k}") for k in pseudonyms.KINDS), F.lit(0))
    return done.withColumn("n_found", total)


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality probability of every document, learned outside the held-out fifth."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(
        docs, table(spark, folder, "labels"), keep=lambda key: ~quality.held_out(key)
    )
    return quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids, written in shards and read back."""
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    place = shared_path(spark, "tokens")
    tokens.write_tokens(docs, place, public_tokenizers.path("word_bpe_49k.json"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return tokens.document_digests(spark, place, kind).withColumnRenamed("doc", "doc_id")


def op8_histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; copies of a text stand together."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return shards.assign(docs, with_text=False).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract.extract_text(pages, extract.train(pages))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document and its number of links."""
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op11_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with its near words' count, its form and its root."""
    return spelling.spelling_groups(table(spark, folder, "documents").select("doc_id", "text"))


def op12_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all others."""
    found = topk.top_k(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document's words, one text in ten with a repeated tail."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return runs.periodic_runs(docs, repeat_tails=True, whole=False).drop("n_words")


QUERIES = {f.__name__: f for f in (
    op1_soft_mixing, op2_log_bilinear_model, op3_weak_supervision, op4_decontamination,
    op5_pseudonyms, op6_quality_classifier, op7_token_files, op8_histogram_shards, op9_main_text,
    op10_jaccard_join, op11_spelling_groups, op12_top_k, op13_periodic_runs,
)}
SQL: dict[str, str] = {
    "op12_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.r AS q_r, q.vec_id AS query_id, v.r, v.vec_id,
         CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.r <> v.r WHERE q.vec_id % 20 = 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY q_r ORDER BY score DESC, vec_id, r) AS n FROM p
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM o WHERE n <= 20
""",
}
