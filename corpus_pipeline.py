"""Corpus preparation: documents pass the stages in order, each stage's rows written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxline.llm import decontaminate, jaccard, mixing, quality, shards
from boxline.session import shared_path

# A document below this probability of being marked good is rejected.
LEAST_QUALITY = 0.3
# Shares of all tokens after mixing; where less is toxic already, everything stays once.
TARGETS = {"clean": 0.97, "toxic": 0.03}
# Least and largest rate of a document, by what the posterior calls it.
RATES = {"clean": (1.0, float("inf")), "toxic": (0.0, 1.0)}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier doesn't reject."""
    model = quality.train(
        docs, spark.read.parquet(f"{sf_dir}/labels.parquet"),
        keep=lambda key: ~quality.held_out(key),
    )
    kept = quality.score(docs, model, output="_score").where(F.col("_score") >= LEAST_QUALITY)
    return kept.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the least id, of each group of near duplicates."""
    return jaccard.one_per_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    found = decontaminate.benchmark_matches(
        docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), output="_matches"
    )
    return found.where(F.size("_matches") == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: toxic text once at most, clean text at least once."""
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
        .alias("domain"),
    )
    rated = mixing.mix(docs, marks, TARGETS, bounds=RATES)
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    return rated.where("_copies > 0").select(*docs.columns, copies.alias("_copy")).drop("_copy")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return shards.assign(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("mixing_to_targets", mixed),
    ("sharding", sharded),
]

# Trained models decide which rows stay, which SQL can't express; tests hold the stages against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents`` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
