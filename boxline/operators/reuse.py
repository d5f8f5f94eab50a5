"""Reuse of results for equal or nearly equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.functions.fingerprint import hamming, similarity
from boxline.operators.hot import HOT_ROWS, hot_keys, lookup_join, split_hot
from boxline.session import Rounds, pin

# Rows per band bucket compared directly; larger buckets are split by further bits.
BAND_ROWS = 1_000
# Bits that are not cut again; 2 ** FEW_BITS fingerprints at most share a bucket then.
FEW_BITS = 10


def first_seen(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first item of each content key."""
    kept = [c for c in items.columns if c != key]
    first = items.groupBy(key).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("_f"))
    return first.select(key, *[F.col(f"_f.{c}").alias(c) for c in kept])


def label_hits(
    items: DataFrame, key: str, order: list[str], limit: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Adds ``is_hit``: false for the first item of each content key, true for later ones.

    ``order`` must end in a unique id.
    """
    first = items.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    joined = lookup_join(items, first, [key], limit=limit, hot=hot)
    return joined.withColumn("is_hit", F.struct(*order) != F.col("_first")).drop("_first")


def hit_statistics(items: DataFrame, key: str) -> DataFrame:
    """Requests, hits, misses and hit rate; the first item of a key is the miss."""
    per_key = items.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("requests"),
        (F.sum("n") - F.count(F.lit(1))).alias("hits"),
        F.count(F.lit(1)).alias("misses"),
    ).withColumn("hit_rate", F.try_divide("hits", "requests"))


def reuse_results(
    items: DataFrame, key: str, compute, known: DataFrame | None = None, limit: int = HOT_ROWS
) -> DataFrame:
    """Computes each content key once and gives the result to every item with that key.

    ``compute`` maps a frame of (key, payload) to (key, result columns). ``known`` is a table of
    earlier results with the same columns; only keys missing there are computed.
    """
    todo = first_seen(items, key, [c for c in items.columns if c != key])
    if known is None:
        results = compute(todo)
    else:
        fresh = compute(todo.join(known, key, "left_anti"))
        results = known.unionByName(fresh)
    return lookup_join(items, results, [key], how="left", limit=limit)


def known_regions(regions: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Adds ``known_text`` from a table (key, text) of regions with fixed text.

    The table is deduplicated by key; Spark broadcasts it when its size allows.
    """
    texts = table.groupBy(key).agg(F.min("text").alias("known_text"))
    return lookup_join(regions, texts, [key], how="left")


def with_added(table: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """A table (key, text) of known texts with entries added; an added entry replaces that of its key."""
    both = table.select(key, "text", F.lit(1).alias("_turn")).unionByName(
        added.select(key, "text", F.lit(0).alias("_turn"))
    )
    return both.groupBy(key).agg(F.min_by("text", F.struct("_turn", "text")).alias("text"))


def _cuts(used: int, bands: int) -> list[int] | None:
    """Masks that cut the bits not in ``used`` into ``bands`` bands of nearly equal size; None when few bits are left."""
    free = [b for b in range(64) if not used >> b & 1]
    if len(free) <= max(bands, FEW_BITS):
        return None
    edges = [len(free) * i // bands for i in range(bands + 1)]
    return [sum(1 << b for b in free[low:high]) for low, high in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(
    items: DataFrame, key: str = "fingerprint", max_distance: int = 3, limit: int = BAND_ROWS
) -> DataFrame:
    """Pairs of distinct 64-bit fingerprints within ``max_distance`` bits, with similarity.

    Equal fingerprints are first folded to one row with their count. Bits are cut into ``max_distance + 1`` bands,
    of which a close pair shares at least one. Buckets that hold many fingerprints are cut again by the bits not
    yet used: the differing bits all lie there, so a close pair shares one of those smaller bands too. A row carries
    the mask of its used bits, so a level is one frame, one search for crowded buckets and one join, however
    many ways of cutting it holds. Buckets are hashes; fingerprints that only share a hash are compared too.
    """
    spark, bands = items.sparkSession, max_distance + 1
    distinct = items.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rounds = Rounds(spark, "bands")
    level = distinct.select(
        F.col(key).cast("long").alias("h"), "n", F.lit(0).cast("long").alias("bucket"),
        F.lit(0).cast("long").alias("used"),
    )
    found, masks = None, {0}
    while True:
        cuts = {used: _cuts(used, bands) for used in masks}
        # bands ** level rows at most, and each level leaves a smaller share of the bits.
        table = spark.createDataFrame(
            [(_signed(used), i, _signed(mask)) for used, own in cuts.items() for i, mask in enumerate(own)],
            "used long, band int, mask long",
        )
        value = F.col("h").bitwiseAND(F.col("mask"))
        cut = rounds.write(level.join(F.broadcast(table), "used").select(
            "h", "n", F.xxhash64("bucket", "band", value).alias("bucket"),
            F.col("used").bitwiseOR(F.col("mask")).alias("used"),
        ))
        masks = {used | mask for used, own in cuts.items() for mask in own}
        more = all(_cuts(used, bands) for used in masks)
        crowded = hot_keys(cut, ["bucket"], limit) if more else None
        light, level = (cut, None) if crowded is None else split_hot(cut, crowded, ["bucket"])
        a, b = light.alias("a"), light.alias("b")
        pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.h") < F.col("b.h"))).where(
            hamming(F.col("a.h"), F.col("b.h")) <= max_distance
        ).select(
            F.col("a.h").alias("left"), F.col("b.h").alias("right"),
            F.col("a.n").alias("n_left"), F.col("b.n").alias("n_right"),
        )
        # A level's files last until the next but one is written, so its pairs are written before.
        pairs = pairs if found is None and level is None else pin(pairs.distinct())
        found = pairs if found is None else found.unionByName(pairs)
        if level is None:
            return found.distinct().withColumn("similarity", similarity(F.col("left"), F.col("right")))
