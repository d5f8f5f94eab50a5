"""Jaccard join of texts over word n-grams, with Bayesian pruning of candidates.

Texts with the same set of word shingles form a class. Classes that share a band of MinHash values
are candidates. Their MinHash values are compared ``STEP`` at a time; a pair is dropped once the
posterior probability that its similarity reaches the threshold falls below ``TOLERANCE``. What is
left is verified on the whole shingle sets.

Work that grows with the square of a group stays inside numpy blocks of bounded size and never
becomes rows: a bucket, or a group of similar texts, is cut into parts by hash, and each pair of
parts is one unit of work. Rows that leave a unit are a spanning forest and counts per class.

Words are split at ASCII white space and A-Z is folded. A text of fewer than ``n`` words is one
shingle. A text without words (null, empty, blank) links to nothing and is a class of its own.
Repeated rows, also with one id, are copies: each is one document of its class. A null id is a
document like any other. Two texts of similarity s miss each other in all bands with probability
(1 - s^5)^32, 3e-6 at s = 0.8; pruning adds at most ``TOLERANCE`` a step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.llm import words as W
from boxline.llm.components import components
from boxline.llm.groups import sorted_groups
from boxline.session import pin

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
# MinHash values compared between two looks at the posterior.
STEP = 32
TOLERANCE = 1e-6
# Classes in one part of a bucket (narrow rows) and of a group of similar texts (whole texts).
BUCKET_PART = 4096
GROUP_PART = 256
# Columns of the indicator matrix held at once when many pairs are verified together.
STRIP = 4096

_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, HASHES, dtype=np.int64).astype(W.U64)
_MULTIPLIERS = _MULTIPLIERS * W.U64(2) + W.U64(1)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``HASHES`` least values per shingle set; sets must not be empty."""
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    values = np.concatenate(sets)
    out, product = np.empty((len(sets), HASHES), W.U64), np.empty_like(values)
    for k, factor in enumerate(_MULTIPLIERS):
        # The high half of a product is well spread; the low half hardly depends on the factor.
        np.multiply(values, factor, out=product)
        out[:, k] = np.minimum.reduceat(product, offsets)
    return out


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones that keep a pair), one for each step.

    Values are compared by one byte, so unlike sets agree on s = j + (1 - j) / 256 of them. With a
    uniform prior, s given m of n equal is Beta(m + 1, n - m + 1), and the probability that it
    reaches the threshold is that of at most m successes in n + 1 draws at the threshold.
    """
    s = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def unpruned(one: np.ndarray, others: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """Places of ``others`` (byte signatures) that may reach the threshold with ``one``."""
    places, equal, low = np.arange(len(others)), np.zeros(len(others), np.int32), 0
    for n, least in rule:
        equal = equal + (others[places, low:n] == one[low:n]).sum(axis=1, dtype=np.int32)
        keep = equal >= least
        places, equal, low = places[keep], equal[keep], n
        if not len(places):
            break
    return places


def _signatures(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(doc, digest, text_digest, words of the set, byte signature, band keys) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_doc {kind}, _text_key binary, _set binary, _sig binary, _bands array<bigint>"

    def apply(batches):
        for batch in batches:
            digests, signatures, bands = [], [], []
            for block in W.blocks(batch.column(2)):
                found = W.words(block)
                sets = [W.shingles(found.of(i), n) for i in range(len(block))]
                full = [i for i, s in enumerate(sets) if len(s)]
                least = minhash([sets[i] for i in full]) if full else np.zeros((0, HASHES), W.U64)
                grouped = (least >> W.U64(32)).reshape(len(full), BANDS, ROWS)
                joined = np.zeros((len(full), BANDS), W.U64) + np.arange(BANDS, dtype=W.U64)
                for r in range(ROWS):
                    joined = W.mix(joined * W.U64(W._BASE) + grouped[:, :, r])
                row = dict(zip(full, range(len(full))))
                for i, s in enumerate(sets):
                    at = row.get(i)
                    if at is None:
                        digests.append(None), signatures.append(None), bands.append(None)
                        continue
                    # Two sums over differently mixed shingles and the count name the set.
                    pair = np.array([s.sum(dtype=W.U64), W.mix(s).sum(dtype=W.U64) + W.U64(len(s))])
                    digests.append(W.mix(pair).astype(">u8").tobytes())
                    signatures.append((least[at] >> W.U64(40)).astype(np.uint8).tobytes())
                    bands.append(W.signed(joined[at]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(digests, pa.binary()),
                pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
            ], ["_doc", "_text_key", "_set", "_sig", "_bands"])

    return docs.select(
        F.col(key).alias("_doc"), _text_key(text), W.text_bytes(text).alias("_bytes")
    ).mapInArrow(apply, schema)


def _member() -> Column:
    """What rows of a class are ordered by: the id, null last, then the text."""
    return F.struct(F.col("_doc").isNull().alias("_null"), "_doc", "_text_key")


def _text_key(text: str) -> Column:
    return F.unhex(F.md5(W.text_bytes(text))).alias("_text_key")


def _parts(df: DataFrame, size: str, limit: int, groups: list[str]) -> DataFrame:
    """Rows once for every pair of parts that they belong to: adds _part, _low and _high."""
    parts = F.ceil(F.col(size) / F.lit(limit)).cast("int")
    return (
        df.withColumn("_parts", parts)
        .withColumn("_part", F.pmod(F.xxhash64("_set"), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("_low", F.least("_part", "_other"))
        .withColumn("_high", F.greatest("_part", "_other"))
        .drop("_parts", "_other")
    )


def _candidate_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect the classes of a band that survive the pruning, as stars."""
    bands = classes.select("_set", F.explode("_bands").alias("_band"))
    # Buckets with the same members in several bands are looked at once; members are named by
    # their count and 128 bits.
    buckets = (
        bands.groupBy("_band").agg(
            F.count(F.lit(1)).alias("_size"),
            F.bit_xor(F.xxhash64("_set")).alias("_x"),
            F.bit_xor(F.xxhash64("_set", F.lit(1))).alias("_y"),
        ).where("_size > 1")
        .groupBy("_size", "_x", "_y").agg(F.min("_band").alias("_band"))
        .select("_band", "_size")
    )
    members = bands.join(buckets, "_band")
    units = _parts(
        members.join(classes.select("_set", "_sig"), "_set"), "_size", BUCKET_PART, ["_band"]
    )
    rule = least_matches(threshold)

    def apply(batches):
        for unit in sorted_groups(batches, ["_band", "_low", "_high"]):
            keys = unit.column("_set").to_pylist()
            signs = np.frombuffer(b"".join(unit.column("_sig").to_pylist()), np.uint8)
            signs = signs.reshape(len(keys), HASHES)
            left, a, b = np.arange(len(keys)), [], []
            while len(left) > 1:
                queue, members, left = [left[0]], [keys[left[0]]], left[1:]
                while queue and len(left):
                    at = queue.pop()
                    near = unpruned(signs[at], signs[left], rule)
                    members += [keys[i] for i in left[near]]
                    queue += list(left[near])
                    left = np.delete(left, near)
                # A star around the least member is the same edge from most bands of a group.
                least = min(members)
                a += [k for k in members if k != least]
                b += [least] * (len(members) - 1)
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"]
                )

    keyed = units.select("_band", "_low", "_high", "_set", "_sig")
    return (
        keyed.repartition("_band", "_low", "_high").sortWithinPartitions("_band", "_low", "_high")
        .mapInArrow(apply, "a binary, b binary")
    )


def _intersections(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs."""
    if len(rows) < 4 * len(sets):
        return np.array([
            len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(rows, columns)
        ], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    dense = (np.cumsum(shared) - 1)[place]
    keep = shared[place]
    dense, owner = dense[keep], owner[keep]
    order = np.argsort(dense, kind="stable")
    dense, owner = dense[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(shared.sum()), STRIP):
        x, y = np.searchsorted(dense, [low, low + STRIP])
        part = np.zeros((len(sets), STRIP), np.float32)
        part[owner[x:y], dense[x:y] - low] = 1
        total += part @ part.T
    return np.rint(total[rows, columns]).astype(np.int64)


def _survivors(signs: np.ndarray, part: np.ndarray, whole: bool, rule: list) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a unit that survive the pruning: all of them, or those of different parts."""
    rows, columns = [], []
    for i in range(len(signs)):
        others = np.arange(i + 1, len(signs))
        if not whole:
            others = others[part[i + 1:] != part[i]]
        near = others[unpruned(signs[i], signs[others], rule)]
        rows.append(np.full(len(near), i))
        columns.append(near)
    return np.concatenate(rows), np.concatenate(columns)


def _unit_signs(unit: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(unit.column("_sig").to_pylist()), np.uint8).reshape(unit.num_rows, HASHES)


_UNIT = ["_group", "_low", "_high", "_part", "_set", "_sig", "_copies"]


def _needed(groups: DataFrame, threshold: float) -> DataFrame:
    """``_UNIT`` rows of the classes that have a pair to verify in their unit, found by signatures alone.

    A group's units grow with the square of its parts, but a text goes only to those that this names.
    """
    rule = least_matches(threshold)

    def apply(batches):
        for unit in sorted_groups(batches, ["_group", "_low", "_high"]):
            whole = unit.column("_low")[0].as_py() == unit.column("_high")[0].as_py()
            rows, columns = _survivors(_unit_signs(unit), unit.column("_part").to_numpy(), whole, rule)
            if len(rows):
                some = np.zeros(unit.num_rows, bool)
                some[rows] = some[columns] = True
                yield from unit.filter(pa.array(some)).to_batches()

    units = _parts(groups, "_size", GROUP_PART, ["_group"]).select(*_UNIT)
    return (
        units.repartition("_group", "_low", "_high").sortWithinPartitions("_group", "_low", "_high")
        .mapInArrow(apply, units.schema)
    )


def _verified(units: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """Links of classes in units: rows (a, b, texts, documents).

    Rows with ``b`` connect what links that hold connect, as stars; rows without give, for class ``a``, how
    many classes and documents it links to within one unit of work.
    """
    rule = least_matches(threshold)

    def apply(batches):
        for unit in sorted_groups(batches, ["_group", "_low", "_high"]):
            low, high = unit.column("_low")[0].as_py(), unit.column("_high")[0].as_py()
            keys, part = unit.column("_set").to_pylist(), unit.column("_part").to_numpy()
            copies = unit.column("_copies").to_numpy()
            sets = []
            for block in W.blocks(unit.column("_bytes").combine_chunks()):
                found = W.words(block)
                sets += [W.shingles(found.of(i), n) for i in range(len(block))]
            rows, columns = _survivors(_unit_signs(unit), part, low == high, rule)
            if not len(rows):
                continue
            both = _intersections(sets, rows, columns)
            sizes = np.array([len(s) for s in sets])
            # An exact test in whole numbers when the threshold is a decimal of three places.
            scale = round(threshold * 1000)
            link = both * 1000 >= scale * (sizes[rows] + sizes[columns] - both)
            rows, columns = rows[link], columns[link]
            if not len(rows):
                continue
            size = len(keys)
            reps = np.bincount(rows, minlength=size) + np.bincount(columns, minlength=size)
            docs = (
                np.bincount(rows, copies[columns], size) + np.bincount(columns, copies[rows], size)
            ).astype(np.int64)
            root = list(range(size))

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in zip(rows.tolist(), columns.tolist()):
                x, y = find(i), find(j)
                # The root is the least class of its tree, so that edges form stars.
                if x != y:
                    x, y = (x, y) if keys[x] < keys[y] else (y, x)
                    root[y] = x
            seen = np.flatnonzero(reps)
            a = [keys[i] for i in seen if find(i) != i]
            b = [keys[find(i)] for i in seen if find(i) != i]
            m, k = len(a), len(seen)
            yield pa.RecordBatch.from_arrays([
                pa.array(a + [keys[i] for i in seen], pa.binary()),
                pa.array(b + [None] * k, pa.binary()),
                pa.array(np.concatenate([np.zeros(m, np.int64), reps[seen]])),
                pa.array(np.concatenate([np.zeros(m, np.int64), docs[seen]])),
            ], ["a", "b", "texts", "documents"])

    keyed = units.join(texts, "_set").select(*_UNIT, "_bytes")
    return (
        keyed.repartition("_group", "_low", "_high")
        .sortWithinPartitions("_group", "_low", "_high")
        .mapInArrow(apply, "a binary, b binary, texts bigint, documents bigint")
    )


def jaccard_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS,
    threshold: float = THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes).

    ``rows``: _doc (the id), _text_key (md5 of the text) and _set (its class; null without words) of
    every row. ``classes``: _set, _copies (documents in the class), _first (the row of least id), _links and _text_links (documents and classes in other classes at ``threshold`` or
    more), _group (a class name shared by all that are connected by links).
    """
    rows = pin(_signatures(docs, key, text, n))
    classes = pin(rows.where(F.col("_set").isNotNull()).groupBy("_set").agg(
        F.count(F.lit(1)).alias("_copies"), F.min(_member()).alias("_first"),
        F.first("_sig").alias("_sig"), F.first("_bands").alias("_bands"),
    ))
    near = components(_candidate_edges(classes, threshold))
    sizes = near.groupBy("label").agg(F.count(F.lit(1)).alias("_size"))
    grouped = pin(
        near.join(sizes, "label").withColumnsRenamed({"label": "_group", "node": "_set"})
        .join(classes.select("_set", "_copies", "_sig", "_first"), "_set")
    )
    units = pin(_needed(grouped.select("_group", "_size", "_set", "_copies", "_sig"), threshold))
    # One row of each class: copies have the text in common, so the id is part of the key.
    wanted = grouped.join(units.select("_set").distinct(), "_set", "left_semi").select(
        "_set", F.col("_first._doc").alias("_id"), F.col("_first._text_key").alias("_key")
    )
    texts = docs.select(F.col(key).alias("_doc"), _text_key(text), W.text_bytes(text).alias("_bytes")).join(
        wanted, (F.col("_text_key") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id"))
    ).select("_set", "_bytes").dropDuplicates(["_set"])
    links = pin(_verified(units, texts, threshold, n))
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("_set")).agg(
        F.sum("texts").alias("_text_links"), F.sum("documents").alias("_links")
    )
    joined = components(links.where("b IS NOT NULL").select("a", "b")).select(
        F.col("node").alias("_set"), F.col("label").alias("_group")
    )
    plain = classes.drop("_sig", "_bands")
    return rows.select("_doc", "_text_key", "_set"), pin(
        plain.join(counts.join(joined, "_set", "full"), "_set", "left").select(
            *plain.columns, F.coalesce("_links", F.lit(0)).alias("_links"),
            F.coalesce("_text_links", F.lit(0)).alias("_text_links"),
            F.coalesce("_group", "_set").alias("_group"),
        )
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: its id, class_id, copy_id, n_links, n_text_links.

    ``class_id`` is the least id of all documents connected by links, ``copy_id`` the least id of those
    with the same shingle set; ``n_links`` counts the other documents at the threshold or more,
    ``n_text_links`` the other shingle sets. A document without words is its own class.
    """
    rows, classes = jaccard_classes(docs, key, text, **options)
    least = classes.groupBy("_group").agg(F.min("_first")["_doc"].alias("_class"))
    named = classes.join(least, "_group").select(
        "_set", "_class", F.col("_first._doc").alias("_least"), "_text_links", (F.col("_links") + F.col("_copies") - 1).alias("_n")
    )
    return rows.join(named, "_set", "left").select(
        F.col("_doc").alias(key),
        F.when(F.col("_set").isNull(), F.col("_doc")).otherwise(F.col("_class")).alias("class_id"),
        F.when(F.col("_set").isNull(), F.col("_doc")).otherwise(F.col("_least")).alias("copy_id"),
        F.coalesce("_n", F.lit(0)).alias("n_links"),
        F.coalesce("_text_links", F.lit(0)).alias("n_text_links"),
    )


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group connected by links: that of the least id.

    Of rows with that id and different texts the least text key counts, of equal rows one. Documents
    without words are a group of equal texts each: one of each blank text stays.
    """
    rows, classes = jaccard_classes(docs, key, text, **options)
    blank = rows.where("_set IS NULL").groupBy("_text_key").agg(F.min(_member()).alias("_m"))
    chosen = (
        classes.groupBy("_group").agg(F.min("_first").alias("_m")).select("_m")
        .union(blank.select("_m"))
        .select(F.col("_m._doc").alias("_doc"), F.col("_m._text_key").alias("_key"))
    )
    whole = docs.select(*docs.columns, _text_key(text)).join(
        chosen, (F.col("_text_key") == F.col("_key")) & F.col(key).eqNullSafe(F.col("_doc")),
        "left_semi",
    )
    return whole.dropDuplicates(["_text_key"]).select(*docs.columns)
