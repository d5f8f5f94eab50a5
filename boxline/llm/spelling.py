"""Spelling variants by pivotal grams.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; a known share of
them is misspelt first (``misspelt``). Two words are near if they differ by exactly one inserted, deleted or
replaced code point.

The two-letter grams of a word are ordered by how many words hold them, rare ones first. The first ``PREFIX``
grams and those equal to the last of them are its prefix. Two prefix grams that don't overlap are its pivots: one
edit spoils one of them at most, and in the word whose prefix ends earlier the other one is in the prefix of the
near word too. Dynamic programming takes the pivots, and a split of the word between them, for which the texts
to look up are rarest. Positions are limited to one: an edit behind the split leaves the text before it as it is,
with the left pivot, and any other edit leaves the text behind it, with the right pivot. So each word looks up its two
halves, each with the part of the other half that the edit leaves too, among all starts and ends of other words
that hold a prefix gram. Pairs that meet are verified.

A form is the near word of largest count, if it is frequent enough; forms are followed to the last by joining
each word's form with that form's own, so the distance doubles each round.

Null and blank texts have no words; a null id misspells none. Repeated rows count each time. An empty table
gives no rows. Columns other than the key and the text aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.llm import words as W
from boxline.session import Rounds, pin

LEAST_LETTERS, LEAST_COUNT = 6, 5
# One word in so many is misspelt.
MISSPELT = 199
# How much more frequent than a word its form is.
RATIO = 5
# Rarest grams of a word in which pivots are sought; three always hold two that don't overlap.
PREFIX = 6
# How much rarer a text is taken to be for each letter more; it steers the choice of pivots only.
SHRINK = 0.1
# Words whose texts are sent on at once.
SIGNED = 2_000
# Bytes of text cut into words at once; a worker needs some fifty times as many.
BLOCK_BYTES = 1 << 19
# Words that a task counts before it sends them on.
HELD = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
# The lead byte of U+00C0 to U+00FF.
_LEAD = 0xC3


def misspelt(word: bytes, h: int) -> bytes:
    """``word`` without its code point h % length."""
    letters = word.decode()
    i = h % len(letters)
    return (letters[:i] + letters[i + 1:]).encode()


def _spans(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of all letter runs of a block, each within one text."""
    data = W._LOWER[block.data]
    inside = _LETTER[data] | (data == _LEAD)
    inside[1:] |= data[:-1] == _LEAD
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = block.offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    return data, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def block_words(keys: list, block: W.Block, least: int) -> list[tuple[bytes, int]]:
    """(word, count) of a block's words of at least ``least`` code points; a word may come twice."""
    data, starts, ends = _spans(block)
    leads = np.concatenate([[0], np.cumsum(data == _LEAD)])
    long = ends - starts - (leads[ends] - leads[starts]) >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return []
    hashes = W.span_hashes(data, starts, ends)
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    # Equal words of one text are misspelt alike.
    _, first, count = np.unique(
        hashes ^ W.mix(doc.astype(W.U64) + W.U64(1)), return_index=True, return_counts=True
    )
    raw = data.tobytes()
    # crc32 goes on from that of the id; texts without id are never misspelt.
    begin = [None if k is None else zlib.crc32(f"{k}:".encode()) for k in keys]
    marks = np.array([
        1 if begin[d] is None else zlib.crc32(raw[s:e], begin[d])
        for d, s, e in zip(doc[first].tolist(), starts[first].tolist(), ends[first].tolist())
    ], np.int64)
    hit = marks % MISSPELT == 0
    out = []
    for s, e, h, c in zip(*(x[hit].tolist() for x in (starts[first], ends[first], marks, count))):
        word = misspelt(raw[s:e], h)
        if len(word.decode()) >= least:
            out.append((word, c))
    first, count = first[~hit], count[~hit]
    _, one, place = np.unique(hashes[first], return_index=True, return_inverse=True)
    total = np.bincount(place, count).astype(np.int64)
    one = first[one]
    out += [(raw[s:e], c) for s, e, c in zip(starts[one].tolist(), ends[one].tolist(), total.tolist())]
    return out


def vocabulary(
    docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS,
    least: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n) of words with ``letters`` code points and ``least`` occurrences at least."""
    def batch_of(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())],
            ["word", "n"],
        )

    def count(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for block in W.blocks(batch.column(1), BLOCK_BYTES):
                own = keys[block.first:block.first + len(block)]
                for word, n in block_words(own, block, letters):
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield batch_of(held)
                    held = {}
        if held:
            yield batch_of(held)

    rows = docs.select(F.col(key), W.text_bytes(text).alias("_bytes"))
    counted = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def split_at(places: list[int], counts: list[int], length: int) -> int:
    """Where to split a word of ``length`` letters: between two grams that don't overlap.

    ``places`` of the prefix grams ascend, ``counts`` tell how many words hold each. A half costs the count of its
    rarest prefix gram, less by ``SHRINK`` for each further letter. One step per split: the rarest gram that ends
    before it and the rarest one that starts behind it.
    """
    splits = range(places[0] + 2, places[-1] + 1)
    left, right, rarest, k = {}, {}, float("inf"), 0
    for m in splits:
        while k < len(places) and places[k] + 2 <= m:
            rarest, k = min(rarest, counts[k]), k + 1
        left[m] = rarest * SHRINK ** (m - 2)
    rarest, k = float("inf"), len(places) - 1
    for m in reversed(splits):
        while k >= 0 and places[k] >= m:
            rarest, k = min(rarest, counts[k]), k - 1
        right[m] = rarest * SHRINK ** (length - m - 2)
    return min(splits, key=lambda m: left[m] + right[m])


def signature(word: str, rank: dict[str, int], count: dict[str, int]) -> tuple[list[str], list[str]]:
    """(texts that ``word`` looks up, texts under which it is found); ^ marks a start, $ an end.

    An edit behind the split is in the first or the second part of that half, which leaves either the half's end
    or a longer start, and likewise before the split. Lengths of the parts differ by one letter at most, so a word
    is found under each length that fits.
    """
    n = len(word)
    grams = [word[i:i + 2] for i in range(n - 1)]
    ranks = [rank[g] for g in grams]
    last = sorted(ranks)[min(PREFIX, len(ranks)) - 1]
    places = [i for i, r in enumerate(ranks) if r <= last]
    m = split_at(places, [count[grams[i]] for i in places], n)
    behind, before = m + (n - m) // 2, m // 2
    looked = [
        f"^{word[:behind]}", f"^{word[:m]}${word[behind:]}",
        f"${word[before:]}", f"^{word[:before]}${word[m:]}",
    ]
    first, final = places[0] + 2, places[-1]
    found = {f"^{word[:i]}" for i in range(first, n + 1)} | {f"${word[i:]}" for i in range(final + 1)}
    for i in range(first, n):
        found.update(f"^{word[:i]}${word[n - e:]}" for e in {(n - i + j) // 2 for j in (0, 1, 2)} if e)
    for i in range(1, final + 1):
        found.update(f"^{word[:e]}${word[i:]}" for e in {(i + j) // 2 for j in (-1, 0, 1)} if e)
    return looked, list(found)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), both ways, of near words among ``words`` (word, n); words have four letters at least.

    ``words`` is read twice, so it wants a table or checkpoint.
    """
    spark = words.sparkSession
    grams = words.select(F.explode(F.expr(
        "transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))"
    )).alias("gram")).groupBy("gram").count()
    # Two letters out of 90: 8,100 rows at most.
    held = sorted((r["count"], r["gram"]) for r in grams.collect())
    share = spark.sparkContext.broadcast(
        ({g: i for i, (_, g) in enumerate(held)}, {g: c for c, g in held})
    )

    def sign(batches):
        rank, count = share.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            for low in range(0, len(names), SIGNED):
                at, text, looked = [], [], []
                for i, word in enumerate(names[low:low + SIGNED], low):
                    mine, others = signature(word, rank, count)
                    text += mine + others
                    looked += [True] * len(mine) + [False] * len(others)
                    at += [i] * (len(mine) + len(others))
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text, pa.string()), pa.array(looked, pa.bool_()),
                     batch.column(0).take(at), batch.column(1).take(at)],
                    ["part", "looked", "word", "n"],
                )

    # Texts that share a hash only meet, and the check parts them.
    signed = pin(words.select("word", "n").mapInArrow(
        sign, "part string, looked boolean, word string, n bigint"
    ).select(F.xxhash64("part").alias("part"), "looked", "word", "n"))
    a, b = signed.where("looked").alias("a"), signed.where("not looked").alias("b")
    meet = (
        (F.col("a.part") == F.col("b.part"))
        & (F.abs(F.length("a.word") - F.length("b.word")) <= 1)
        & (F.levenshtein("a.word", "b.word", 1) == 1)
    )
    found = a.join(b, meet).select(
        F.col("a.word").alias("a"), F.col("a.n").alias("n_a"),
        F.col("b.word").alias("b"), F.col("b.n").alias("n_b"),
    )
    return found.union(found.select("b", "n_b", "a", "n_a")).distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last. Each form is more frequent, so paths end."""
    rounds = Rounds(forms.sparkSession, "roots")
    roots = rounds.write(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        after = rounds.write(roots.join(onward, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
        ))
        moved = not after.where("_moved").isEmpty()
        roots = after.select("word", "root")
        if not moved:
            return roots


def spelling_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS,
    least: int = LEAST_COUNT, ratio: int = RATIO,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    ``form`` is the near word of largest count (of equal ones the first in code-point order) if that count is
    ``ratio`` times the word's at least, else null; ``root`` is the last of its forms, or the word itself.
    """
    words = pin(vocabulary(docs, key, text, letters, least))
    # Largest count, then the first name: the smallest of (-n, name).
    near = near_pairs(words).groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("_best")
    )
    enough = -F.col("_best.less") >= ratio * F.col("n")
    told = pin(words.join(near, F.col("word") == F.col("a"), "left").select(
        "word", F.when(enough, F.col("_best.b")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, -F.col("_best.less")).alias("form_n"),
    ))
    roots = last_forms(told.where("form is not null")).withColumnRenamed("word", "_word")
    return told.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
