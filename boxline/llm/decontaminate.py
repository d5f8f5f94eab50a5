"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are runs without white space and ASCII punctuation, A-Z folded. A seed is an n-gram of a test
item that is rare for its words: the product of its words' shares of all corpus tokens is at most
``RARE``. Rarity is thus judged by what a chance hit would be, not by how often the n-gram occurs, so
an item that leaked into a third of all documents keeps its seeds. Every item has its ``LEAST_SEEDS``
rarest n-grams as seeds in any case. Each place where a document holds seeds of an item is aligned
with the whole item; the score is the alignment's share of a perfect one. An item is held when the share is at least
the threshold, or when an alignment of ``LONG`` words or more has that share of its own words, however long the item is.
An item of fewer than ``n`` words is held by a document that has a line of just its words (score 1, no seeds).

Test items are a query set: they are searched in blocks of at most ``ITEM_BYTES``, each against all
documents. Null texts and ids are allowed: a document without words matches nothing, and so does an
item without words. Repeated items count once for each id; repeated documents are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, StructField, StructType,
)

from boxline.llm import words as W
from boxline.llm.worker import ship

WORDS = 3
RARE = 1e-8
LEAST_SEEDS = 4
THRESHOLD = 0.5
# Words of an alignment that are enough for themselves.
LONG = 50
# Bytes of test items that one block may hold; a longer item is a block of its own.
ITEM_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_FILTER_BITS = 22


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int]:
    """(score, start, end, words of the item) of the best local alignment of ``item`` within ``window``."""
    def best(a, b):
        steps = np.arange(len(b) + 1) * -GAP
        row, top, end, depth = np.zeros(len(b) + 1, np.int64), 0, 0, 0
        for i, word in enumerate(a):
            new = np.zeros(len(b) + 1, np.int64)
            new[1:] = np.maximum(row[:-1] + np.where(b == word, MATCH, MISMATCH), row[1:] + GAP)
            # A run of gaps in the item costs the same from wherever it starts.
            row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps) - steps, 0)
            at = int(row.argmax())
            if row[at] > top:
                top, end, depth = int(row[at]), at, i + 1
        return top, end, depth

    score, end, depth = best(item, window)
    _, length, covered = best(item[:depth][::-1], window[:end][::-1])
    return score, end - length, end, covered


class Items:
    """One block of test items: their words, and the seeds as sorted hashes."""

    def __init__(self, ids: list, texts: list[bytes], n: int):
        column = pa.array(texts, pa.large_binary())
        self.ids, self.words, self.n = [], [], n
        # Ids of items of so many words with such a hash, for those below n words.
        self.short: dict[tuple[int, int], list] = {}
        for block in W.blocks(column):
            found = W.words(block, punctuation=True)
            for i in range(len(block)):
                own, name = found.of(i), ids[block.first + i]
                if len(own) >= n:
                    self.ids.append(name)
                    self.words.append(own.copy())
                elif len(own):
                    self.short.setdefault((len(own), int(W.ngrams(own, len(own))[0])), []).append(name)
        every = np.concatenate(self.words) if self.words else np.zeros(0, W.U64)
        self.vocabulary = np.unique(every)

    def choose_seeds(self, counts: np.ndarray, total: int, rare: float = RARE) -> None:
        """``counts``: corpus tokens of each word of the vocabulary."""
        share = np.log((counts + 1.0) / (total + len(counts) + 1.0))
        hashes, owners = [], []
        for k, own in enumerate(self.words):
            logs = share[np.searchsorted(self.vocabulary, own)]
            m = len(own) - self.n + 1
            rate = sum(logs[j:j + m] for j in range(self.n))
            keep = rate <= np.log(rare)
            keep[np.argsort(rate, kind="stable")[:LEAST_SEEDS]] = True
            seeds = np.unique(W.ngrams(own, self.n)[keep])
            hashes.append(seeds), owners.append(np.full(len(seeds), k))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, W.U64)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.seeds, self.owners = hashes[order], owners[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.seeds >> W.U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def matches(self, own: np.ndarray, threshold: float) -> list[tuple]:
        """(item, score, seeds, start, end) of the items that a document's words hold."""
        grams = W.ngrams(own, self.n)
        places = np.flatnonzero(self.filter[(grams >> W.U64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(places):
            return []
        low = np.searchsorted(self.seeds, grams[places], "left")
        high = np.searchsorted(self.seeds, grams[places], "right")
        hits: dict[int, list[int]] = {}
        for place, x, y in zip(places.tolist(), low.tolist(), high.tolist()):
            for owner in self.owners[x:y].tolist():
                hits.setdefault(owner, []).append(place)
        out = []
        for owner, found in sorted(hits.items()):
            item, best = self.words[owner], None
            size, begin = len(item), 0
            for k in range(1, len(found) + 1):
                # Seeds further apart than the item is long belong to different passages.
                if k < len(found) and found[k] - found[k - 1] <= size:
                    continue
                first = max(0, found[begin] - size)
                window = own[first:found[k - 1] + self.n + size]
                score, start, end, covered = align(item, window)
                share = score / (MATCH * size)
                held = share >= threshold or covered >= LONG and score >= threshold * MATCH * covered
                if held and (best is None or share > best[1]):
                    best = (self.ids[owner], share, k - begin, first + start, first + end)
                begin = k
            if best:
                out.append(best)
        return out


    def short_matches(self, own: np.ndarray, lines: np.ndarray) -> list[tuple]:
        """The same for items below n words; ``lines`` numbers the line of each word."""
        starts = np.flatnonzero(np.diff(lines, prepend=-1))
        lengths, out = np.diff(np.append(starts, len(own))), {}
        for m in {m for m, _ in self.short}:
            places = starts[lengths == m]
            for place, gram in zip(places.tolist(), W.ngrams(own, m)[places].tolist()):
                for name in self.short.get((m, gram), ()):
                    out.setdefault(name, (name, 1.0, 0, place, place + m))
        return list(out.values())


def _blocks(items: DataFrame, key: str, text: str, n: int, limit: int):
    """Blocks of test items, each fetched within ``limit`` bytes."""
    rows = items.select(F.col(key).alias("_id"), W.text_bytes(text).alias("_text")).distinct()
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    count = -(-size // limit) or 1
    for k in range(count):
        # A hash deals items out evenly; one block is near the limit, never the whole table.
        part = rows.where(F.pmod(F.xxhash64("_text", "_id"), F.lit(count)) == k)
        got = part.orderBy("_id", "_text").collect()
        yield Items([r["_id"] for r in got], [bytes(r["_text"]) for r in got], n)


def _word_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Corpus tokens of every word of a block's vocabulary, and of all words."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), 0
    share = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = share.value
        counts, total = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for block in W.blocks(batch.column(0)):
                found = W.words(block, punctuation=True).hashes
                total += len(found)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                counts += np.bincount(at[known[at] == found], minlength=len(known))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], total))],
            ["word", "n"],
        )

    got = docs.select(W.text_bytes(text)).mapInArrow(count, "word bigint, n bigint")
    # At most one row for each word of the block.
    sums = {r["word"]: r["n"] for r in got.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    counts = np.array([sums.get(i, 0) for i in range(len(vocabulary))], np.int64)
    return counts, sums.get(-1, 0)


def benchmark_matches(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
    item_text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, rare: float = RARE,
    item_bytes: int = ITEM_BYTES, output: str = "matches",
) -> DataFrame:
    """``docs`` with ``output``: an array of (item id, score, seeds, start, end) of matched items.

    ``start`` and ``end`` are word positions in the document; of several passages that match one
    item the best is given, the first of equal ones.
    """
    kind = items.schema[item_key].dataType
    match = StructType([
        StructField("item", kind), StructField("score", DoubleType()),
        StructField("seeds", IntegerType()), StructField("start", LongType()),
        StructField("end", LongType()),
    ])
    carried = [c for c in docs.columns if c != output]
    out = docs.select(*carried)
    fields = [docs.schema[c] for c in carried]
    names = []
    for k, block in enumerate(_blocks(items, item_key, item_text, n, item_bytes)):
        if not block.words and not block.short:
            continue
        block.choose_seeds(*_word_counts(docs, text, block.vocabulary), rare)
        share = ship(docs.sparkSession, block)
        name = f"_matches_{k}"

        def search(batches, share=share, columns=[*out.columns, name]):
            own = share()
            for batch in batches:
                found = []
                for part in W.blocks(batch.column(0)):
                    grams = W.words(part, punctuation=True)
                    found += [own.matches(grams.of(i), threshold) for i in range(len(part))]
                    if own.short:
                        line = np.cumsum(part.data == ord("\n"))[grams.starts]
                        for i in range(len(part)):
                            words = slice(grams.offsets[i], grams.offsets[i + 1])
                            found[part.first + i] += own.short_matches(grams.hashes[words], line[words])
                found = [
                    [dict(zip(("item", "score", "seeds", "start", "end"), m)) for m in ms]
                    for ms in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array(found, to_arrow_type(ArrayType(match)))], columns
                )

        fields = [*fields, StructField(name, ArrayType(match))]
        out = out.select(W.text_bytes(text).alias("_text_bytes"), *out.columns)
        out = out.mapInArrow(search, StructType(fields))
        names.append(name)
    if not names:
        return out.withColumn(output, F.array().cast(ArrayType(match)))
    return out.withColumn(output, F.flatten(F.array(*names))).drop(*names)
