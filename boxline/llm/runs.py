"""Periodic runs of words by internal pattern matching.

A run is a longest stretch of words with smallest period q (words q apart are equal) of at least
``max(LEAST_WORDS, 2 * q)`` words. The part of a run that repeats q words later holds a block of 2^k words at a
multiple of its length, where 2 * 2^k - 1 <= q <= 4 * 2^k - 2, and the block occurs again q words after itself.
So every block asks for its occurrences in the window of those distances:

* Suffixes of a text are sorted by doubling: each level ranks all stretches of 2^k words, and equal stretches
  are one interval of the suffix array. Only words whose four-word stretch recurs in their text take part; all
  other suffixes can't be an occurrence of anything.
* A wavelet tree over the suffix array gives the range successor: the first place at or after x within an
  interval, in one step per bit.
* Two occurrences at most half a block apart start an arithmetic progression, whose end follows from one
  extension query. In the block's own progression only the first term can be a smallest period; the terms of
  another one are all candidates.
* A candidate is extended in both directions over the ranks, longest stretches first. Of periods that give the
  same stretch the smallest is kept.

Texts are rows, and each is worked on alone, in blocks of texts of about 2 MB in numpy; a text takes about 4
bytes for each recurring word and level. Words are compared by 64-bit hashes (``words.py``).

Null, empty and blank texts have no words and no runs. A null id is carried. Repeated rows get equal rows, and
an empty table gives none. Columns of ``docs`` other than the key and the text aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.llm import words as W

LEAST_WORDS = 12
# Words of the shortest block, 2^LEVEL.
LEVEL = 2
BLOCK = 1 << LEVEL

OUTPUT = (
    "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string, collapsed string, "
    "runs array<struct<start:bigint,length:bigint,period:bigint>>"
)


class WaveletTree:
    """Range successor over a sequence of the numbers below its length, each once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            low = (values >> bit) & 1 == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(low, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[low], values[~low]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value >= ``least`` at [``low``, ``high``), or -1."""
        a, b, below = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for level, before in enumerate(self.zeros):
            one = (least >> (self.bits - 1 - level)) & 1 == 1
            za, zb = before[a], before[b]
            below += np.where(one, zb - za, 0)
            a, b = np.where(one, before[-1] + a - za, za), np.where(one, before[-1] + b - zb, zb)
        over = least >> self.bits > 0
        none = (below >= high - low) | over
        # The value with ``below`` smaller ones in the range.
        a, b = low.copy(), high.copy()
        nth, out = np.where(none, 0, below), np.zeros(len(low), np.int64)
        for before in self.zeros:
            za, zb = before[a], before[b]
            one = nth >= zb - za
            nth = np.where(one, nth - (zb - za), nth)
            a, b = np.where(one, before[-1] + a - za, za), np.where(one, before[-1] + b - zb, zb)
            out = out * 2 + one
        return np.where(none, -1, out)


class Suffixes:
    """Sorted suffixes of several texts at once, over words whose block recurs in their text."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        self.words, n = words, len(words)
        lengths = np.diff(offsets)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        self.first, self.end = offsets[:-1][doc], offsets[1:][doc]
        self.longest = int(lengths.max()) if len(lengths) else 0
        whole = np.flatnonzero(np.arange(n) + BLOCK <= self.end)
        grams = W.ngrams(words, BLOCK)[whole] if len(whole) else np.zeros(0, W.U64)
        grams = W.mix(grams ^ W.mix(doc[whole].astype(W.U64) + W.U64(1)))
        ordered = np.sort(grams)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(again):
            at = np.searchsorted(again, grams)
            mine = again[np.minimum(at, len(again) - 1)] == grams
        else:
            mine = np.zeros(len(grams), bool)
        # Places of the members, and how many of them stand before each place.
        self.places = whole[mine]
        self.before = np.zeros(n + 2, np.int64)
        self.before[self.places + 1] = 1
        np.cumsum(self.before, out=self.before)
        self.levels: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        if len(self.places):
            self._sort(grams[mine])
            self.tree = WaveletTree(self.order)

    def member(self, place: np.ndarray) -> np.ndarray:
        """The number of the member at each place, or -1."""
        at = self.before[place]
        return np.where(self.before[place + 1] > at, at, -1)

    def _sort(self, grams: np.ndarray) -> None:
        m = len(grams)
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rank = np.empty(m, np.int32)
        rank[order] = np.repeat(start, np.diff(np.append(start, m)))
        level = LEVEL
        while True:
            size = np.bincount(rank, minlength=m).astype(np.int32)
            self.levels.append(rank)
            self.sizes.append(size)
            active = np.flatnonzero(size[rank] > 1)
            if not len(active) or 2 << level > self.longest:
                break
            behind = self.places[active] + (1 << level)
            inside = behind < self.end[self.places[active]]
            other = self.member(np.where(inside, behind, 0))
            # A stretch that recurs nowhere is told apart by its place, the end of the text by -1.
            second = np.where(inside, np.where(other >= 0, rank[np.maximum(other, 0)], m + behind), -1)
            by = np.lexsort((second, rank[active]))
            active, second = active[by], second[by]
            old = rank[active]
            new = np.concatenate([[True], (old[1:] != old[:-1]) | (second[1:] != second[:-1])])
            head = np.concatenate([[True], old[1:] != old[:-1]])
            at = np.arange(len(active))
            spot = old + at - np.maximum.accumulate(np.where(head, at, 0))
            order[spot] = active
            rank = rank.copy()
            rank[active] = spot[np.maximum.accumulate(np.where(new, at, 0))]
            level += 1
        self.order = order

    def _same(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the stretches of 2^level words at two places of a text are equal."""
        ma, mb = self.member(a), self.member(b)
        rank = self.levels[level - LEVEL]
        return (ma >= 0) & (mb >= 0) & (rank[ma] == rank[mb])

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on; a < b, in one text."""
        out, end = np.zeros(len(a), np.int64), self.end[a]
        top = LEVEL + len(self.levels) - 1
        live = np.arange(len(a))
        for level in range(top, LEVEL - 1, -1):
            live = np.arange(len(a))
            while len(live):
                at = b[live] + out[live]
                fits = at + (1 << level) <= end[live]
                live, at = live[fits], at[fits]
                live = live[self._same(level, a[live] + out[live], at)]
                out[live] += 1 << level
                if level < top:
                    break
        live = np.arange(len(a))
        for _ in range(BLOCK - 1):
            live = live[b[live] + out[live] < end[live]]
            live = live[self.words[a[live] + out[live]] == self.words[b[live] + out[live]]]
            out[live] += 1
        return out

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` equal those before ``b``; a < b, in one text."""
        out, first = np.zeros(len(a), np.int64), self.first[a]
        top = LEVEL + len(self.levels) - 1
        for level in range(top, LEVEL - 1, -1):
            live, step = np.arange(len(a)), 1 << level
            while len(live):
                at = a[live] - out[live] - step
                fits = at >= first[live]
                live, at = live[fits], at[fits]
                live = live[self._same(level, at, b[live] - out[live] - step)]
                out[live] += step
                if level < top:
                    break
        live = np.arange(len(a))
        for _ in range(BLOCK - 1):
            live = live[a[live] - out[live] > first[live]]
            live = live[self.words[a[live] - out[live] - 1] == self.words[b[live] - out[live] - 1]]
            out[live] += 1
        return out

    def candidates(self, level: int, stride: int, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of blocks that occur again ``near`` to ``far`` words later."""
        rank, size = self.levels[level - LEVEL], self.sizes[level - LEVEL]
        length = 1 << level
        block = np.flatnonzero(
            ((self.places - self.first[self.places]) % stride == 0) & (size[rank] > 1)
        )
        place = self.places[block]
        low, last = rank[block].astype(np.int64), len(self.words)
        high = low + size[low]
        # Windows as numbers of members, whose order is that of their places.
        least = self.before[np.minimum(place + near, last)]
        most = self.before[np.minimum(place + far + 1, self.end[place])]
        places, periods = [], []
        live = np.flatnonzero(least < most)
        while len(live):
            found = self.tree.successor(low[live], high[live], least[live])
            ok = (found >= 0) & (found < most[live])
            live, found = live[ok], found[ok]
            if not len(live):
                break
            after = self.tree.successor(low[live], high[live], found + 1)
            at, own = self.places[found], place[live]
            gap = np.where(after >= 0, self.places[np.maximum(after, 0)] - at, last)
            dense = 2 * gap <= length
            terms = np.ones(len(live), np.int64)
            least[live] = found + 1
            if dense.any():
                d, one, two = gap[dense], at[dense], (at + np.where(dense, gap, 0))[dense]
                stop = two + self.ahead(one, two)
                begin = one - self.back(one, two)
                fit = (np.minimum(stop - length, own[dense] + far) - one) // d + 1
                least[live[dense]] = self.before[one + (fit - 1) * d + 1]
                terms[dense] = np.where(begin <= own[dense], 1, fit)
            step = np.arange(int(terms.sum())) - np.repeat(np.cumsum(terms) - terms, terms)
            places.append(np.repeat(own, terms))
            periods.append(np.repeat(at - own, terms) + step * np.repeat(np.where(dense, gap, 0), terms))
            live = live[least[live] < most[live]]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(periods)


@dataclass
class Runs:
    """Runs of several texts by start and period; places count over all texts."""

    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def find_runs(words: np.ndarray, offsets: np.ndarray, least: int = LEAST_WORDS) -> Runs:
    """All runs of texts whose word hashes are ``words``; text i is at offsets[i] to offsets[i + 1]."""
    if least < 3 * BLOCK:
        raise ValueError(f"runs have {3 * BLOCK} words at least")
    text = Suffixes(words, offsets)
    starts, ends, periods = [], [], []
    # Short periods repeat over 2 * BLOCK - 2 words at least, so blocks stand at every second word.
    windows = [(LEVEL, 2, 1, 2 * BLOCK - 2)] + [
        (k, 1 << k, (2 << k) - 1, (4 << k) - 2) for k in range(LEVEL, LEVEL + len(text.levels))
    ]
    for level, stride, near, far in windows if text.levels else []:
        place, period = text.candidates(level, stride, near, far)
        start = place - text.back(place, place + period)
        end = place + period + text.ahead(place, place + period)
        ok = end - start >= np.maximum(least, 2 * period)
        # Most blocks of a level lie in runs that their neighbours find too.
        found = np.unique(np.stack([start[ok], end[ok], period[ok]]), axis=1)
        starts.append(found[0])
        ends.append(found[1])
        periods.append(found[2])
    if not starts:
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)))
    start, end, period = np.concatenate(starts), np.concatenate(ends), np.concatenate(periods)
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return Runs(start[by], end[by], period[by])


def repeated_tail(key, n: int) -> tuple[int, int] | None:
    """(first word, period) of the tail that one text in ten gets, by the crc32 of its id."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    first = g % n
    return first, 1 + (n - first) // (3 + g % 8)


def _text_rows(keys: list, block: W.Block, tails: bool, least: int):
    """One tuple of ``OUTPUT`` per text of a block."""
    found = W.words(block, lower=False)
    offsets = found.offsets
    index, changed = np.arange(len(found.hashes)), set()
    if tails:
        for i, key in enumerate(keys):
            low, high = int(offsets[i]), int(offsets[i + 1])
            tail = repeated_tail(key, high - low)
            if tail:
                first = low + tail[0]
                index[first:high] = first + (index[first:high] - first) % tail[1]
                changed.add(i)
    runs = find_runs(found.hashes[index], offsets, least)
    cover = np.zeros(len(index) + 1, np.int64)
    np.add.at(cover, runs.start + runs.period, 1)
    np.add.at(cover, runs.end, -1)
    kept = np.cumsum(cover[:-1]) == 0
    of = np.searchsorted(runs.start, offsets)
    for i in range(len(block)):
        low, high, a, b = int(offsets[i]), int(offsets[i + 1]), int(of[i]), int(of[i + 1])
        words = block.text(i).split()
        if a < b or i in changed:
            words = [words[j] for j in (index[low:high][kept[low:high]] - low).tolist()]
        collapsed = b" ".join(words)
        own = list(zip(
            (runs.start[a:b] - low).tolist(), (runs.end[a:b] - runs.start[a:b]).tolist(),
            runs.period[a:b].tolist(),
        ))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
        if own:
            start, length, period = min(own, key=lambda r: (-r[1], r[0], r[2]))
            best = (start, length, period, 1000 * length // period)
        else:
            best = (None, None, None, None)
        yield (
            high - low, len(own), *best, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(collapsed).hexdigest(), collapsed, own,
        )


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS,
    repeat_tails: bool = False, whole: bool = True,
) -> DataFrame:
    """(key, ``OUTPUT``) of every row: its runs by start and period, the longest run, and the collapsed text.

    The collapsed text leaves out each word that lies in a run after the run's first period; its words stand
    one space apart. ``repeat_tails`` first makes the end of one text in ten periodic, as ``repeated_tail``
    says. Without ``whole`` the result has neither the collapsed text nor the list of runs, only their hashes.
    """
    kind = docs.schema[key].dataType.simpleString()
    fields = [f.strip() for f in OUTPUT.split(", ")]
    fields = fields if whole else fields[:-2]
    types = {"bigint": pa.int64(), "string": pa.string()}
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def apply(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for block in W.blocks(batch.column(1)):
                own = names[block.first:block.first + len(block)]
                columns = list(zip(*_text_rows(own, block, repeat_tails, least)))
                arrays = [
                    pa.array(c, pa.binary()).cast(pa.string()) if f == "collapsed string"
                    else pa.array(c, types[f.split(" ")[1]])
                    for f, c in zip(fields, columns) if not f.startswith("runs array")
                ]
                if whole:
                    arrays.append(pa.array(
                        [[dict(zip(run.names, r)) for r in rows] for rows in columns[-1]], pa.list_(run)
                    ))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), *arrays],
                    [key, *(f.split(" ")[0] for f in fields)],
                )

    rows = docs.select(F.col(key), W.text_bytes(text).alias("_bytes"))
    return rows.mapInArrow(apply, f"`{key}` {kind}, " + ", ".join(fields))
