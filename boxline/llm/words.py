"""Words, shingles and shapes of many texts at once, as 64-bit hashes in numpy arrays.

Tasks get texts as Arrow binary columns. All words of a block of texts are hashed together from
prefix sums over the bytes, so no Python object is made per word. Two different words share a hash
with odds of about 2^-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from boxline.llm.worker import kept

# Bytes of text hashed at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_PUNCT = _SPACE.copy()
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
# Shape classes: letters and digits fall together, other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a"):ord("z") + 1] = ord("a")
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


def text_bytes(column: str | Column) -> Column:
    """A text column as bytes; null is an empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """Hashes as Spark longs."""
    return x.view(np.int64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and of its inverse, at least ``n`` of each."""
    powers = kept().get("powers")
    if powers is None or len(powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        base, inverse = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 1 << 64), U64)
        base[0] = inverse[0] = 1
        powers = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
        kept()["powers"] = powers
    return powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


@dataclass
class Block:
    """Texts that are hashed together: ``data`` holds their bytes, ``offsets`` where each starts."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """An Arrow binary column in blocks of whole texts of about ``limit`` bytes."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield Block(low, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        low = high


@dataclass
class Words:
    """Words of a block: ``hashes`` in order, ``offsets`` of each text, byte ``starts``/``ends``."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.offsets[i]:self.offsets[i + 1]]


def words(block: Block, lower: bool = True, punctuation: bool = False) -> Words:
    """Runs of bytes other than white space (``punctuation``: nor ASCII punctuation).

    ``lower`` folds A-Z only, as the bytes of other letters stay as they are.
    """
    data = _LOWER[block.data] if lower else block.data
    inside = ~(_PUNCT if punctuation else _SPACE)[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = block.offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(
        span_hashes(data, starts, ends), np.searchsorted(starts, block.offsets), starts, ends
    )


def shapes(block: Block, found: Words) -> np.ndarray:
    """A hash per word of its shape: runs of letters, capitals, digits and signs, each run once.

    A word equal to the one before it has a shape of its own, whatever its letters.
    """
    classes = _SHAPE[block.data]
    keep = np.ones(len(classes), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[found.starts] = True
    places = np.cumsum(keep) - keep
    kept = classes[keep]
    last = places[found.ends - 1] + keep[found.ends - 1]
    out = span_hashes(kept, places[found.starts], last)
    same = np.zeros(len(out), bool)
    same[1:] = found.hashes[1:] == found.hashes[:-1]
    firsts = found.offsets[:-1]
    same[firsts[firsts < len(same)]] = False
    out[same] = U64(0x5EED)
    return out


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` words in a row, within one text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = np.zeros(m, U64)
    for k in range(n):
        total = total * U64(_BASE) + hashes[k:k + m]
    return mix(total + U64(n))


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """The set of ``n``-word shingles of one text, sorted; a shorter text is one shingle."""
    if 0 < len(hashes) < n:
        return ngrams(hashes, len(hashes))
    return np.unique(ngrams(hashes, n))
