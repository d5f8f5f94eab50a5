"""Shards of near equal bytes by histogram sort.

Rows are ordered by a 64-bit key: 40 bits hash the text, so that equal texts stand together, and 24
bits hash the id and the row, so that a group of copies of any size can be cut. Only groups too large for that are: a
splitter inside a group moves to the nearer end of it when that is within ``GROUP_SLACK`` of a shard. Splitters are found
by counting: each round, every partition counts the exact bytes below all candidate boundaries, and
the interval around each splitter shrinks to the candidates on both sides of its target, until the
bytes below a splitter are within the tolerance or no key is left in between. Then rows are
exchanged once.

Boundaries inside a shard are found the same way, so no task sorts a whole shard; slots follow from
the counts of the buckets before.

Size is the UTF-8 bytes of the text (null: none) plus ``ROW_BYTES``. Null ids and texts are keyed
like empty ones. Repeated rows are rows of their own: the key holds a number of the row within its
partition. With fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxline.llm import words as W
from boxline.session import pin

SHARDS = 40
ROW_BYTES = 16
# A splitter may be off its target by this share of a shard; inside a shard by a tenth of a bucket.
TOLERANCE = 1e-3
# A splitter moves out of a group of equal texts by up to this share of a shard; larger groups are cut.
GROUP_SLACK = 0.1
# Candidate boundaries of one round for all splitters together, and for one splitter.
POINTS = 20_000
LEAST_PROBES, MOST_PROBES = 3, 63
# Bytes of a bucket, the unit that one task sorts, and the fewest buckets of a shard.
BUCKET_BYTES = 128 << 20
LEAST_BUCKETS = 8
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
# The bits of a key that tell rows of one text apart.
_ROWS = (1 << 24) - 1


def row_bytes(text: str) -> Column:
    return F.octet_length(W.text_bytes(text)).cast("long") + F.lit(ROW_BYTES)


def row_key(key: str, text: str, row: Column) -> Column:
    """40 bits for the text, 24 for the row."""
    group = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(40)).bitwiseAND(F.lit(-1 << 24))
    own = F.xxhash64(F.col(key), row).bitwiseAND(F.lit((1 << 24) - 1))
    return group.bitwiseOR(own)


def _counts_below(keys: DataFrame, probes: np.ndarray) -> np.ndarray:
    """(rows, bytes) with a key below each probe (sorted, distinct), exact over all partitions."""
    share = keys.sparkSession.sparkContext.broadcast(probes)

    def count(batches):
        bounds = share.value
        rows, size = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(0).to_numpy(), "right")
            rows += np.bincount(at, minlength=len(rows))
            sums = np.bincount(at, batch.column(1).to_numpy(), len(rows))
            size += np.rint(sums).astype(np.int64)
        seen = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(rows[seen]), pa.array(size[seen])], ["bin", "n", "b"]
        )

    parts = keys.mapInArrow(count, "bin bigint, n bigint, b bigint").groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("b").alias("b")
    )
    out = np.zeros((len(probes) + 1, 2), np.int64)
    # One row for each gap between two probes at most; their number is a parameter's product.
    for r in parts.collect():
        out[r["bin"]] = r["n"], r["b"]
    return np.cumsum(out, axis=0)[:-1]


def splitters(
    keys: DataFrame, targets: np.ndarray, slack: np.ndarray, points: int = POINTS
) -> tuple[np.ndarray, np.ndarray]:
    """Keys that have about ``targets`` bytes below them, and the exact (rows, bytes) below each.

    ``keys``: key, size. A splitter is settled when it is within its ``slack``, or when the interval
    that holds its target has a single row, or no key between its ends.
    """
    n = len(targets)
    low, high = [_LOW] * n, [_HIGH] * n
    best: list[tuple] = [(None, _LOW, (0, 0))] * n
    open_ = list(range(n))
    while open_:
        each = min(MOST_PROBES, max(LEAST_PROBES, points // len(open_)))
        wanted = set()
        for i in open_:
            step = max(1, (high[i] - low[i]) // (each + 1))
            wanted.update(range(low[i] + step, high[i], step))
            wanted.update((low[i], high[i]))
        probes = np.array(sorted(wanted), np.int64)
        below = _counts_below(keys, probes)
        left = []
        for i in open_:
            a, b = np.searchsorted(probes, [low[i], high[i]], "left").tolist()
            off = np.abs(below[a:b + 1, 1] - targets[i])
            at = a + int(off.argmin())
            if best[i][0] is None or off[at - a] < best[i][0]:
                best[i] = (off[at - a], int(probes[at]), tuple(below[at]))
            # The target lies between probe ``cut - 1`` and probe ``cut``.
            cut = a + int(np.searchsorted(below[a:b + 1, 1], targets[i], "left"))
            cut = min(max(cut, a + 1), b)
            low[i], high[i] = int(probes[cut - 1]), int(probes[cut])
            rows = below[cut, 0] - below[cut - 1, 0]
            if best[i][0] > slack[i] and rows > 1 and high[i] - low[i] > 1:
                left.append(i)
        open_ = left
    return np.array([b[1] for b in best], np.int64), np.array(
        [b[2] for b in best], np.int64
    ).reshape(n, 2)


def _between_texts(
    keys: DataFrame, found: np.ndarray, below: np.ndarray, targets: np.ndarray, slack: float
) -> tuple[np.ndarray, np.ndarray]:
    """Splitters moved out of groups of equal texts, where one end of the group is within ``slack`` of the target."""
    inside = np.flatnonzero(found & _ROWS)
    if not len(inside):
        return found, below
    start = found[inside] & ~_ROWS
    # Behind the last group of all lies the highest key.
    end = np.where(start > _HIGH - _ROWS - 1, _HIGH, start | _ROWS) + (start <= _HIGH - _ROWS - 1)
    probes = np.unique(np.concatenate([start, end]))
    counts = _counts_below(keys, probes)
    for i, a, b in zip(inside.tolist(), start.tolist(), end.tolist()):
        choices = [(abs(counts[p, 1] - targets[i]), p) for p in np.searchsorted(probes, [a, b]).tolist()]
        off, p = min(choices)
        if off <= slack:
            found[i], below[i] = probes[p], counts[p]
    order = np.maximum.accumulate(found)
    return order, np.maximum.accumulate(below, axis=0)


class Plan:
    """Boundaries of all buckets: ``bounds`` between them, rows below each, shard of each bucket."""

    def __init__(
        self, keys: DataFrame, shards: int, bucket_bytes: int, tolerance: float,
        group_slack: float = GROUP_SLACK,
    ):
        total = keys.agg(F.sum("size")).first()[0] or 0
        each = max(1.0, total / shards)
        self.per_shard = max(LEAST_BUCKETS, int(-(-each // bucket_bytes)))
        count = shards * self.per_shard
        targets = np.arange(1, count) * total / count
        edge = np.arange(1, count) % self.per_shard == 0
        slack = np.where(edge, tolerance * each, 0.1 * each / self.per_shard)
        found, below = splitters(keys, targets, slack)
        ends = np.flatnonzero(edge)
        found[ends], below[ends] = _between_texts(keys, found[ends], below[ends], targets[ends], group_slack * each)
        # Boundaries inside a shard stay between those of the shard.
        for low, high in zip([-1, *ends.tolist()], [*ends.tolist(), count - 1]):
            own = slice(low + 1, high)
            for end, past in ((low, np.less), (high, np.greater)):
                if 0 <= end < len(found):
                    out = past(found[own], found[end])
                    found[own][out], below[own][out] = found[end], below[end]
        self.bounds = np.maximum.accumulate(found)
        self.rows_below = np.concatenate([[0], np.maximum.accumulate(below[:, 0])])
        self.shard = np.arange(count) // self.per_shard
        self.shards = shards


def assign(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS,
    bucket_bytes: int = BUCKET_BYTES, tolerance: float = TOLERANCE, with_text: bool = True,
) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot (gapless from 0 within a shard, in key order).

    ``docs`` must read the same rows in the same partitions each time, as tables and checkpoints do,
    since the rows are counted first and exchanged later. Columns of ``docs`` with the names that are
    added are replaced. Without ``with_text`` the result leaves the text out, and only narrow rows
    are exchanged.
    """
    added = {"size", "text_crc32", "shard", "slot"}
    carried = [c for c in docs.columns if c not in added and (with_text or c != text)]
    row = F.monotonically_increasing_id()
    rows = docs.withColumn("_row", row).select(
        *carried, "_row", row_bytes(text).alias("size"),
        F.crc32(W.text_bytes(text)).alias("text_crc32"), row_key(key, text, F.col("_row")).alias("_key"),
    )
    if not with_text:
        rows = pin(rows)
    keys = rows.select(F.col("_key").alias("key"), "size")
    plan = Plan(keys if not with_text else pin(keys), shards, bucket_bytes, tolerance)
    share = docs.sparkSession.sparkContext.broadcast(plan.bounds)

    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(share.value, values.to_numpy(), "right").astype(np.int32))

    # The one exchange: each bucket is one window.
    order = Window.partitionBy("_bucket").orderBy("_key", "_row")
    placed = rows.withColumn("_bucket", bucket("_key")).withColumn(
        "_place", F.row_number().over(order).cast("long") - 1
    )
    # One row per bucket; what stands before it in its shard was counted with the boundaries.
    before = docs.sparkSession.createDataFrame(
        [(i, int(plan.shard[i]), int(plan.rows_below[i] - plan.rows_below[i - i % plan.per_shard]))
         for i in range(len(plan.shard))],
        "_bucket int, shard int, _before bigint",
    )
    return placed.join(F.broadcast(before), "_bucket").select(
        *carried, "size", "text_crc32", "shard", (F.col("_before") + F.col("_place")).alias("slot")
    )
