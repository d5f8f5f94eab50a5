"""Exact top-k by inner product over a pivot-distance index.

Vectors become integers, floor(``SCALE`` * x). Every vector is keyed by its nearest pivot and its distance from
it. Rows in that order are cut into annuli: the rows of one partition and one pivot, between two distances.
Partitions have about equal numbers of rows, and equal distances are told apart by the row's number, so no
number of copies makes a partition large. An annulus holds its vectors in blocks of bounded size.

A query at distance d from a pivot p is, by the triangle inequality, at least d - r or r - d away from a vector at
distance r from p. With the largest norm of the annulus that bounds its inner product with any vector there. A
query sorts all annuli by this bound and searches them from the best one on, more of them each round, until
no annulus left reaches its k-th best score. Queries that need the same annulus meet its blocks in bundles.

Pivots come from ``SAMPLE`` rows at most; they steer which annuli are searched, not the result. Pivots and the
bounds of at most ``ANNULI`` + ``PIVOTS`` annuli are all that is broadcast.

Vectors that are null or hold null or non-finite components, and rows without id, take no part. A vector shorter
than the longest counts as zero beyond its end. Rows are told apart by position, not by id: a repeated row is a
candidate, and a query, of its own. Equal scores go by id, then by row. Components lie within 2^25 (32-bit
integers after scaling). An empty table gives no rows. Columns other than the two named aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxline.llm.worker import ship
from boxline.session import Rounds, pin

SCALE = 64
PIVOTS, SAMPLE, LLOYD = 64, 2048, 6
# A pivot is worth so many rows; smaller tables have fewer pivots.
PIVOT_ROWS = 512
# Rows of an annulus, until there are so many annuli; beyond that annuli grow.
ANNULUS_ROWS, ANNULI = 2048, 8192
# Rows of a block of vectors, and queries of a bundle.
BLOCK_ROWS, BUNDLE = 1024, 256
# Annuli searched in the first round, and the growth of that number per round.
FIRST, GROWTH = 4, 5


def packed(table: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(row, id, vec) of usable vectors, as little-endian 32-bit integers."""
    def pack(batches):
        for batch in batches:
            lists = batch.column(2)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = lists.flatten()
            flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ok = (bad[ends] == bad[starts]) & lists.is_valid().to_numpy(zero_copy_only=False)
            scaled = np.floor(scale * np.where(np.isfinite(flat), flat, 0))
            used = np.repeat(ok, lengths)
            if len(scaled) and np.abs(scaled[used]).max(initial=0) >= 2**31:
                raise ValueError("a component is too large for 32-bit integers")
            raw = np.where(used, scaled, 0).astype("<i4").tobytes()
            vecs = [raw[4 * s:4 * e] for s, e in zip(starts[ok].tolist(), ends[ok].tolist())]
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(vecs, pa.binary())],
                ["row", "id", "vec"],
            )

    rows = table.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"),
        F.col(vector).cast("array<double>").alias("vec"),
    ).where("id is not null")
    return rows.mapInArrow(pack, "row bigint, id bigint, vec binary")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors of equal length as a matrix of integers."""
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros((0, dim), "<i4")
    start = np.frombuffer(where, np.int64)[column.offset]
    return np.frombuffer(data, "<i4", len(column) * dim, int(start)).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("an inner product is too large for a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """``count`` rounded centres of ``sample`` after a few Lloyd steps; fewer if rows are fewer."""
    kinds = np.unique(sample, axis=0).astype(float)
    centres = kinds[np.linspace(0, len(kinds) - 1, min(count, len(kinds))).astype(int)]
    for _ in range(LLOYD):
        near = distances(sample, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(axis=0)
    return np.rint(np.unique(np.rint(centres), axis=0))


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    rows = rows.astype(float)
    square = (rows**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class Bounds:
    """What the annuli hold: their pivot, distances and largest norm. ``at`` gives upper bounds of scores."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.pivots = pivots
        self.part = np.array([r["part"] for r in rows], np.int64)
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.near, self.far, self.norm = (
            np.array([r[c] for r in rows], float) for c in ("near", "far", "norm")
        )

    def at(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bound [query, annulus], distance [query, annulus's pivot])."""
        away = distances(queries, self.pivots)[:, self.cell]
        norm = np.sqrt((queries.astype(float) ** 2).sum(1))[:, None]
        return bound(norm, away, self.near, self.far, self.norm), away


def bound(norm, away, near, far, most):
    """The largest score of a query with ``norm`` at distance ``away`` from the pivot; rounded up a little."""
    gap = np.maximum(0, np.maximum(near - away, away - far))
    best = np.minimum(norm * most, (norm**2 + most**2 - gap**2) / 2)
    return best + 1e-9 * (norm**2 + most**2 + gap**2) + 1e-6


def _index(
    vectors: DataFrame, pivots: np.ndarray, dim: int, parts: int
) -> tuple[DataFrame, DataFrame]:
    """``vectors`` with cell and distance, and blocks of them: part, cell, near, far, norm, ids, rows, vecs."""
    share = ship(vectors.sparkSession, pivots)

    def assign(batches):
        for batch in batches:
            away = distances(matrix(batch.column(2), dim), share())
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])],
                ["row", "id", "vec", "cell", "away"],
            )

    def cut(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            cell = batch.column(3).to_numpy()
            edges = np.flatnonzero(np.diff(cell)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(cell)]):
                for start in range(low, high, BLOCK_ROWS):
                    own = batch.slice(start, min(BLOCK_ROWS, high - start))
                    vecs, away = matrix(own.column(2), dim), own.column(4).to_numpy()
                    norm = np.sqrt((vecs.astype(float) ** 2).sum(1).max())
                    yield pa.RecordBatch.from_pydict({
                        "part": [part], "cell": [int(cell[low])], "near": [float(away.min())],
                        "far": [float(away.max())], "norm": [float(norm)],
                        "ids": [own.column(1).to_numpy().astype("<i8").tobytes()],
                        "rows": [own.column(0).to_numpy().astype("<i8").tobytes()],
                        "vecs": [vecs.tobytes()],
                    }, schema=pa.schema([
                        ("part", pa.int32()), ("cell", pa.int32()), ("near", pa.float64()),
                        ("far", pa.float64()), ("norm", pa.float64()), ("ids", pa.binary()),
                        ("rows", pa.binary()), ("vecs", pa.binary()),
                    ]))

    keyed = pin(vectors.mapInArrow(assign, "row bigint, id bigint, vec binary, cell int, away double"))
    dealt = keyed.repartitionByRange(parts, "cell", "away", "row").sortWithinPartitions("cell", "away", "row")
    return keyed, pin(dealt.mapInArrow(
        cut, "part int, cell int, near double, far double, norm double, ids binary, rows binary, vecs binary"
    ))


def _bundles(queries: DataFrame, bounds, dim: int, low: int, high: int) -> DataFrame:
    """Queries (row, vec, least) by annulus: those of a bundle whose annuli ``low`` to ``high``, best bounds first,
    include it and can reach ``least``."""
    def send(batches):
        held = bounds()
        for batch in batches:
            for start in range(0, len(batch), BUNDLE):
                own = batch.slice(start, BUNDLE)
                vecs, least = matrix(own.column(1), dim), own.column(2).to_numpy(zero_copy_only=False)
                best, away = held.at(vecs)
                order = np.argsort(-best, axis=1, kind="stable")[:, low:high]
                wanted = np.zeros(best.shape, bool)
                np.put_along_axis(wanted, order, True, axis=1)
                # Without k scores yet (null, here nan) every annulus counts.
                wanted &= ~(best < least[:, None])
                rows = own.column(0).to_numpy()
                for a in np.flatnonzero(wanted.any(axis=0)).tolist():
                    q = wanted[:, a]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([held.part[a]], pa.int32()), "cell": pa.array([held.cell[a]], pa.int32()),
                        "q_rows": [rows[q].astype("<i8").tobytes()], "q_vecs": [vecs[q].tobytes()],
                        "q_least": [least[q].astype("<f8").tobytes()], "q_away": [away[q, a].astype("<f8").tobytes()],
                    })

    return queries.select("row", "vec", "least").mapInArrow(
        send, "part int, cell int, q_rows binary, q_vecs binary, q_least binary, q_away binary"
    )


def _search(bundles: DataFrame, blocks: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, id, row, score): the k best of each query in each block it meets, its own row left out."""
    def score(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q, x = (np.frombuffer(r[c], "<i4").reshape(-1, dim) for c in ("q_vecs", "vecs"))
                q_rows, rows, ids = (np.frombuffer(r[c], "<i8") for c in ("q_rows", "rows", "ids"))
                least, away = (np.frombuffer(r[c], "<f8") for c in ("q_least", "q_away"))
                norm = np.sqrt((q.astype(float) ** 2).sum(1))
                live = ~(bound(norm, away, r["near"], r["far"], r["norm"]) < least)
                if not live.any():
                    continue
                q, q_rows, least = q[live], q_rows[live], least[live]
                got = products(q, x)
                ok = (q_rows[:, None] != rows) & ~(got < least[:, None])
                if k < len(rows):
                    # The k-th best score of each query, and all that equal it.
                    masked = np.where(ok, got, np.iinfo(np.int64).min)
                    edge = np.partition(masked, len(rows) - k, axis=1)[:, len(rows) - k]
                    ok &= got >= edge[:, None]
                at, of = np.nonzero(ok)
                # Ties beyond the k-th go by id and row.
                by = np.lexsort((rows[of], ids[of], -got[at, of], at))
                at, of = at[by], of[by]
                nth = np.arange(len(at)) - np.searchsorted(at, at)
                at, of = at[nth < k], of[nth < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_rows[at]), pa.array(ids[of]), pa.array(rows[of]), pa.array(got[at, of])],
                    ["query", "id", "row", "score"],
                )

    met = bundles.join(blocks, ["part", "cell"])
    return met.mapInArrow(score, "query bigint, id bigint, row bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
    scale: int = SCALE, annulus_rows: int = ANNULUS_ROWS, pivots: int = PIVOTS, first: int = FIRST,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` highest inner products of every query row with all other rows.

    ``is_query`` is a condition on the column ``id``, which holds the key as a long.
    """
    spark = table.sparkSession
    vectors = pin(packed(table, key, vector, scale))
    size = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("most"),
        F.min(F.octet_length("vec")).alias("least"),
    ).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    dim = max(1, size["most"] // 4)
    if size["least"] < 4 * dim:
        vectors = vectors.withColumn("vec", F.expr(f"rpad(vec, {4 * dim}, X'00')"))
    # At most 8 MB of sampled vectors come to the driver.
    some = vectors.orderBy(F.xxhash64("row")).limit(max(1, min(SAMPLE, (8 << 20) // (4 * dim))))
    sample = np.array([np.frombuffer(r["vec"], "<i4") for r in some.select("vec").collect()])
    centres = choose_pivots(sample, min(pivots, -(-size["n"] // PIVOT_ROWS)))
    keyed, blocks = _index(vectors, centres, dim, min(ANNULI, -(-size["n"] // annulus_rows)))
    # One row for each pivot and each partition, and each change of pivot within one, at most.
    rings = blocks.groupBy("part", "cell").agg(
        F.min("near").alias("near"), F.max("far").alias("far"), F.max("norm").alias("norm")
    ).collect()
    bounds = ship(spark, Bounds(centres, rings))
    # Neighbouring queries need the same annuli, so bundles are cut in the order of the index.
    asked = pin(
        keyed.where(is_query).repartitionByRange("cell", "away", "row")
        .sortWithinPartitions("cell", "away", "row").select("row", "id", "vec")
    )
    low, high, best, rounds = 0, first, None, Rounds(spark, "top-k")
    while low < len(rings):
        state = asked.withColumn("least", F.lit(None).cast("double"))
        if best is not None:
            reached = best.where(F.col("rank") == k).select(
                F.col("query").alias("row"), F.col("score").cast("double").alias("least")
            )
            state = asked.join(reached, "row", "left")
        found = _search(_bundles(state, bounds, dim, low, high), blocks, dim, k)
        if best is not None:
            found = found.union(best.select("query", "id", "row", "score"))
        best = rounds.write(_best(found, k))
        low, high = high, high * GROWTH
    names = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", "id", "score")
