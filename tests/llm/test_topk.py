"""Exact top-k against all inner products."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from boxline.llm import queries, topk


def loop(rows, every=20, k=20):
    """[(query_id, rank, id, score)] over (id, vector) rows."""
    rows = [
        (n, i, [math.floor(64 * float(x)) for x in v]) for n, (i, v) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, q in rows:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j, m) for m, j, v in rows if m != n)
            out += [(i, rank, j, -s) for rank, (s, j, _) in enumerate(scored[:k], 1)]
    return sorted(out)


def result(frame, name="id"):
    return sorted((r["query_id"], r["rank"], r[name], r["score"]) for r in frame.collect())


def test_query(spark, folder):
    rows = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    got = result(queries.op12_top_k(spark, folder), "vec_id")
    assert got == loop([(r["vec_id"], r["embedding"]) for r in rows])


def test_many_annuli_and_hot_copies(spark):
    rng = np.random.default_rng(3)
    some = [(i, (rng.normal(size=6) * (1 + i % 3)).tolist()) for i in range(700)]
    # A third of all rows are one vector.
    rows = some + [(1000 + i, some[40][1]) for i in range(350)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = result(topk.top_k(table, F.col("id") % 20 == 0, annulus_rows=32, pivots=9, first=1))
    assert got == loop(rows)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-40, 40, (300, 8)), rng.integers(-40, 40, (50, 8))
    pivots = topk.choose_pivots(x, 7)
    away = topk.distances(x, pivots)
    cell = away.argmin(axis=1)
    rows = [
        {"part": 0, "cell": c, "near": away[cell == c, c].min(), "far": away[cell == c, c].max(),
         "norm": np.sqrt((x[cell == c] ** 2).sum(1)).max()} for c in np.unique(cell).tolist()
    ]
    upper, _ = topk.Bounds(pivots, rows).at(q)
    for a, r in enumerate(rows):
        assert (topk.products(q, x[cell == r["cell"]]).max(axis=1) <= upper[:, a]).all()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5]), (40, []), (60, None), (80, [1.0, None]), (100, [nan, 1.0]),
        (120, [inf, 0.0]), (None, [9.0, 9.0]), (-20, [-1.0, -0.001]), (3, [1.0, 2.0, 0.25]), (4, [1.0, 2.0, 0.25]),
    ]
    table = spark.createDataFrame(
        [(*r, 1, "q") for r in rows], "vec_id bigint, embedding array<float>, id int, query string"
    )
    assert result(topk.top_k(table, F.col("id") % 20 == 0)) == loop(rows)
    assert topk.top_k(table.limit(0), F.col("id") % 20 == 0).count() == 0
    assert topk.top_k(table, F.col("id") == 7).count() == 0
    assert result(topk.top_k(table, F.col("id") % 20 == 0, k=1)) == loop(rows, k=1)


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**24, 1.0]), (1, [2.0**24, 3.0]), (2, [2.0**24 - 1, 5.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert result(topk.top_k(table, F.col("id") % 20 == 0)) == loop(rows)
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [2.0**40])], table.schema), F.col("id") % 20 == 0).count()
