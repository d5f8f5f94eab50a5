"""Fingerprints, reuse and quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxline.functions import fingerprint as P
from boxline.operators import metrics as M
from boxline.operators import reuse as R


def _hashes(seed, n, spread):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.choice(spread)
        for _ in range(rng.randint(0, 4)):
            base ^= 1 << rng.randint(0, 63)
        out.add(base - (1 << 64) if base >= 1 << 63 else base)
    return sorted(out)


@pytest.mark.parametrize("limit", [1_000, 6])
def test_near_duplicates_are_complete(spark, limit):
    rng = random.Random(3)
    values = _hashes(3, 70, [rng.getrandbits(64) for _ in range(4)])
    counts = {v: rng.randint(1, 3) for v in values}
    rows = [(v,) for v in values for _ in range(counts[v])]
    expected = {
        (a, b): (counts[a], counts[b], 1 - (((a ^ b) & (2**64 - 1)).bit_count()) / 64)
        for i, a in enumerate(values) for b in values[i + 1:]
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    }
    assert len(expected) > 20
    frame = spark.createDataFrame(rows, "fingerprint long")
    got = R.near_duplicates(frame, max_distance=2, limit=limit).collect()
    assert {(r.left, r.right): (r.n_left, r.n_right, r.similarity) for r in got} == expected
    assert len(got) == len(expected)


def test_clustered_fingerprints(spark):
    rng = random.Random(8)
    centers = [rng.getrandbits(63) for _ in range(3)]
    # Most bits of a cluster are equal, so its buckets are crowded at every level but the last.
    values = sorted({
        (c ^ sum(1 << b for b in rng.sample(range(16 + 9 * i), rng.randint(2, 8)))) - 2**62
        for i, c in enumerate(centers) for _ in range(1_200)
    })
    assert len(values) > 2_500
    expected = {
        (a, b) for i, a in enumerate(values) for b in values[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    }
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    got = R.near_duplicates(frame, limit=200).collect()
    assert len(got) == len(expected)
    assert {(r.left, r.right) for r in got} == expected


def test_average_hash(spark):
    pixels = [float(i) for i in range(64)]
    row = spark.createDataFrame([(pixels,)], "t array<double>").select(
        P.average_hash(F.col("t")), P.packed_hash(F.col("t"))
    ).first()
    assert row[0] == "0" * 32 + "1" * 32
    assert row[1] == 2**32 - 1


def test_hits_and_reuse(spark):
    rows = [(i, "h%d" % (i % 7 if i % 3 else 0), "p%d" % (i % 7 if i % 3 else 0)) for i in range(60)]
    items = spark.createDataFrame(rows, "id int, hash string, payload string")
    seen, expected = set(), {}
    for i, h, _ in rows:
        expected[i] = h in seen
        seen.add(h)
    for limit in (5, 1_000_000):
        got = R.label_hits(items, "hash", ["id"], limit=limit)
        assert {r.id: r.is_hit for r in got.collect()} == expected
        reused = R.reuse_results(
            items, "hash", lambda t: t.select("hash", F.upper("payload").alias("text")), limit=limit
        )
        assert {r.id: r.text for r in reused.collect()} == {i: p.upper() for i, _, p in rows}
    stats = R.hit_statistics(items, "hash").first()
    assert (stats.requests, stats.misses, stats.hits) == (60, len(seen), 60 - len(seen))
    known = spark.createDataFrame([("h0", "old")], "hash string, text string")
    mixed = R.reuse_results(
        items, "hash", lambda t: t.select("hash", F.lit("new").alias("text")), known
    )
    assert {(r.hash == "h0", r.text) for r in mixed.collect()} == {(True, "old"), (False, "new")}


@pytest.mark.parametrize("limit", [1_000_000, 15])
def test_quantiles_match_numpy(spark, limit):
    rng = random.Random(9)
    groups = {k: [round(rng.random() * 10, 2) for _ in range(n)] for k, n in (("a", 300), ("b", 2), ("c", 1))}
    frame = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = M.exact_quantiles(frame, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}, limit=limit)
    for r in got.collect():
        values = groups[r.k]
        for share, value in ((50, r.p50), (95, r.p95), (0, r.p0), (100, r.p100)):
            assert value == pytest.approx(np.percentile(values, share))


def test_latency_counts_failures(spark):
    rows = [("e", 10.0, True), ("e", 30.0, True), ("e", 999.0, False), ("z", 1.0, False)]
    frame = spark.createDataFrame(rows, "engine string, elapsed_ms double, ok boolean")
    for approximate in (False, True):
        got = {r.engine: r for r in M.latency_summary(frame, ["engine"], approximate).collect()}
        assert (got["e"].total_calls, got["e"].successful_calls, got["e"].avg_ms) == (3, 2, 20.0)
        assert got["e"].fps == 50.0 and got["e"].throughput_per_second == 50.0
        assert got["z"].successful_calls == 0 and got["z"].median_ms is None


def test_worker_efficiency(spark):
    rows = [("r", 0, 10.0), ("r", 0, 20.0), ("r", 1, 30.0), ("r", 2, 60.0)]
    frame = spark.createDataFrame(rows, "run string, worker_id int, time_ms double")
    got = M.worker_efficiency(frame, ["run"]).first()
    assert (got.workers, got.serial_ms, got.parallel_ms, got.speedup) == (3, 120.0, 60.0, 2.0)


def test_report_total_row(spark):
    rows = [("x", 2, 10.0), ("x", 3, 10.0), (None, 5, 30.0)]
    frame = spark.createDataFrame(rows, "scenario string, lines_detected int, time_ms double")
    got = {(r.is_total, r.scenario): r for r in M.extraction_report(frame).collect()}
    assert got[(1, "total")].lines == 10 and got[(1, "total")].lines_per_second == 200.0
    assert got[(0, None)].regions == 1
