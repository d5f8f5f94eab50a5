"""Solvers against plain ones, and groups whose shape makes a slow case."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxline.llm import jaccard, mixing, quality
from boxline.llm.components import components
from boxline.session import pin


def test_dual_descent_reaches_the_dual_optimum(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 30)
    rng = np.random.default_rng(2)
    for balance in (0.5, 0.2):
        labels = (rng.random(70) < balance).astype(int)
        rows = [np.sort(rng.choice(30, rng.integers(1, 9), replace=False)) for _ in labels]
        values = [rng.normal(size=len(r)) + 0.4 * (2 * y - 1) for r, y in zip(rows, labels)]
        cost = np.where(labels == 1, 1.5, 0.5)
        weights, intercept = quality.dual_descent(rows, values, labels, cost, rounds=400)
        x = np.zeros((70, 31))
        for i, (r, v) in enumerate(zip(rows, values)):
            x[i, r] = v
        # The intercept is a feature of its own.
        x[:, 30] = 1
        y = np.where(labels == 1, 1.0, -1.0)
        found = np.append(weights, intercept)
        primal = found @ found / 2 + cost @ np.maximum(0, 1 - y * (x @ found))
        # A plain projected gradient on the dual.
        q = (x * y[:, None]) @ (x * y[:, None]).T
        alpha, step = np.zeros(70), 1 / np.linalg.eigvalsh(q).max()
        for _ in range(30_000):
            alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
        dual = alpha.sum() - alpha @ q @ alpha / 2
        assert dual - 1e-6 <= primal <= dual * 1.005 + 1e-3


def nonnegative_rates(posteriors, tokens, targets):
    """Least squares of expected domain tokens over rates from zero on, by a plain projected gradient."""
    a = (posteriors * tokens[:, None]).T
    rates, step = np.ones(len(tokens)), 1 / np.linalg.eigvalsh(a @ a.T).max()
    for _ in range(60_000):
        rates = np.maximum(0, rates - step * (a.T @ (a @ rates - targets)))
    return np.linalg.norm(a @ rates - targets)


@pytest.mark.parametrize("weights", [[0.6, 0.3, 0.1], [0.2, 0.2, 0.6], [0.34, 0.33, 0.33]])
def test_rates_reach_the_least_residual(spark, weights):
    rng = np.random.default_rng(int(100 * weights[0]))
    posteriors = rng.dirichlet([0.6, 0.6, 0.6], 60)
    tokens = rng.integers(1, 400, 60)
    members = pin(spark.createDataFrame(
        [(int(n), [float(v) for v in p]) for n, p in zip(tokens, posteriors)],
        "_tokens bigint, _posterior array<double>",
    ).repartition(4))
    start, steps = mixing.fit_rates(members, np.array(weights))
    rates = mixing.rates_of(posteriors, start, steps)
    assert (rates >= 0).all()
    total = tokens.sum()
    targets = np.array(weights) * total
    mine = np.linalg.norm((posteriors * (rates * tokens)[:, None]).sum(axis=0) - targets)
    best = nonnegative_rates(posteriors, tokens.astype(float), targets)
    assert mine <= best + 2 * mixing.TOLERANCE * total


def test_components_of_a_long_chain(spark):
    n = 20_000
    # Node names in no order along the chain.
    name = F.pmod(F.col("id") * 7919, F.lit(n))
    after = F.pmod((F.col("id") + 1) * 7919, F.lit(n))
    edges = spark.range(n - 1).select(name.alias("a"), after.alias("b"))
    found = components(edges).groupBy("label").count().collect()
    assert [tuple(r) for r in found] == [(0, n)]


def test_texts_go_only_where_pairs_are(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_PART", 8)
    rng = np.random.default_rng(1)
    words = np.array(["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(1_400)])
    # Each text resembles its neighbours in the chain only.
    texts = [" ".join(words[4 * i:4 * i + 100]) for i in range(300)]
    docs = pin(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    counted = {}

    def needed(groups, threshold, real=jaccard._needed):
        found = pin(real(groups, threshold))
        counted["all"] = jaccard._parts(groups, "_size", 8, ["_group"]).count()
        counted["sent"] = found.count()
        return found

    monkeypatch.setattr(jaccard, "_needed", needed)
    rows = jaccard.near_duplicates(docs).collect()
    assert {r["class_id"] for r in rows} == {0}
    sets = [{tuple(t.split()[k:k + 5]) for k in range(96)} for t in texts]
    for r in rows:
        i = r["doc_id"]
        links = sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in enumerate(sets) if j != i)
        assert r["n_links"] == links
    assert counted["all"] > 10_000 and counted["sent"] < counted["all"] / 3
