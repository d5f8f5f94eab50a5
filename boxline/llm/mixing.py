"""Mixing to target weights by soft membership in domains.

A softmax classifier learned from a label table gives every document a posterior over domains. A
document of ``n`` tokens with posterior ``p`` gives domain k ``n * p[k]`` expected tokens. Rates r >= 0
minimise the squared relative gap between the expected tokens of each domain and its target. Starting
from r = 1, projected-gradient steps ``r <- max(0, r - n^-1 * gradient)`` run over the whole table: the
gap has one number per domain, so a pass only sums a few numbers per partition, and a document's rate
follows from its posterior and the steps so far. Steps are scaled by the domains' Gram matrix and
halved while they don't lower the gap.

``bounds`` may give domains a least and a largest rate. They hold for every document whose posterior is
largest for that domain (the first of equal ones), and the steps are projected onto them; targets that no
rates within the bounds meet are approached as far as these allow.

Null or empty texts have no tokens: they don't bear on the fit and get the rate of their posterior.
Repeated rows are documents of their own with equal rates. Labels that are null or have no document
are left out. Without any label, all domains are alike and every rate is the total over its present
size. A target of zero asks for no tokens of that domain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from boxline.llm import words as W
from boxline.llm.quality import BUCKETS, indicator_sets, training_rows
from boxline.llm.worker import ship
from boxline.session import pin

# Most labelled documents that the classifier learns from, chosen by a hash of their id.
TRAIN_ROWS = 8_000
# Indicators of fewer training documents carry no weight.
LEAST_DOCUMENTS = 3
# The fit ends when every domain is this close to its target (a share of all tokens).
TOLERANCE = 1e-6
MOST_STEPS = 40


class Posterior:
    """Softmax weights per indicator and domain."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def of(self, columns: np.ndarray) -> np.ndarray:
        z = self.bias.copy()
        if len(columns):
            z += self.weights[columns].sum(axis=0) / np.sqrt(len(columns))
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_posterior(
    rows: list[np.ndarray], labels: np.ndarray, domains: int, epochs: int = 8, rate: float = 0.3,
    decay: float = 1e-6, seed: int = 3,
) -> Posterior:
    """Adaptive-gradient softmax regression on indicator sets."""
    weights, squares = np.zeros((BUCKETS, domains), np.float32), np.full(BUCKETS, 1e-2, np.float32)
    counts = np.bincount(labels, minlength=domains) + 0.5 if len(labels) else np.ones(domains)
    bias = np.log(counts / counts.sum())
    seen = np.zeros(BUCKETS, np.int32)
    for columns in rows:
        seen[columns] += 1
    kept = [c[seen[c] >= LEAST_DOCUMENTS] for c in rows]
    scale = [1 / np.sqrt(max(1, len(c))) for c in rows]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            columns = kept[i]
            z = bias + weights[columns].sum(axis=0) * scale[i]
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[labels[i]] -= 1
            step = error * scale[i]
            squares[columns] += step @ step
            weights[columns] -= (
                rate * step[None, :] / np.sqrt(squares[columns])[:, None]
                + decay * weights[columns]
            )
            bias -= 0.002 * error
    return Posterior(weights, bias)


def domain_posteriors(docs: DataFrame, model: Posterior, text: str = "text") -> DataFrame:
    """``docs`` with _tokens (words of the whole text) and _posterior; such columns are replaced."""
    carried = [c for c in docs.columns if c not in ("_tokens", "_posterior", "_rate", "_copies")]
    share = ship(docs.sparkSession, model)

    def apply(batches):
        own = share()
        for batch in batches:
            tokens, posteriors = [], []
            for block in W.blocks(batch.column(0)):
                tokens.append(np.diff(W.words(block).offsets))
                posteriors += [own.of(c) for c in indicator_sets(block)]
            tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(tokens.astype(np.int64)),
                 pa.array(posteriors, pa.list_(pa.float64()))],
                [*carried, "_tokens", "_posterior"],
            )

    schema = StructType([
        *(docs.schema[c] for c in carried), StructField("_tokens", LongType()),
        StructField("_posterior", ArrayType(DoubleType())),
    ])
    return docs.select(W.text_bytes(text).alias("_text_bytes"), *carried).mapInArrow(apply, schema)


def rates_of(
    posteriors: np.ndarray, start: float, steps: list[np.ndarray], bounds: np.ndarray | None = None,
) -> np.ndarray:
    """Rates after the given steps, each held within the document's bounds (from zero on without any)."""
    low, high = 0.0, np.inf
    if bounds is not None:
        low, high = bounds[posteriors.argmax(axis=1)].T
    rates = np.clip(np.full(len(posteriors), start), low, high)
    for step in steps:
        rates = np.clip(rates - posteriors @ step, low, high)
    return rates


def _posterior_rows(batch: pa.RecordBatch, at: int, domains: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def _pass(
    members: DataFrame, start: float, steps: list[np.ndarray], domains: int,
    bounds: np.ndarray | None = None,
):
    """(expected tokens of each domain, Gram matrix of the documents that aren't held at a bound)."""
    def sums(batches):
        total, gram = np.zeros(domains), np.zeros((domains, domains))
        for batch in batches:
            n, p = batch.column(0).to_numpy().astype(float), _posterior_rows(batch, 1, domains)
            rates = rates_of(p, start, steps, bounds)
            total += (rates * n) @ p
            free = rates > 0
            if bounds is not None:
                low, high = bounds[p.argmax(axis=1)].T
                # Before the first step it isn't known which way a rate will go.
                free = (rates > low) & (rates < high) if steps else np.ones(len(p), bool)
            live = p * (n * free)[:, None]
            gram += live.T @ p
        flat = np.concatenate([total, gram.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "value"]
        )

    rows = members.select("_tokens", "_posterior").mapInArrow(sums, "at bigint, value double")
    got = rows.groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(domains + domains**2)
    for r in got:
        flat[r["at"]] = r["value"]
    return flat[:domains], flat[domains:].reshape(domains, domains)


def fit_rates(
    members: DataFrame, weights: np.ndarray, total: float | None = None,
    tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS, bounds: np.ndarray | None = None,
) -> tuple[float, list[np.ndarray]]:
    """(first rate, steps): ``rates_of`` gives every document's rate from them and ``bounds``.

    ``weights`` are shares of the target ``total`` (all present tokens when not given). ``bounds``: the least
    and the largest rate of each domain.
    """
    domains = len(weights)
    now, gram = _pass(members, 1.0, [], domains)
    present = now.sum()
    if not present:
        return 1.0, []
    total = present if total is None else total
    start = total / present
    targets = np.asarray(weights, float) / np.sum(weights) * total
    steps: list[np.ndarray] = []
    now = now * start
    if bounds is not None and start != 1.0:
        now, gram = _pass(members, start, [], domains, bounds)
    gap, scale = (now - targets) / total, 1.0
    for _ in range(most_steps):
        if np.abs(gap).max() <= tolerance:
            break
        ridge = 1e-9 * np.trace(gram) / domains * np.eye(domains)
        step = scale * np.linalg.lstsq(gram + ridge, (now - targets), rcond=None)[0]
        after, after_gram = _pass(members, start, [*steps, step], domains, bounds)
        if bounds is not None and np.allclose(after, now, rtol=1e-9, atol=0):
            break  # the bounds hold every rate that would move
        if np.linalg.norm((after - targets) / total) >= np.linalg.norm(gap):
            scale /= 2
            if scale < 1e-4:
                break
            continue
        last = np.linalg.norm(gap)
        steps, now, gram, scale = [*steps, step], after, after_gram, min(1.0, 2 * scale)
        gap = (now - targets) / total
        if bounds is not None and np.linalg.norm(gap) > 0.99 * last:
            break  # the bounds keep the targets out of reach
    return start, steps


def mix(
    docs: DataFrame, marks: DataFrame, targets: dict[str, float], domain: str = "domain",
    key: str = "doc_id", text: str = "text", total: float | None = None,
    train_rows: int = TRAIN_ROWS, bounds: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """``docs`` with _tokens, _posterior (in the order of ``targets``), _rate and _copies.

    ``marks``: the label table, with ``key`` and ``domain`` (a name in ``targets``). ``_copies`` is the rate
    rounded up or down by a hash of the document, so that its mean is the rate. ``bounds``: the least and
    the largest rate of documents that the posterior gives to a domain; a least rate of one keeps them all.
    """
    names = list(targets)
    numbered = marks.select(key, F.array_position(
        F.array(*map(F.lit, names)), F.col(domain)
    ).alias("_domain")).where("_domain > 0")
    rows, labels = training_rows(
        docs, numbered.select(key, (F.col("_domain") - 1).alias("_domain")), label="_domain",
        limit=train_rows, key=key, text=text, classes=True,
    )
    model = fit_posterior(rows, labels, len(names))
    members = pin(domain_posteriors(docs, model, text))
    held = None if bounds is None else np.array([bounds.get(x, (0.0, np.inf)) for x in names], float)
    start, steps = fit_rates(
        members, np.array([targets[x] for x in names], float), bounds=held
    )
    count, carried = len(names), members.columns

    def apply(batches):
        for batch in batches:
            p = _posterior_rows(batch, batch.num_columns - 1, count)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rates_of(p, start, steps, held))], [*carried, "_rate"]
            )

    rated = members.mapInArrow(
        apply, StructType([*members.schema.fields, StructField("_rate", DoubleType())])
    )
    chance = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rated.withColumn("_copies", F.floor(F.col("_rate") + chance).cast("int"))
