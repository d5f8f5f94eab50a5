"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Each text is a set of indicators: its words, and one to three shapes in a row (see ``words.shapes``),
hashed to ``BUCKETS`` columns. Columns are scaled by the log ratio of their class counts, a linear
hinge-loss model is fitted by dual coordinate descent, and a logistic curve fitted to margins of
rows left out of the descent turns a margin into a probability.

Null and empty texts have no indicator but the constant one and get the score that the constant
gives. Repeated rows are scored each. Labels that are null, or whose document is missing, are left
out; a document with several labels counts with their mean (0.5 or more is 1). With labels of one
class or none, every score is the share of label 1 (1.0 when there is no label).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from boxline.llm import words as W
from boxline.llm.worker import ship

BUCKETS = 1 << 18
# Most labelled documents that a fit reads, chosen by a hash of their id.
TRAIN_ROWS = 12_000
# One of so many of them is kept for the curve from margins to probabilities.
CURVE_FOLD = 5


def indicator_sets(block: W.Block) -> list[np.ndarray]:
    """Sorted distinct columns of each text of a block."""
    found = W.words(block)
    shape = W.shapes(block, found)
    out = []
    for i in range(len(block)):
        low, high = found.offsets[i], found.offsets[i + 1]
        own = shape[low:high]
        parts = [found.hashes[low:high], *(W.ngrams(own, n) for n in (1, 2, 3))]
        columns = np.concatenate(parts) >> W.U64(64 - 18)
        out.append(np.unique(columns.astype(np.int32)))
    return out


@dataclass
class Model:
    """Column weights (ratio times support-vector weight), intercept, and the curve."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def margin(self, columns: np.ndarray) -> float:
        if not len(columns):
            return self.intercept
        # Texts of any length have features of one length.
        return float(self.weights[columns].sum()) / np.sqrt(len(columns)) + self.intercept

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed class counts of every column."""
    counts = [np.full(BUCKETS, smooth), np.full(BUCKETS, smooth)]
    for columns, label in zip(rows, labels):
        counts[label][columns] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(
    rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray,
    rounds: int = 20, seed: int = 5,
) -> tuple[np.ndarray, float]:
    """Hinge-loss weights: each step solves the dual for one row exactly, the others held."""
    weights, intercept = np.zeros(BUCKETS), 0.0
    alpha, sign = np.zeros(len(rows)), np.where(labels == 1, 1.0, -1.0)
    norm = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (values[i] @ weights[rows[i]] + intercept) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[rows[i]] += step * values[i]
                intercept += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, intercept


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1 | margin), by Newton steps on smoothed targets."""
    ones = labels.sum()
    zeros = len(labels) - ones
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, offset = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
        w, r = p * (1 - p) + 1e-9, p - target
        g = np.array([r @ margins + 1e-3 * (slope - 1), r.sum()])
        cross = w @ margins
        h = np.array([[w @ margins**2 + 1e-3, cross], [cross, w.sum()]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        slope, offset = slope - scale * step[0], offset - scale * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(slope, 1e-3), offset


def fit(rows: list[np.ndarray], labels: np.ndarray, penalty: float = 1.0) -> Model:
    """A model from indicator sets and 0/1 labels."""
    share = float(labels.mean()) if len(labels) else 1.0
    if not 0 < labels.sum() < len(labels) or min(labels.sum(), len(labels) - labels.sum()) < 2:
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(odds))

    def solve(chosen: np.ndarray) -> Model:
        part, y = [rows[i] for i in chosen], labels[chosen]
        ratios = log_count_ratios(part, y)
        values = [ratios[c] / np.sqrt(max(1, len(c))) for c in part]
        # Both classes weigh the same, whatever their sizes.
        ones = max(1, y.sum())
        cost = penalty * np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * max(1, len(y) - ones)))
        weights, intercept = dual_descent(part, values, y, cost)
        return Model(weights * ratios, intercept, 1.0, 0.0)

    place = np.arange(len(rows))
    curve = place[place % CURVE_FOLD == 0]
    inner = solve(place[place % CURVE_FOLD != 0])
    margins = np.array([inner.margin(rows[i]) for i in curve])
    slope, offset = logistic_curve(margins, labels[curve])
    model = solve(place)
    return Model(model.weights, model.intercept, slope, offset)


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS,
    keep=None, key: str = "doc_id", text: str = "text", classes: bool = False,
) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicator sets and labels of at most ``limit`` labelled documents outside the held-out fold.

    The ids are chosen by hash before any text is read; ids and labels are bounded by ``limit``.
    ``keep(id column)`` says which documents may be learned from. With ``classes`` labels are any
    whole numbers and the least of a document's labels counts; without, 0 and 1.
    """
    marks = labels.select(F.col(key).alias("_id"), F.col(label).cast("double").alias("_label"))
    marks = marks.where(F.col("_id").isNotNull() & F.col("_label").isNotNull())
    if keep is not None:
        marks = marks.where(keep(F.col("_id")))
    one = F.min("_label") if classes else (F.avg("_label") >= 0.5)
    marks = marks.groupBy("_id").agg(one.cast("int").alias("_label"))
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    texts = docs.select(F.col(key).alias("_id"), W.text_bytes(text).alias("_text"))

    def extract(batches):
        for batch in batches:
            ids, sets = batch.column(1), []
            for block in W.blocks(batch.column(2)):
                sets += [s.tobytes() for s in indicator_sets(block)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(sets, pa.binary())], ["_id", "_label", "_set"]
            )

    # ``chosen`` has at most ``limit`` narrow rows.
    found = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")
    kind = found.schema["_id"].dataType.simpleString()
    # Copies of a document id could repeat a row; the same bound holds for what is fetched.
    got = found.mapInArrow(extract, f"_id {kind}, _label int, _set binary")
    got = got.orderBy(F.xxhash64("_id"), "_id", "_set").limit(limit).collect()
    rows = [np.frombuffer(r["_set"], np.int32) for r in got]
    return rows, np.array([r["_label"] for r in got], np.int64)


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    return fit(*training_rows(docs, labels, **options))


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text."""
    carried = [c for c in docs.columns if c != output]
    weights = model.weights.astype(np.float32)
    narrow = Model(weights, model.intercept, model.slope, model.offset)
    share = ship(docs.sparkSession, narrow)
    schema = [docs.schema[c] for c in carried]

    def apply(batches):
        own = share()
        for batch in batches:
            margins = []
            for block in W.blocks(batch.column(0)):
                margins += [own.margin(s) for s in indicator_sets(block)]
            values = own.probability(np.array(margins, np.float64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(values, pa.float64())], [*carried, output]
            )

    out = StructType([*schema, StructField(output, DoubleType())])
    return docs.select(W.text_bytes(text).alias("_text_bytes"), *carried).mapInArrow(apply, out)


def held_out(key, folds: int = 5, fold: int = 0):
    """True for ids whose crc32, as text, falls in the held-out fold; a null id is an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
