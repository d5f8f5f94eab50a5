"""Log-bilinear language model, trained with noise-contrastive estimation, scoring whole texts.

Tokens are words (A-Z folded, split at ASCII white space) and one end per text. The model predicts
units: the most frequent words (``UNITS`` at least, more as the vocabulary grows), the end, and ``CLASSES`` classes of all other words by their last
three bytes. The vectors of the two units before, each through its own matrix, add up to the vector that
is matched with every unit's; a softmax over all units gives a normalised probability. Within a class a
word has (count + 1) / (class tokens + class words + 1), which leaves a share for words never seen.

Word counts cover all training texts. Training runs on every partition: minibatches of positions against
shared noise units drawn from the unigram distribution. Each of ``ROUNDS`` rounds takes every ``ROUNDS``-th
position of each text, another phase each round, so that every token is learned from once; after a round the partitions' parameters are averaged, weighted by their positions.

A context's part of every logit is a sum of one term per context unit, so the exponentials are products and the
normalisers of all pairs of units are one product of two matrices, of near and of far units. Each process
works it out once, for as many near units as ``TABLE`` pairs hold, the most frequent first; contexts beyond, and
those whose product is too small to trust, get the plain sum.

Counts of the ``LOOKUP`` most frequent words go to every task (a bounded table); tokens of all other words
meet their counts in one shuffled join.

Null and empty texts are an end only. A null id counts as an empty id. Repeated rows are scored each, and
learned from as often as they stand. Without training text all counts are zero.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.llm import words as W
from boxline.llm.worker import kept, ship
from boxline.session import pin

# Words with a unit of their own: this many at least, and so many times the cube root of the vocabulary's size.
UNITS, UNITS_PER_ROOT, CLASSES = 512, 8, 256
SIZE = 24
LOOKUP = 1 << 18
ROUNDS = 2
BATCH, NOISE = 256, 96
RATE = 0.15
# Bytes of text whose contexts are looked at together, and contexts per product.
SCORE_BYTES = 4 << 20
CONTEXTS = 4096
# Pairs of units whose normalisers a process keeps (four bytes each), and units per product.
TABLE = 1 << 25
STEP = 512
# Least sum of products whose logarithm is taken from single precision.
LEAST = 1e-30
END_HASH = W.U64(0xE0D)


def fold(key: Column, folds: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(text), F.lit(folds))


def endings(block: W.Block, found: W.Words, which: slice | np.ndarray = slice(None)) -> np.ndarray:
    """The class of every word (of ``which`` words), from its last three bytes, A-Z folded."""
    starts, ends = found.starts[which], found.ends[which]
    code = np.zeros(len(ends), np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        inside = at >= starts
        byte = W._LOWER[block.data[np.maximum(at, 0)]]
        code = code * W.U64(257) + np.where(inside, byte + W.U64(1), W.U64(0))
    return (W.mix(code) % W.U64(CLASSES)).astype(np.int32)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, class, n): tokens of every word by its hash; the end is one of them, of class -1."""
    def count(batches):
        for batch in batches:
            ends = 0
            for block in W.blocks(batch.column(0), SCORE_BYTES):
                found = W.words(block)
                ends += len(block)
                words, first, n = np.unique(found.hashes, return_index=True, return_counts=True)
                if len(words):
                    yield _counts(W.signed(words), endings(block, found)[first], n)
            yield _counts(np.array([END_HASH]).view(np.int64), np.array([-1], np.int32),
                          np.array([ends]))

    def _counts(words, classes, n):
        return pa.RecordBatch.from_arrays(
            [pa.array(words), pa.array(classes), pa.array(n.astype(np.int64))],
            ["word", "class", "n"],
        )

    rows = docs.select(W.text_bytes(text)).mapInArrow(count, "word bigint, class int, n bigint")
    return rows.groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n")).where("n > 0")


@dataclass
class Vocabulary:
    """Frequent words (sorted by hash) with counts and units, class totals, and corpus totals."""

    words: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    end_count: int
    tokens: int
    types: int
    unigram: np.ndarray

    #: Frequent words with a unit; the end and the classes follow.
    frequent: int = UNITS
    #: Where a word stands in ``words`` by the first bits of its hash: the most frequent of those with the same.
    slots: np.ndarray | None = field(default=None, repr=False)

    @property
    def size(self) -> int:
        return self.frequent + 1 + CLASSES

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash in ``words``, and whether it stands there."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        bits = (4 * len(self.words) - 1).bit_length()
        shift = W.U64(64 - bits)
        if self.slots is None:
            self.slots = np.zeros(1 << bits, np.int32)
            order = np.argsort(self.counts, kind="stable")
            self.slots[self.words[order] >> shift] = order
        at = self.slots[hashes >> shift]
        hit = self.words[at] == hashes
        rest = np.flatnonzero(~hit)
        at[rest] = np.minimum(np.searchsorted(self.words, hashes[rest]), len(self.words) - 1)
        hit[rest] = self.words[at[rest]] == hashes[rest]
        return at, hit


def frequent_words(types: int) -> int:
    """Words that get a unit of their own in a vocabulary of ``types`` words."""
    return min(LOOKUP, max(UNITS, int(UNITS_PER_ROOT * np.cbrt(types))))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From counts of all words; ``LOOKUP`` rows and one row per class reach the driver."""
    totals = {r["class"]: (r["n"], r["v"]) for r in counts.groupBy("class").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")
    ).collect()}
    types = int(sum(t[1] for t in totals.values()))
    frequent = frequent_words(types)
    top = counts.where(F.col("class") >= 0).orderBy(F.desc("n"), "word").limit(LOOKUP).toArrow()
    words = top.column("word").to_numpy().view(np.uint64)
    n, classes = top.column("n").to_numpy(), top.column("class").to_numpy()
    class_tokens = np.array([totals.get(k, (0, 0))[0] for k in range(CLASSES)], np.int64)
    class_words = np.array([totals.get(k, (0, 0))[1] for k in range(CLASSES)], np.int64)
    np.subtract.at(class_tokens, classes[:frequent], n[:frequent])
    np.subtract.at(class_words, classes[:frequent], 1)
    units = np.where(np.arange(len(words)) < frequent, np.arange(len(words)), frequent + 1 + classes)
    end = totals.get(-1, (0, 0))[0]
    weights = np.zeros(frequent + 1 + CLASSES)
    weights[:min(frequent, len(n))], weights[frequent] = n[:frequent], end
    weights[frequent + 1:] = class_tokens
    order = np.argsort(words, kind="stable")
    return Vocabulary(
        words[order], n[order], units[order].astype(np.int32), class_tokens, class_words, int(end),
        int(sum(t[0] for t in totals.values())), types,
        (weights + 1) / (weights + 1).sum(), frequent,
    )


@dataclass
class Tokens:
    """Tokens of a block with the end of each text: units, counts (-1: not in the lookup), hashes."""

    units: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def contexts(self, start: int) -> tuple[np.ndarray, np.ndarray]:
        """The unit before each token and the one before that; ``start`` stands before a text."""
        one, two = np.full(len(self.units), start), np.full(len(self.units), start)
        one[1:], two[2:] = self.units[:-1], self.units[:-2]
        first = self.offsets[:-1]
        one[first] = start
        two[first] = start
        second = first + 1
        second = second[second < self.offsets[1:]]
        two[second] = start
        return one, two


def tokens(block: W.Block, known: Vocabulary) -> Tokens:
    found = W.words(block)
    at, hit = known.find(found.hashes)
    if len(known.words):
        units, counts = known.units[at], known.counts[at]
    else:
        units, counts = np.empty(len(at), np.int32), np.empty(len(at), np.int64)
    miss = np.flatnonzero(~hit)
    units[miss], counts[miss] = known.frequent + 1 + endings(block, found, miss), -1
    ends = found.offsets[1:]
    return Tokens(
        np.insert(units, ends, known.frequent), np.insert(counts, ends, known.end_count),
        np.insert(found.hashes, ends, END_HASH), found.offsets + np.arange(len(found.offsets)),
    )


@dataclass
class Model:
    """Vectors of predicted units, of context units (with the start), two matrices, and biases."""

    out: np.ndarray
    context: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, unigram: np.ndarray, seed: int = 17) -> Model:
        r, n = np.random.default_rng(seed), len(unigram)
        return cls(
            r.normal(0, 0.1, (n, SIZE)), r.normal(0, 0.1, (n + 1, SIZE)),
            np.eye(SIZE) * 0.7, np.eye(SIZE) * 0.7, np.log(unigram),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.out, self.context, self.near, self.far, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Model:
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        return Model(*(x.reshape(p.shape) for x, p in zip(np.split(flat, cuts), self.parts())))


def learn(
    model: Model, batches, unigram: np.ndarray, seed: int, rate: float = RATE
) -> tuple[Model, int]:
    """Noise-contrastive steps over (units, near context, far context) arrays, in single precision.

    A unit's bias, less the logarithm of its noise, is the last column of its vector, against a column of ones.
    """
    log_noise = np.log(NOISE * unigram)
    out = np.column_stack([model.out, model.bias - log_noise]).astype(np.float32)
    context = model.context.astype(np.float32)
    turn = np.concatenate([model.near, model.far]).astype(np.float32)
    steps, turn_sums = (Steps(out, rate), Steps(context, rate)), np.full(turn.shape, 1e-3, np.float32)
    r, cumulative, seen = np.random.default_rng(seed), np.cumsum(unigram), 0
    ones, back = np.ones((BATCH, SIZE + 1), np.float32), np.ones((BATCH + NOISE, SIZE + 1), np.float32)

    for units, near, far in batches:
        pairs = np.column_stack([near, far])
        drawn = np.searchsorted(
            cumulative, r.random((-(-len(units) // BATCH), NOISE)) * cumulative[-1]
        )
        for number, noise in enumerate(drawn):
            part = slice(number * BATCH, (number + 1) * BATCH)
            w, both = units[part], pairs[part].ravel()
            size = len(w)
            v = context.take(both, axis=0).reshape(size, 2 * SIZE)
            q, gradient = ones[:size], back[:size + NOISE]
            np.matmul(v, turn, out=q[:, :SIZE])
            right, wrong = out.take(w, axis=0), out.take(noise, axis=0)
            # Slopes of -log sigmoid(true) - sum of log sigmoid(-false); an overflow stands for zero.
            with np.errstate(over="ignore"):
                up = np.exp(np.einsum("ij,ij->i", q, right))
                down = -q @ wrong.T
                np.exp(down, out=down)
            up += 1
            np.divide(np.float32(-1 / size), up, out=up)
            down += 1
            np.divide(np.float32(1 / size), down, out=down)
            slope = down @ wrong[:, :SIZE]
            slope += up[:, None] * right[:, :SIZE]
            np.multiply(up[:, None], q, out=gradient[:size])
            np.matmul(down.T, q, out=gradient[size:])
            behind = (slope @ turn.T).reshape(-1, SIZE)
            change = v.T @ slope
            turn_sums += change * change
            turn -= np.float32(rate) * change / np.sqrt(turn_sums)
            steps[0].move(np.concatenate([w, noise]), gradient)
            steps[1].move(both, behind)
            seen += size
    out, context, turn = (x.astype(np.float64) for x in (out, context, turn))
    return Model(out[:, :SIZE], context, turn[:SIZE], turn[SIZE:], out[:, SIZE] + log_noise), seen


class Steps:
    """Steps of a matrix along gradients of some of its rows, each divided by the root of its squares so far."""

    def __init__(self, part: np.ndarray, rate: float):
        self.part, self.rate = part, np.float32(rate)
        self.sums, self.gathered = np.full(part.shape, 1e-3, np.float32), np.zeros(part.shape, np.float32)
        self.cells = np.arange(part.size).reshape(part.shape)
        self.touched = np.zeros(len(part), bool)

    def move(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Gradients of the same row are added before the step."""
        np.add.at(self.gathered.reshape(-1), self.cells.take(rows, axis=0).reshape(-1), gradient.reshape(-1))
        self.touched[rows] = True
        touched = np.flatnonzero(self.touched)
        self.touched[touched] = False
        total = self.gathered.take(touched, axis=0)
        self.gathered[touched] = 0
        sums = self.sums.take(touched, axis=0)
        sums += total * total
        self.sums[touched] = sums
        np.sqrt(sums, out=sums)
        total /= sums
        total *= self.rate
        np.subtract(self.part.take(touched, axis=0), total, out=total)
        self.part[touched] = total


def train(docs: DataFrame, known: Vocabulary, text: str = "text", rounds: int = ROUNDS) -> Model:
    """Rounds of training on every partition, with the parameters averaged after each."""
    model = Model.fresh(known.unigram)
    for number in range(rounds):
        share = ship(docs.sparkSession, (model, known))

        def run(batches, number=number, share=share):
            own, words = share()

            def positions():
                for batch in batches:
                    for block in W.blocks(batch.column(0), SCORE_BYTES):
                        t = tokens(block, words)
                        near, far = t.contexts(words.size)
                        # The phase differs from text to text and from round to round.
                        phase = (t.offsets[:-1] * 5 + number) % rounds
                        place = np.arange(len(t.units)) - np.repeat(t.offsets[:-1], np.diff(t.offsets))
                        pick = np.flatnonzero(
                            (place + np.repeat(phase, np.diff(t.offsets))) % rounds == 0
                        )
                        pick = np.random.default_rng(len(pick)).permutation(pick)
                        yield t.units[pick], near[pick], far[pick]

            after, seen = learn(own, positions(), words.unigram, seed=number)
            if seen:
                flat = after.flat()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(len(flat))), pa.array(flat * seen),
                    pa.array(np.full(len(flat), seen)),
                ], ["at", "value", "seen"])

        rows = docs.select(W.text_bytes(text)).mapInArrow(
            run, "at bigint, value double, seen bigint"
        )
        # One row per parameter.
        means = rows.groupBy("at").agg((F.sum("value") / F.sum("seen")).alias("value")).toArrow()
        if means.num_rows:
            flat = np.empty(means.num_rows)
            flat[means.column("at").to_numpy()] = means.column("value").to_numpy()
            model = model.filled(flat)
    return model


class Normalisers:
    """Logarithms of the sums over all units of exp(logit), for pairs of context units, and the vectors behind."""

    def __init__(self, model: Model, unigram: np.ndarray | None = None, pairs: int = 0):
        self.out, self.bias = model.out.astype(np.float32), model.bias.astype(np.float32)
        self.first = (model.context @ model.near).astype(np.float32)
        self.second = (model.context @ model.far).astype(np.float32)
        units = len(self.first)
        # The start stands before every text; it comes first, then units by frequency.
        near = np.zeros(0, np.int64) if not pairs else np.append(
            units - 1, np.argsort(-unigram, kind="stable")
        )[:pairs // units]
        self.row = np.full(units, -1, np.int64)
        self.row[near] = np.arange(len(near))
        self.table = self._products(near)

    def _products(self, near: np.ndarray) -> np.ndarray:
        first, second = self.first[near], self.second
        table = np.zeros((len(near), len(second)), np.float32)
        if not len(near):
            return table
        slices = [slice(low, low + STEP) for low in range(0, len(self.out), STEP)]
        top, far_top = np.full(len(near), -np.inf, np.float32), np.full(len(second), -np.inf, np.float32)
        for part in slices:
            np.maximum(top, (first @ self.out[part].T).max(axis=1), out=top)
            far = self.out[part] @ second.T + self.bias[part, None]
            np.maximum(far_top, far.max(axis=0), out=far_top)
        for part in slices:
            far = self.out[part] @ second.T
            far += self.bias[part, None]
            far -= far_top
            np.exp(far, out=far)
            for low in range(0, len(near), STEP):
                rows = slice(low, low + STEP)
                close = first[rows] @ self.out[part].T
                close -= top[rows, None]
                table[rows] += np.exp(close, out=close) @ far
        for low in range(0, len(near), STEP):
            rows = table[low:low + STEP]
            rows[rows < LEAST] = np.nan
            np.log(rows, out=rows)
            rows += top[low:low + STEP, None]
            rows += far_top
        return table

    def plain(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """By the sum over all units."""
        norm = np.empty(len(near), np.float64)
        for low in range(0, len(near), CONTEXTS):
            part = slice(low, low + CONTEXTS)
            z = (self.first[near[part]] + self.second[far[part]]) @ self.out.T
            z += self.bias
            top = z.max(axis=1)
            z -= top[:, None]
            norm[part] = top + np.log(np.exp(z, out=z).sum(axis=1, dtype=np.float64))
        return norm

    def of(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Of every context; what the table lacks is worked out once for each distinct context."""
        row = self.row[near]
        norm = np.full(len(near), np.nan)
        if len(self.table):
            norm = np.where(row >= 0, self.table[np.maximum(row, 0), far], norm)
        rest = np.flatnonzero(np.isnan(norm))
        if len(rest):
            units = len(self.first)
            codes, place = np.unique(near[rest].astype(np.int64) * units + far[rest], return_inverse=True)
            norm[rest] = self.plain(codes // units, codes % units)[place]
        return norm


def log_probabilities(
    model: Model, t: Tokens, start: int, norms: Normalisers | None = None
) -> np.ndarray:
    """Natural-log probability of every token's unit given the two units before."""
    near, far = t.contexts(start)
    norms = norms or Normalisers(model)
    match = np.empty(len(t.units), np.float64)
    for low in range(0, len(t.units), 1 << 14):
        part = slice(low, low + (1 << 14))
        q = norms.first.take(near[part], axis=0)
        q += norms.second.take(far[part], axis=0)
        match[part] = np.einsum("ij,ij->i", q, norms.out.take(t.units[part], axis=0))
    return match + norms.bias[t.units] - norms.of(near, far)


def process_normalisers(name: str, model: Model, unigram: np.ndarray) -> Normalisers:
    """The table of the scoring ``name``, worked out by the first task of a process; one is kept."""
    if kept().get("lblm", ("",))[0] != name:
        kept()["lblm"] = name, Normalisers(model, unigram, TABLE)
    return kept()["lblm"][1]


def score(
    docs: DataFrame, counts: DataFrame, known: Vocabulary, model: Model, key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every row, in log10."""
    kind = docs.schema[key].dataType.simpleString()
    share, name = ship(docs.sparkSession, (model, known)), uuid.uuid4().hex

    def apply(batches):
        own, words = share()
        norms = process_normalisers(name, own, words.unigram)
        class_total = np.log10(words.class_tokens + words.class_words + 1.0)
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for block in W.blocks(batch.column(2), SCORE_BYTES):
                t = tokens(block, words)
                n = np.diff(t.offsets)
                owner = np.repeat(np.arange(len(block)), n)
                logs = log_probabilities(own, t, words.size, norms) / np.log(10)
                rare = t.units > words.frequent
                logs[rare] -= class_total[t.units[rare] - words.frequent - 1]
                # log10(count + 1) of words in the lookup; the others get theirs by the join.
                plain = np.where(t.counts >= 0, np.log10(np.maximum(t.counts, 0) + 1.0), 0.0)
                sums = [np.bincount(owner, x, len(block)) for x in (
                    logs, np.where(rare, plain, 0.0), plain
                )]
                seen = np.bincount(owner, t.counts > 0, len(block)).astype(np.int64)
                row = ids[block.first:block.first + len(block)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row), pa.array(row), batch.column(0).slice(block.first, len(block)),
                    pa.array(n.astype(np.int64)), pa.array(seen), pa.array(sums[0] + sums[1]),
                    pa.array(sums[2]), pa.array(np.ones(len(block), np.int64)),
                    pa.array(np.zeros(len(block), np.int64)),
                ], names)
                # A word outside the lookup: one row per text and word.
                far = np.flatnonzero(t.counts < 0)
                if not len(far):
                    continue
                order = far[np.lexsort((t.hashes[far], owner[far]))]
                h, o = t.hashes[order], owner[order]
                new = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(h)))
                m = len(starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(W.signed(h[starts])), pa.array(row[o[starts]]),
                    pa.nulls(m, batch.column(0).type), *(pa.nulls(m, pa.int64()),) * 2,
                    *(pa.nulls(m, pa.float64()),) * 2, pa.array(np.zeros(m, np.int64)),
                    pa.array(times.astype(np.int64)),
                ], names)

    names = ["_word", "_row", "_doc", "_n", "_known", "_score", "_base", "_main", "_times"]
    schema = (
        f"_word bigint, _row bigint, _doc {kind}, _n bigint, _known bigint, _score double, "
        "_base double, _main bigint, _times bigint"
    )
    # Equal rows share a name; their sums are divided again.
    rows = docs.select(
        F.col(key).alias("_doc"), F.xxhash64(F.col(key), F.col(text)).alias("_row"),
        W.text_bytes(text).alias("_bytes"),
    ).mapInArrow(apply, schema)
    found = rows.join(counts.select(F.col("word").alias("_word"), "n"), "_word", "left")
    count = F.when(F.col("_main") == 0, F.coalesce("n", F.lit(0))).otherwise(F.lit(0))
    add = F.col("_times") * F.log10(count + F.lit(1.0))
    sums = found.groupBy("_row").agg(
        F.first("_doc", ignorenulls=True).alias(key), F.sum("_main").alias("_copies"),
        F.max("_n").alias("n_tokens"), F.max("_known").alias("_known"),
        F.sum(F.when(count > 0, F.col("_times")).otherwise(F.lit(0))).alias("_more"),
        F.max("_score").alias("_score"), F.max("_base").alias("_base"), F.sum(add).alias("_add"),
    )
    each = F.col("_add") / F.col("_copies")
    space = float(np.log10(known.tokens + known.types + 1.0))
    out = sums.select(
        key, "n_tokens",
        (F.col("_known") + (F.col("_more") / F.col("_copies")).cast("long")).alias("n_known"),
        (F.col("_base") + each - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        (F.col("_score") + each).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")


def language_model_scores(
    docs: DataFrame, folds: int = 7, out_fold: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Scores of all rows by a model learned from those outside fold ``out_fold`` of their id's crc32."""
    learned = docs.where(fold(F.col(key), folds) != out_fold)
    counts = pin(word_counts(learned, text))
    known = vocabulary(counts)
    model = train(learned, known, text)
    scored = score(docs, counts, known, model, key, text)
    return scored.select(
        key, (fold(F.col(key), folds) == out_fold).alias("held_out"), "n_tokens", "n_known",
        F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
