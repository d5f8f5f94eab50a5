"""Quality rules by weak supervision.

Every rule votes for a text (1), against it (-1) or abstains (0). Expectation-maximisation estimates the
share of good texts and, for every rule, how often it votes each way on good and on bad texts; no label is
used. The estimate reads counts of vote patterns, of which there are at most 3^rules. A text is kept when its
posterior probability of being good reaches ``LEAST`` and it doesn't fail the base test.

Null, empty and blank texts have no words: all their counts are zero, every rule abstains but the one on
length, and they fail the base test. Repeated rows get equal verdicts. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.llm import words as W
from boxline.session import pin

LEAST = 0.5
MOST_ROUNDS, CLOSE = 200, 1e-9
#: The signs that count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters",
    "n_capitals", "n_same_words", "n_letter_words", "n_ended_lines", "n_pipe_lines", "n_kinds",
]
_IS = {name: np.zeros(256, bool) for name in ("symbol", "capital", "letter", "end")}
_IS["symbol"][list(SYMBOLS)] = True
_IS["capital"][ord("A"):ord("Z") + 1] = True
_IS["letter"][ord("A"):ord("Z") + 1] = _IS["letter"][ord("a"):ord("z") + 1] = True
_IS["letter"][128:] = True
_IS["end"][list(b".!?:;\"')")] = True


def _repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is equal to an earlier one, occurs twice or more) of every hash."""
    _, first, place, count = np.unique(
        hashes, return_index=True, return_inverse=True, return_counts=True
    )
    later = np.ones(len(hashes), bool)
    later[first] = False
    return later, (count > 1)[place]


def text_counts(block: W.Block) -> np.ndarray:
    """One row of ``COUNTS`` per text."""
    out = np.zeros((len(block), len(COUNTS)), np.int64)
    data, offsets = block.data, block.offsets
    found = W.words(block, lower=False)

    def sums(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    spaces = W._SPACE[data]
    # A code point is a byte that doesn't continue one.
    out[:, 1] = sums(((data & 0xC0) != 0x80) & ~spaces)
    out[:, 2] = sums(_IS["symbol"][data])
    out[:, 6], out[:, 7] = sums(_IS["letter"][data] & ((data & 0xC0) != 0x80)), sums(_IS["capital"][data])
    letters = np.concatenate([[0], np.cumsum(_IS["letter"][data])])
    lettered = letters[found.ends] > letters[found.starts]
    breaks = np.flatnonzero(data == 0x0A)
    for i in range(len(block)):
        low, high = found.offsets[i], found.offsets[i + 1]
        n = high - low
        if not n:
            continue
        own = found.hashes[low:high]
        _, kinds = np.unique(own, return_counts=True)
        out[i, 0], out[i, 12] = n, len(kinds)
        out[i, 8], out[i, 9] = (own[1:] == own[:-1]).sum(), lettered[low:high].sum()
        if n >= 3:
            _, again = _repeated(W.ngrams(own, 3))
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k:n - 2 + k] |= again
            out[i, 4] = covered.sum()
        x, y = np.searchsorted(breaks, [offsets[i], offsets[i + 1]])
        starts = np.concatenate([[offsets[i]], breaks[x:y] + 1])
        ends = np.concatenate([breaks[x:y], [offsets[i + 1]]])
        a = np.searchsorted(found.starts, starts)
        b = np.searchsorted(found.starts, ends)
        full = b > a
        starts, ends, b = starts[full], ends[full], b[full]
        text = data[offsets[i]:offsets[i + 1]]
        lines = W.span_hashes(text, starts - offsets[i], ends - offsets[i])
        later, _ = _repeated(lines)
        out[i, 3], out[i, 5] = later.sum(), len(lines)
        out[i, 10] = _IS["end"][data[found.ends[b - 1] - 1]].sum()
        pipes = np.concatenate([[0], np.cumsum(text == ord("|"))])
        out[i, 11] = (pipes[ends - offsets[i]] - pipes[starts - offsets[i]] > 1).sum()
    return out


def _against(share, most):
    """-1 where a share is over its limit, else no vote."""
    return np.where(share > most, -1, 0)


def _prose(c):
    lines = np.maximum(1, c["n_lines"])
    return np.where(
        (c["n_symbols"] <= 0.05 * c["n_words"]) & (c["n_capitals"] <= 0.2 * c["n_letters"])
        & (c["n_letter_words"] >= 0.85 * c["n_words"]) & (c["n_same_words"] <= 0.02 * c["n_words"])
        & (c["n_pipe_lines"] <= 0.1 * lines)
        & ((c["n_lines"] < 3) | (c["n_ended_lines"] >= 0.5 * lines)),
        1, 0,
    )


def _vocabulary(c):
    richness = c["n_kinds"] / c["n_words"] * np.log1p(c["n_words"])
    return np.where(richness >= 1.5, 1, np.where(richness < 0.6, -1, 0))


#: Rules by name: votes from the counts of texts with at least one word. A text that fails in one way looks
#: well in all others, so rules on single faults only vote against.
RULES = {
    "prose": _prose,
    "vocabulary": _vocabulary,
    "length": lambda c: np.where(c["n_words"] < 20, -1, 0),
    "word_length": lambda c: np.where(
        (c["word_chars"] < 2.5 * c["n_words"]) | (c["word_chars"] > 12 * c["n_words"]), -1, 0
    ),
    "symbols": lambda c: _against(c["n_symbols"] / c["n_words"], 0.1),
    "repeated_lines": lambda c: _against(c["n_dup_lines"] / np.maximum(1, c["n_lines"]), 0.5),
    "repeated_words": lambda c: _against(c["n_repeat_words"] / c["n_words"], 0.4),
    "capitals": lambda c: _against(c["n_capitals"] / np.maximum(1, c["n_letters"]), 0.4),
    "same_words": lambda c: _against(c["n_same_words"] / c["n_words"], 0.2),
    "few_letters": lambda c: _against(1 - c["n_letter_words"] / c["n_words"], 0.3),
    "open_lines": lambda c: _against(
        np.where(c["n_lines"] < 3, 0, 1 - c["n_ended_lines"] / np.maximum(1, c["n_lines"])), 0.8
    ),
    "tables": lambda c: _against(c["n_pipe_lines"] / np.maximum(1, c["n_lines"]), 0.4),
}


def votes(counts: np.ndarray) -> np.ndarray:
    """One row of votes per text."""
    named = {name: counts[:, k] for k, name in enumerate(COUNTS)}
    empty = named["n_words"] == 0
    named["n_words"] = np.maximum(1, named["n_words"])
    out = np.column_stack([rule(named) for rule in RULES.values()]).astype(np.int8)
    out[empty] = 0
    out[empty, list(RULES).index("length")] = -1
    return out


def estimate(patterns: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """(share of good texts, log odds table [rule, vote + 1]) by expectation-maximisation.

    Votes of a rule depend on the text's class only. Texts fail in many ways, most of them by one or two
    rules, so it starts from bad texts being those that any rule votes against.
    """
    m = patterns.shape[1]
    good = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    share, odds = 0.5, np.zeros((m, 3))
    for _ in range(MOST_ROUNDS):
        tables = []
        for p in (good, 1 - good):
            mass = np.array([
                [(weight * p)[patterns[:, r] == v].sum() for v in (-1, 0, 1)] for r in range(m)
            ]) + 0.5
            tables.append(mass / mass.sum(axis=1, keepdims=True))
        share = min(max(float((weight * good).sum() / weight.sum()), 1e-6), 1 - 1e-6)
        odds = np.log(tables[0]) - np.log(tables[1])
        new = posterior(patterns, share, odds)
        moved = np.abs(new - good).max()
        good = new
        if moved < CLOSE:
            break
    return share, odds


def posterior(patterns: np.ndarray, share: float, odds: np.ndarray) -> np.ndarray:
    logit = np.log(share / (1 - share)) + odds[np.arange(patterns.shape[1]), patterns + 1].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def judge(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST
) -> DataFrame:
    """(key, counts, one vote column per rule, p_good, base_failed, kept) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    names = [f"vote_{r}" for r in RULES]

    def apply(batches):
        for batch in batches:
            parts = [text_counts(block) for block in W.blocks(batch.column(1))]
            counts = np.vstack(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            cast = votes(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts.T.copy()),
                 *(pa.array(c) for c in cast.T.copy())],
                [key, *COUNTS, *names],
            )

    schema = ", ".join([
        f"`{key}` {kind}", *(f"{c} bigint" for c in COUNTS), *(f"{n} tinyint" for n in names)
    ])
    rows = docs.select(F.col(key), W.text_bytes(text).alias("_bytes")).mapInArrow(apply, schema)
    rows = pin(rows)
    # At most 3^rules rows, whatever the table's size.
    got = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    if got:
        patterns = np.array([[r[n] for n in names] for r in got], np.int64)
        share, odds = estimate(patterns, np.array([r["n"] for r in got], float))
    else:
        share, odds = 0.5, np.zeros((len(names), 3))
    # The logit adds up from one number per rule and vote.
    logit = F.lit(float(np.log(share / (1 - share))))
    for n, row in zip(names, odds.tolist()):
        logit = logit + F.when(F.col(n) < 0, row[0]).when(F.col(n) > 0, row[2]).otherwise(row[1])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("p_good", 1 / (1 + F.exp(-logit))).withColumn(
        "base_failed", failed
    ).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


