"""Periodic runs against a loop over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxline.llm import queries, runs
from boxline.llm import words as W

WORD = re.compile("[^\x20\x09-\x0d]+")
SALT = W.mix(np.arange(64, dtype=np.uint64) + np.uint64(99))


def loop_runs(words, least=12):
    """[(start, length, period)]: every stretch of equal words a period apart, by its smallest period."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


def digest(doc_id, text):
    """The contract's row of a text, by loops."""
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = [(s, n, q) for s, n, q in sorted(loop_runs(words), key=lambda r: (r[0], r[2]))]
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    rest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *rest, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(
    st.lists(st.integers(0, 2), max_size=80),
    st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(1, 9)).map(lambda x: x[0] * x[1]),
    st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=6)
    .map(lambda xs: [w for p, k in xs for w in p * k]),
), max_size=5))
def test_runs_of_several_texts(texts):
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int)
    found = runs.find_runs(SALT[np.array([w for t in texts for w in t], int)], offsets)
    got = sorted(zip(found.start.tolist(), (found.end - found.start).tolist(), found.period.tolist()))
    assert got == sorted((s + o, n, q) for t, o in zip(texts, offsets) for s, n, q in loop_runs(t))


def test_range_successor():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64):
        values = rng.permutation(n)
        tree = runs.WaveletTree(values)
        low, high = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200)
        low, high = np.minimum(low, high), np.maximum(low, high)
        least = rng.integers(0, n + 2, 200)
        want = [min((v for v in values[a:b].tolist() if v >= x), default=-1) for a, b, x in zip(low, high, least)]
        assert tree.successor(low, high, least).tolist() == want


def test_query(spark, folder):
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_periodic_runs(spark, folder).collect()}
    assert len(got) == len(rows)
    short = [r for r in rows if len(r["text"] or "") < 9_000]
    assert sum(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in short) > 10
    for r in short:
        assert got[r["doc_id"]] == digest(r["doc_id"], r["text"]), r["doc_id"]


def test_edges(spark):
    long = "x y z " * 30_000 + "end"
    rows = [
        (1, None, 0, 0), (2, "", 0, 0), (3, " \t\n ", 0, 0), (None, "a " * 40, 0, 0), (5, "b b b b b b b b b b b b", 0, 0),
        (5, "b b b b b b b b b b b b", 0, 0), (6, "a b " * 8 + "c " + "d e " * 8, 0, 0), (7, long, 0, 0),
    ]
    # Extra columns with names of the result's own.
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int, n_runs int")
    got = runs.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i in (1, 2, 3):
        assert by[i][0]["n_runs"] == 0 and by[i][0]["start"] is None and by[i][0]["collapsed"] == ""
    assert by[None][0]["n_words"] == 40 and by[None][0]["period"] == 1 and by[None][0]["collapsed"] == "a"
    assert by[5][0] == by[5][1] and by[5][0]["exponent_milli"] == 12_000
    # Equal lengths: the first run.
    assert (by[6][0]["start"], by[6][0]["length"], by[6][0]["period"]) == (0, 16, 2)
    assert by[6][0]["collapsed"] == "a b c d e" and len(by[6][0]["runs"]) == 2
    assert (by[7][0]["length"], by[7][0]["period"]) == (90_000, 3)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(0, np.uint64), np.zeros(1, int), least=5)
