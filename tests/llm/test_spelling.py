"""Spelling groups against loops over all words and all their edits."""

import collections
import re
import zlib

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from boxline.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def loop_words(rows, letters=6, least=5):
    counts = collections.Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            word = lower(run)
            h = zlib.crc32(f"{key}:{word}".encode())
            if key is not None and h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= letters:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= least}


def edits(word, alphabet):
    """All texts one edit away."""
    out = set()
    for i in range(len(word) + 1):
        out.update(word[:i] + c + word[i:] for c in alphabet)
        if i < len(word):
            out.add(word[:i] + word[i + 1:])
            out.update(word[:i] + c + word[i + 1:] for c in alphabet)
    return out - {word}


def loop_groups(words):
    """{word: (form, root, n, n_near, form_n)}."""
    alphabet = {c for w in words for c in w}
    form, near = {}, {}
    for w, n in words.items():
        others = [x for x in edits(w, alphabet) if x in words]
        near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, near[w], words.get(form[w]))
    return out


def result(frame):
    rows = frame.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query(spark, folder):
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    words = loop_words([(r["doc_id"], r["text"]) for r in rows])
    want = loop_groups(words)
    assert len(want) > 500 and any(w[3] > 1 for w in want.values())
    assert result(queries.op11_spelling_groups(spark, folder)) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcé"), min_size=6, max_size=10), max_size=25), st.data())
def test_halves_find_every_near_word(words, data):
    words = set(words)
    for w in sorted(words)[:10]:
        words.add(data.draw(st.sampled_from(sorted(e for e in edits(w, "abcé") if len(e) >= 6))))
    count = collections.Counter(w[i:i + 2] for w in words for i in range(len(w) - 1))
    rank = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in count.items()))}
    looked = {w: set(spelling.signature(w, rank, count)[0]) for w in words}
    found = {w: set(spelling.signature(w, rank, count)[1]) for w in words}
    for a in words:
        for b in words & edits(a, "abcé"):
            assert looked[a] & found[b] or looked[b] & found[a], (a, b)


def test_split_is_least():
    places, counts = [0, 2, 3, 6], [5, 1, 9, 2]
    cost = {
        m: min(c for p, c in zip(places, counts) if p + 2 <= m) * spelling.SHRINK ** (m - 2)
        + min(c for p, c in zip(places, counts) if p >= m) * spelling.SHRINK ** (8 - m - 2)
        for m in range(2, 7)
    }
    assert spelling.split_at(places, counts, 8) == min(cost, key=cost.get)


def test_chains_and_edges(spark):
    # word x times, with chains of forms and ties; capitals fold, other letters don't.
    times = {"abcdefgh": 500, "abcdefgx": 50, "abcdefyx": 5, "zzzzzzzz": 7, "qrstuv": 60, "qrstuw": 60, "qrstuÉ": 6,
             "short": 90, "rareword": 4, "aaaaaaaa": 40, "aaaaaaa": 5}
    rows = [(None, " ".join([w] * n), "x", 1) for w, n in times.items()]
    rows += [(1, None, "x", 1), (2, "", "x", 1), (3, " 12 - ", "x", 1), (None, "ABCDEFGH,abcDEFgh", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int")
    got = result(spelling.spelling_groups(docs))
    want = loop_groups(loop_words([(r[0], r[1]) for r in rows]))
    assert got == want
    assert got["abcdefyx"][:2] == ("abcdefgx", "abcdefgh") and got["abcdefgh"][2] == 502
    assert got["qrstuÉ"][0] == "qrstuv"
    assert spelling.spelling_groups(docs.limit(0)).count() == 0


def test_misspelt_words(spark):
    rows = [(i, " ".join(["Wonderful", "naïvetés", "sixsix"] * 3)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    words = loop_words(rows)
    assert any(len(w) == 8 for w in words)
    assert result(spelling.spelling_groups(docs)) == loop_groups(words)
