"""Every corpus query against a plain loop over the same table, an exact round trip, or held-out labels."""

import collections
import html
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from boxline.llm import decontaminate, jaccard, pseudonyms, queries, rules, shards, tokens
from boxline.llm import words as W
from boxline.session import pin

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts(folder):
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def labels(folder):
    rows = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    return {r["doc_id"]: r for r in rows}


def words_of(text):
    return text.encode().lower().split()


def by_id(frame, key="doc_id"):
    rows = frame.collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_language_model(spark, folder, texts):
    got = by_id(queries.op2_log_bilinear_model(spark, folder))
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words_of(t), "end"])
    total, kinds = sum(counts.values()), len(counts)
    for i, t in texts.items():
        own = [*words_of(t), "end"]
        base = sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        row = got[i]
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert (row["n_tokens"], row["train_tokens"]) == (len(own), total)
        assert row["n_known"] == sum(counts[w] > 0 for w in own)
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert len(got) == len(texts)
    tokens_ = sum(r["n_tokens"] for r in got.values())
    assert sum(r["score"] for r in got.values()) / tokens_ > (
        sum(r["base_score"] for r in got.values()) / tokens_
    )


def test_unit_probabilities_add_up_to_one():
    from boxline.llm import lblm

    unigram = np.full(lblm.UNITS + 1 + lblm.CLASSES, 1.0)
    model = lblm.Model.fresh(unigram / unigram.sum())
    size, start = len(unigram), len(unigram)
    total = 0.0
    for unit in range(size):
        t = lblm.Tokens(np.array([5, 7, unit]), np.zeros(3), np.zeros(3), np.array([0, 3]))
        total += np.exp(lblm.log_probabilities(model, t, start)[2])
    assert total == pytest.approx(1.0, abs=1e-5)


@pytest.mark.parametrize("rounds", [None, 1, 3])
def test_every_token_is_learned_from_once(spark, rounds):
    from boxline.llm import lblm

    docs = spark.createDataFrame([(f"w{i} a b c d e f g h i j k",) for i in range(40)] + [("one",), ("",)],
                                 "text string")
    known = lblm.vocabulary(lblm.word_counts(docs))
    times = spark.sparkContext.accumulator(0)
    learn = lblm.learn

    def counted(model, batches, *args, **named):
        after, seen = learn(model, batches, *args, **named)
        times.add(seen)
        return after, seen

    lblm.learn = counted
    try:
        lblm.train(docs, known, **({} if rounds is None else {"rounds": rounds}))
    finally:
        lblm.learn = learn
    assert times.value == known.tokens == 40 * 13 + 2 + 1


def test_units_grow_with_the_vocabulary(spark, monkeypatch):
    from boxline.llm import lblm

    assert lblm.frequent_words(10) == lblm.UNITS < lblm.frequent_words(1 << 20) < lblm.frequent_words(1 << 24)
    monkeypatch.setattr(lblm, "UNITS", 16)
    docs = spark.createDataFrame(
        [(" ".join(f"w{i}" for i in range(k, k + 100)),) for k in range(0, 90_000, 100)], "text string"
    )
    known = lblm.vocabulary(lblm.word_counts(docs))
    assert known.units[known.units < known.frequent].size == known.frequent > 300
    assert known.size == len(known.unigram) and known.class_words.sum() == 90_000 - known.frequent


def test_scoring_works_out_no_context_again(spark, monkeypatch):
    from boxline.llm import lblm

    docs = spark.createDataFrame(
        [(i, " ".join(f"w{(i * 7 + k * k) % 500}" for k in range(60))) for i in range(400)], "doc_id long, text string"
    ).coalesce(1)
    counts = pin(lblm.word_counts(docs))
    known = lblm.vocabulary(counts)
    times = spark.sparkContext.accumulator(0)

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def exp(self, x, *args, **named):
            times.add(int(np.size(x)))
            return np.exp(x, *args, **named)

    monkeypatch.setattr(lblm, "SCORE_BYTES", 200)
    monkeypatch.setattr(lblm, "np", Counted())
    scored = lblm.score(docs, counts, known, lblm.Model.fresh(known.unigram)).collect()
    assert len(scored) == 400
    # 400 blocks of some 60 contexts, each with a sum over all units, would be 18 million.
    assert times.value < 4 * known.size ** 2


@pytest.mark.parametrize(("scale", "pairs", "step"), [(1, 1 << 25, 512), (1, 3 * 61, 7), (60, 1 << 25, 16), (1, 0, 16)])
def test_normalisers_are_sums_over_all_units(monkeypatch, scale, pairs, step):
    from boxline.llm import lblm

    monkeypatch.setattr(lblm, "STEP", step)
    r, size = np.random.default_rng(3), 60
    model = lblm.Model.fresh(np.full(size, 1 / size))
    model.out, model.context, model.bias = (scale * x for x in (
        r.normal(0, 1, (size, lblm.SIZE)), r.normal(0, 1, (size + 1, lblm.SIZE)), r.normal(0, 1, size)
    ))
    norms = lblm.Normalisers(model, r.random(size), pairs)
    assert norms.table.shape == (min(size + 1, pairs // (size + 1)), size + 1)
    near, far = (x.ravel() for x in np.meshgrid(np.arange(size + 1), np.arange(size + 1)))
    z = (model.context[near] @ model.near + model.context[far] @ model.far) @ model.out.T + model.bias
    top = z.max(axis=1)
    assert norms.of(near, far) == pytest.approx(top + np.log(np.exp(z - top[:, None]).sum(axis=1)), rel=1e-5, abs=1e-4)
    if scale > 1:
        assert np.isnan(norms.table).any()


def test_training_steps_are_those_of_a_plain_loop():
    from boxline.llm import lblm

    r, size = np.random.default_rng(5), 40
    unigram = r.random(size) ** 3 + 1e-3
    unigram /= unigram.sum()
    model = lblm.Model.fresh(unigram)
    units, near, far = r.choice(size, 700, p=unigram), r.integers(0, size + 1, 700), r.integers(0, size + 1, 700)
    got, seen = lblm.learn(model, [(units[:300], near[:300], far[:300]), (units[300:], near[300:], far[300:])], unigram, 9)
    assert seen == 700

    parts, noise_of = [p.copy() for p in model.parts()], np.random.default_rng(9)
    sums = [np.full(p.shape, 1e-3) for p in parts]
    for low, high in ((0, 256), (256, 300), (300, 556), (556, 700)):
        out, context, first, second, bias = parts
        noise = np.searchsorted(np.cumsum(unigram), noise_of.random(lblm.NOISE) * np.cumsum(unigram)[-1])
        change = [np.zeros(p.shape) for p in parts]
        for i in range(low, high):
            q = context[near[i]] @ first + context[far[i]] @ second
            slope = np.zeros(lblm.SIZE)
            for k, w in enumerate([units[i], *noise]):
                odds = np.exp(q @ out[w] + bias[w] - np.log(lblm.NOISE * unigram[w]))
                g = (odds / (1 + odds) - (k == 0)) / (high - low)
                change[0][w] += g * q
                change[4][w] += g
                slope += g * out[w]
            change[1][near[i]] += first @ slope
            change[1][far[i]] += second @ slope
            change[2] += np.outer(context[near[i]], slope)
            change[3] += np.outer(context[far[i]], slope)
        for p, s, g in zip(parts, sums, change):
            s += g ** 2
            p -= lblm.RATE * g / np.sqrt(s)
    for mine, plain in zip(got.parts(), parts):
        assert mine == pytest.approx(plain, abs=1e-4)


def test_words_are_found_by_their_hash(spark):
    from boxline.llm import lblm

    docs = spark.createDataFrame([(f"often often w{i}",) for i in range(3000)] + [("w0 " * 5,)], "text string")
    known = lblm.vocabulary(lblm.word_counts(docs))
    absent = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    hashes = np.concatenate([known.words[::-1], absent])
    place = {w: i for i, w in enumerate(known.words.tolist())}
    at, hit = known.find(hashes)
    assert hit.tolist() == [w in place for w in hashes.tolist()]
    assert at[hit].tolist() == [place[w] for w in hashes.tolist() if w in place]


def test_rules(spark, folder, texts, labels):
    got = by_id(queries.op3_weak_supervision(spark, folder))
    right = 0
    for i, t in texts.items():
        own, seen, again = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(own[k:k + 3]) for k in range(len(own) - 2))
        covered = {
            k + j for k in range(len(own) - 2) if grams[tuple(own[k:k + 3])] > 1 for j in range(3)
        }
        row = got[i]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"],
                row["n_repeat_words"]) == (
            len(own), sum(map(len, own)), sum(t.count(c) for c in "#*$%&|<>"), again, len(covered))
        failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
        assert row["base_failed"] == failed and not (failed and row["kept"])
        if i in labels and not failed:
            right += row["kept"] == bool(labels[i]["quality"])
    judged = [i for i in labels if not got[i]["base_failed"]]
    assert right >= 0.95 * len(judged)


def test_estimate_finds_the_accuracies_of_planted_rules():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.8
    votes = np.zeros((4000, 6), np.int64)
    for k in range(6):
        # Rules vote against bad texts with different success and rarely against good ones.
        miss = 0.3 + 0.1 * k
        votes[~truth, k] = -1 * (r.random((~truth).sum()) > miss)
        votes[truth, k] = -1 * (r.random(truth.sum()) > 0.98)
    patterns, place, weight = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, odds = rules.estimate(patterns, weight.astype(float))
    assert share == pytest.approx(0.8, abs=0.05)
    assert ((rules.posterior(votes, share, odds) >= 0.5) == truth).mean() > 0.95


def test_decontamination(spark, folder, texts):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, folder).collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert whole and found >= whole

    def align(a, b):
        row, best = [0] * (len(b) + 1), 0
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            row, best = new, max(best, max(new))
        return best / (2 * len(a))

    split = re.compile(r"[^\s!-/:-@\[-`{-~]+")
    plain = {k: split.findall(t.lower()) for k, t in texts.items() if len(t) < 4000}
    wanted = {k: split.findall(t.lower()) for k, t in items.items()}
    scored = {
        (d, i) for d, t in plain.items() for i, x in wanted.items()
        if set(x) & set(t) and len(set(x) & set(t)) >= len(set(x)) / 3 and align(x, t) >= 0.5
    }
    assert {p for p in found if p[0] in plain} == scored


def test_edited_passages_are_found(spark):
    r = np.random.default_rng(5)
    item = [f"word{i}" for i in range(40)]
    edited = [w if r.random() > 0.15 else f"other{i}" for i, w in enumerate(item)]
    fill = [f"fill{i % 97}" for i in range(400)]
    docs = spark.createDataFrame(
        [(1, " ".join(fill + edited + fill)), (2, " ".join(fill)), (3, " ".join(fill + item[:6] + fill)),
         (4, " ".join(w.upper() + "," for w in item))], "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    rows = decontaminate.benchmark_matches(docs, items).collect()
    assert {r["doc_id"]: [m["item"] for m in r["matches"]] for r in rows} == {1: [7], 2: [], 3: [], 4: [7]}
    assert next(r for r in rows if r["doc_id"] == 1)["matches"][0]["start"] in range(398, 406)


def test_long_and_short_items(spark):
    rng = np.random.default_rng(12)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n))

    long, other = prose(500), prose(300)
    part = " ".join(long.split()[120:320])
    edited = " ".join(w if k % 9 else "changed" for k, w in enumerate(part.split()))
    brief = " ".join(long.split()[40:75])
    twice = " ".join(other.split()[:280])
    docs = spark.createDataFrame([
        (1, f"{prose(30)} {part} {prose(40)}"), (2, f"{prose(80)} {edited}"), (3, f"{prose(20)} {brief} {prose(9)}"),
        (4, prose(400)), (5, f"{prose(5)} {twice} {prose(700)} {twice}"), (6, "one\n\nTwo  words!\nmore lines here"),
        (7, "two words in a longer line"), (8, "Two\nwords"), (9, "42"),
    ], "doc_id long, text string")
    items = spark.createDataFrame(
        [("long", long), ("other", other), ("two", "two words"), ("same", "Two, words."), ("one", "42"), ("none", " ! ")],
        "item_id string, text string",
    )
    got = {}
    for r in decontaminate.benchmark_matches(docs, items).collect():
        got[r["doc_id"]] = {m["item"]: (m["score"], m["seeds"], m["start"], m["end"]) for m in r["matches"]}
    assert {k: set(v) for k, v in got.items()} == {
        1: {"long"}, 2: {"long"}, 3: set(), 4: set(), 5: {"other"}, 6: {"two", "same"}, 7: set(), 8: set(), 9: {"one"},
    }
    # A passage of 200 of 500 words has its own share of the item's score.
    assert got[1]["long"][0] == pytest.approx(0.4) and got[1]["long"][2:] == (30, 230)
    # Of two equal passages the first is given.
    assert got[5]["other"][2] == 5
    assert got[6]["two"] == (1.0, 0, 1, 3)


def test_pseudonyms_round_trip(spark, folder, texts):
    got = by_id(queries.op5_pseudonyms(spark, folder))
    back = pseudonyms.Pseudonyms(queries.PSEUDONYM_KEY, back=True)
    for i, t in texts.items():
        counts = dict.fromkeys(pseudonyms.KINDS, 0)
        assert back.replace(got[i]["text"], counts) == t
        assert sum(counts.values()) == got[i]["n_found"]
    assert sum(r["n_found"] for r in got.values()) > 0


@pytest.mark.parametrize("value", [
    "jane.doe12@mail.example.com", "+1 (743) 555-3824", "4111 1111 1111 1111", "4994226020900891",
    "233.233.171.252", "123-45-6789", "2024-02-29", "29/02/2024", "12/25/1999", "1.2.1987",
    "DE89 3704 0044 0532 0130 00", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
])
def test_formats(value):
    there, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", back=True)
    counts = dict.fromkeys(pseudonyms.KINDS, 0)
    new = there.replace(f"see {value}, and {value}", counts)
    assert sum(counts.values()) == 2 and value not in new
    shown, again = new[4:].split(", and ")
    assert shown == again
    assert back.replace(new, dict(counts)) == f"see {value}, and {value}"
    if value[:4] in ("4111", "4994"):
        assert pseudonyms.luhn(re.sub(r"\D", "", shown)) == 0


@pytest.mark.parametrize("value", [
    "4111 1111 1111 1112", "300.1.2.3", "2023-02-29", "000-12-3456", "1234567", "3.14", "v1.2.3", "v1.2.3.4", "a@b",
])
def test_invalid_values_stay(value):
    counts = dict.fromkeys(pseudonyms.KINDS, 0)
    assert pseudonyms.Pseudonyms(b"k").replace(f"see {value} now", counts) == f"see {value} now"


@pytest.mark.parametrize("text, hidden, kept", [
    ("pay 4111 1111 1111 1111 123 now", ["4111 1111 1111 1111"], " 123 now"),
    ("pay 4111 1111 1111 1111 12/26", ["4111 1111 1111 1111"], " 12/26"),
    ("4111111111111111 43.21.141.162", ["4111111111111111", "43.21.141.162"], ""),
    ("to BE68 5390 0754 7034 USD 5", ["5390 0754 7034"], " USD 5"),
    ("to BE68 5390 0754 7034 EURO", ["5390 0754 7034"], " EURO"),
    ("to BE68539007547034", ["539007547034"], ""),
    ("+1 (826) 555-4081 190.137.223.204", ["(826) 555-4081", "190.137.223.204"], ""),
    ("+1 555 123 4567 +44 20 7946 0958", ["555 123 4567", "20 7946 0958"], ""),
    ("4111 1111 1111 1111 555-123-4567", ["4111 1111 1111 1111", "555-123-4567"], ""),
])
def test_values_next_to_others_are_found(text, hidden, kept):
    for key in (b"a", b"b", b"c"):
        counts = dict.fromkeys(pseudonyms.KINDS, 0)
        new = pseudonyms.Pseudonyms(key).replace(text, counts)
        assert sum(counts.values()) == len(hidden)
        assert not any(h in new for h in hidden) and new.endswith(kept)
        assert pseudonyms.Pseudonyms(key, back=True).replace(new, dict(counts)) == text


def test_one_phone_number_has_one_pseudonym():
    there = pseudonyms.Pseudonyms(b"k")
    for written in (
        ["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "+1.555.123.4567"],
        ["+44 20 7946 0958", "+442079460958", "+44 (0) 20 7946 0958", "+44 (0)20 7946 0958"],
        ["+353 1 234 5678", "+35312345678"], ["555-123-4567", "555.123.4567", "(555) 123-4567"],
    ):
        digits = set()
        for w in written:
            new = there.replace(w, dict.fromkeys(pseudonyms.KINDS, 0))
            assert new != w
            digits.add(re.sub(r"\D", "", new.replace("(0)", "")))
        assert len(digits) == 1, written


@pytest.mark.parametrize("size", [15, 16, 17, 18, 19])
def test_cards_in_any_layout_go_back(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        start = "".join(map(str, rng.integers(0, 10, size - 1)))
        number = start + str(-pseudonyms.luhn(start + "0") % 10)
        cuts = sorted(set(rng.integers(1, size, 4).tolist()))
        text = "-".join(number[a:b] for a, b in zip([0, *cuts], [*cuts, size])).replace("-", " ")
        text = f"x {text} 77 y"
        counts = dict.fromkeys(pseudonyms.KINDS, 0)
        new = pseudonyms.Pseudonyms(b"k").replace(text, counts)
        assert pseudonyms.Pseudonyms(b"k", back=True).replace(new, dict(counts)) == text
        assert counts["card"] >= 1


def test_permutation_is_one_to_one():
    p = pseudonyms.Permutation(b"k")
    for size in (1, 2, 10, 97, 1000):
        assert sorted(p.apply(v, size, "x") for v in range(size)) == list(range(size))
        assert all(p.apply(p.apply(v, size, "x"), size, "x", back=True) == v for v in range(size))


def test_quality_on_held_out_labels(spark, labels):
    folder = "/root/testdata/sf0.01"
    got = by_id(queries.op6_quality_classifier(spark, folder))
    marks = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    for i, row in got.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert row["predicted"] == (row["score"] >= 0.3)
    held = [i for i in marks if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == marks[i] for i in held) >= 0.93 * len(held)


def test_token_files(spark, folder, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = by_id(queries.op7_token_files(spark, folder))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (
            start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_odd_words_are_encoded_as_by_the_tokenizer(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), tokens.Encoder(path)
    odd = [
        "It's we'll I'M don't", "İstanbul ŉ ǅ Straße", "été é", "a\x1cb c d e f", "½ ² 10,000.5",
        "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "日本語 and 🙂🙂", "__a_b__ c--d \"q\" ...", "́x Å",
    ]
    rng = np.random.default_rng(8)
    letters = list("abcsStTdl''\"\".,!-<|>é×÷ÀßIİſK½²3 \u00a0\u0301\u2026ö中🙂") + ["<|", "'s", "'re", "<|endoftext|>"]
    odd += ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    # All in one block, one at a time, and with so little memory that words are forgotten.
    for held in (tokens.REMEMBERED, 500):
        monkeypatch.setattr(tokens, "REMEMBERED", held)
        for part in (odd, *([t] for t in odd[:200]), odd[100:400]):
            block = next(W.blocks(pa.array([t.encode() for t in part], pa.binary())))
            for text, ids in zip(part, own.encode(block)):
                want = tokenizer.encode(text, add_special_tokens=False).ids
                assert np.frombuffer(ids, own.kind).tolist() == want, text


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, own = Tokenizer.from_file(path), tokens.Encoder(path)
    assert not own.by_words and tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")).by_words
    texts = ["Two  words\n", "", "It's  10,5 "]
    got = own.encode(next(W.blocks(pa.array([t.encode() for t in texts], pa.binary()))))
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, own.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_units_with_full_places(monkeypatch):
    monkeypatch.setattr(tokens.Units, "SLOTS", 8)
    units, rng = tokens.Units("<u2"), np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    lengths = rng.integers(0, 4, len(hashes))
    for low in range(0, len(hashes), 90):
        part = slice(low, low + 90)
        units.add(hashes[part], lengths[part], np.repeat(np.arange(len(hashes))[part], lengths[part]))
    numbers = units.find(hashes)
    assert numbers.tolist() == list(range(len(hashes)))
    assert units.find(hashes + np.uint64(1))[0] == -1
    ids, got = units.gather(numbers[::-1])
    assert got.tolist() == lengths[::-1].tolist()
    assert ids.tolist() == np.repeat(numbers[::-1], lengths[::-1]).tolist()


def test_one_document_is_read_alone():
    import zstandard

    arrays = [np.arange(n, dtype="<u2") for n in (3, 1, 700)]
    packed = [tokens.compressor(b"").compress(a.tobytes()) for a in arrays]
    shard = tokens.Shard(tokens.image(packed, [len(a) for a in arrays], b"", 2), b"")
    assert [shard.ids(i).tolist() for i in (2, 0, 1)] == [arrays[i].tolist() for i in (2, 0, 1)]
    with pytest.raises(ValueError):
        tokens.Shard(shard.data, b"another")
    assert zstandard


def test_shards(spark, folder, texts):
    frame = queries.op8_histogram_shards(spark, folder)
    kinds = dict(frame.dtypes)
    assert kinds == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
        "slot": "bigint", "grown_shard": "int",
    }
    rows = frame.collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    slots = collections.defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(40))
    held_together(rows, texts, 40)


def held_together(rows, texts, count):
    """Shards have near equal bytes, and groups of equal texts that fit the slack lie in one shard."""
    each = sum(r["size"] for r in rows) / count
    groups, sizes = collections.defaultdict(lambda: [set(), 0]), collections.Counter()
    for r in rows:
        groups[texts[r["doc_id"]]][0].add(r["shard"])
        groups[texts[r["doc_id"]]][1] += r["size"]
        sizes[r["shard"]] += r["size"]
    largest = max(r["size"] for r in rows)
    # Each end of a shard is off by half a row, or by the slack for groups.
    most = 2 * max(largest / 2 + shards.TOLERANCE * each, shards.GROUP_SLACK * each)
    assert all(abs(sizes[s] - each) <= most for s in range(count))
    small = [g for g, size in groups.values() if size <= 2 * shards.GROUP_SLACK * each - 2 * largest]
    assert all(len(g) == 1 for g in small)
    return [g for g, _ in groups.values()]


def test_groups_stay_in_one_shard(spark):
    r = np.random.default_rng(6)
    texts = {i: f"text {i} " + "x" * int(r.integers(20, 400)) for i in range(3_000)}
    texts |= {10_000 + i: f"copied {i // 8} " + "y" * 150 for i in range(800)}
    # A third of all bytes is one text, which has to be cut.
    texts |= {20_000 + i: "z" * 300 for i in range(1_500)}
    docs = pin(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(6))
    rows = shards.assign(docs, shards=12).collect()
    assert len(rows) == len(texts)
    cut = [g for g in held_together(rows, texts, 12) if len(g) > 1]
    assert len(cut) == 1 and len(cut[0]) >= 3


def test_splitters_meet_their_targets(spark):
    r = np.random.default_rng(3)
    # Half of all rows stand close together, as copies of one text do.
    values = np.concatenate([r.integers(-2**63, 2**63 - 1, 5000), 12345 * 2**24 + r.integers(0, 2**24, 5000)])
    sizes = r.integers(16, 5000, 10_000)
    keys = spark.createDataFrame(
        list(zip(values.tolist(), sizes.tolist())), "key long, size long"
    ).repartition(7)
    total = sizes.sum()
    targets = np.arange(1, 20) * total / 20
    found, below = shards.splitters(keys, targets, np.full(19, 0.002 * total))
    for s, b, t in zip(found, below, targets):
        assert (b[0], b[1]) == ((values < s).sum(), sizes[values < s].sum())
        assert abs(b[1] - t) <= 0.002 * total


def test_pages(spark, folder):
    got = by_id(queries.op9_main_text(spark, folder), "page_id")
    for page in pq.read_table(f"{folder}/pages.parquet").to_pylist():
        inside = re.search(r"<article>(.*)</article>", page["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", inside)]
        expected = "\n".join(b for b in blocks if b)
        row = got[page["page_id"]]
        assert (row["text"], row["n_chars"], row["url"]) == (expected, len(expected), page["url"])


def test_min_cut_against_all_labellings():
    from itertools import product

    from boxline.llm.extract import min_cut

    r = np.random.default_rng(2)
    for _ in range(40):
        n = 7
        odds = r.normal(0, 2, n)
        edges = [(i, j, float(r.random())) for i in range(n) for j in range(i) if r.random() < 0.5]

        def cost(labels, odds=odds, edges=edges):
            own = sum(abs(o) for o, x in zip(odds, labels) if (o > 0) != x)
            return own + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(cost(x) for x in product((False, True), repeat=7))
        assert cost(min_cut(odds.tolist(), edges)) == pytest.approx(best)


def test_pages_of_other_makes():
    from boxline.llm import extract

    body = "A long sentence, with commas and a full stop at its end. " * 4
    page = f"""<html><head><title>T</title></head><body><div id=cookie-notice><p>We use cookies, sorry.</p></div>
      <header><h1>Site name</h1></header><div class="sidebar"><ul><li><a href=x>One</a></ul></div>
      <main><header><h2>Head &amp; line</h2></header><p>{body}</p><form><label>Mail</label></form><p>Short.</p>
      <div class="advert">Buy now, cheap!</div><p>{body}</p>
      <section class="comments"><article><p>{body}</p></article></section></main>
      <footer>&copy; me</footer><script>if (a < b) "</p>"</script></body>"""
    clean = " ".join(body.split())
    expected = f"Head & line\n{clean}\nShort.\n{clean}"
    assert extract.main_text(page, extract.PRIOR) == expected


@pytest.mark.parametrize("around", [
    '<body class="has-sidebar single-post">{}</body>', "<body class='no-sidebar'>{}</body>",
    '<html class="no-js menu-open"><body class="comments-open">{}</body></html>',
    '<div class="sidebar-layout">{}</div>', '<div class="page-header-fixed">{}</div>',
    '<div class="with-ads"><div class="nav-wrapper">{}</div></div>',
])
@pytest.mark.parametrize("inner", [
    "<article>{}</article>", "<main class='header-offset'>{}</main>", '<div class="entry-content">{}</div>',
])
def test_names_of_wrappers_dont_mark_the_article(around, inner):
    from boxline.llm import extract

    body = " ".join(["A long sentence, with commas and a full stop at its end."] * 4)
    other = f'<section class="comments"><article><p>{body}</p></article></section>'
    page = around.format(
        f'{inner.format(f"<p>{body}</p>{other}<p>{body}</p>")}<div class="advert"><article>{body}</article></div>'
        f'<div class="related-posts"><article><p>{body}</p></article></div>'
        f'<div class="sidebar"><ul><li>{body}</ul></div><form><main>{body}</main></form>'
    )
    assert extract.main_text(page, extract.PRIOR) == f"{body}\n{body}"
    # Training takes the article's blocks as content.
    assert sum(b.parent.place > 0 for b in extract.page_blocks(page)) == 2


@pytest.mark.parametrize("tag", [
    "<video-js id=v></video-js>", "<audio-player src=a></audio-player>",
    "<select-menu>", "<style-guide></style-guide>", "<title-bar></title-bar>",
    "<svg class=x />", "<math/>", "<object data=x />", "<canvas/>",
    "<video src=x>", "<audio src=x>", "<svg><path d=x>",
    "<svg><title/><style/><path/></svg>", "<svg><title>t</title><text>gone</text></svg>",
    "<object><div>gone</div><video>gone</object>", "<script>if (a</b) '</p>'</script x>",
    "<object><object>gone</object>gone</object>", "<select><option>gone</select>",
])
def test_only_what_is_inside_players_and_scripts_is_dropped(tag):
    from boxline.llm import extract

    page = (f"<article><p>One {tag}two.</p><p>Three.</p></article><div><p>Four.</p>"
            "<video>gone</video><svg>gone</svg></div><p>Five.</p>")
    assert [b.text for b in extract.page_blocks(page)] == ["One two.", "Three.", "Four.", "Five."]
    # Scripts without an end reach to the end of the page.
    assert [b.text for b in extract.page_blocks(f"{page}<script>x<p>gone")][-1] == "Five."


def test_capitals_are_counted_over_the_whole_block():
    from boxline.llm import extract

    block, = extract.page_blocks(f"<pre>{'a' * 500}{'B' * 1500}</pre>")
    assert block.features[extract.FEATURES.index("capitals")] == 0.75


def test_jaccard(spark, folder, texts):
    got = by_id(queries.op10_jaccard_join(spark, folder))
    check_links(texts, got)


def check_links(texts, got):
    sets = {}
    for i, t in texts.items():
        own = words_of(t)
        sets[i] = frozenset(tuple(own[k:k + 5]) for k in range(max(1, len(own) - 4))) if own else frozenset()
    holders = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    links = {i: {j for j in set().union(*(holders[x] for x in s), set())
                 if j != i and 10 * len(s & sets[j]) >= 8 * len(s | sets[j])} for i, s in sets.items()}
    label = {}
    for i in sorted(sets):
        queue = [i] if i not in label else []
        while queue:
            j = queue.pop()
            if j not in label:
                label[j] = i
                queue += links[j]
    for i in sets:
        assert (got[i]["n_links"], got[i]["class_id"]) == (len(links[i]), label[i])


def test_jaccard_of_one_large_group(spark, monkeypatch):
    """A chain of near copies in small parts, so that every group goes through many units of work."""
    monkeypatch.setattr(jaccard, "GROUP_PART", 7)
    monkeypatch.setattr(jaccard, "BUCKET_PART", 5)
    r = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(60):
        own = list(base)
        for at in r.integers(0, 150, i % 6):
            own[at] = f"x{i}"
        texts[i] = " ".join(own)
    texts |= {100 + i: texts[3] for i in range(10)} | {200: "a few words"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_links(texts, by_id(jaccard.near_duplicates(docs)))
    kept = {r["doc_id"] for r in jaccard.one_per_group(docs).collect()}
    assert kept == {r["class_id"] for r in jaccard.near_duplicates(docs).collect()}


def test_mixing_meets_its_targets(spark):
    rows = queries.op1_soft_mixing(spark, "/root/testdata/sf0.01").collect()
    total = sum(r["n_tokens"] for r in rows)
    for name, share in queries.TARGETS.items():
        got = sum(r["rate"] * r["n_tokens"] * r[f"p_{name}"] for r in rows)
        assert got / total == pytest.approx(share, abs=1e-4)
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in rows)


@pytest.mark.parametrize("share", [0.0, 0.01, 0.1])
def test_mixing_loses_no_clean_document(spark, tmp_path, share):
    import corpus_pipeline
    from boxline.llm import mixing

    r, rows, marks = np.random.default_rng(5), [], []
    for i in range(1_500):
        toxic = i < 1_500 * share
        # Every sixth clean text has some words of toxic ones.
        odd = 0.9 if toxic else 0.3 if i % 6 == 0 else 0.02
        own = [f"{'bad' if r.random() < odd else 'good'}{r.integers(40)}" for _ in range(60)]
        rows.append((i, " ".join(own)))
        if i % 2:
            marks.append((i, 1, int(toxic)))
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect())
    domain = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    rated = mixing.mix(
        docs, spark.read.parquet(f"{tmp_path}/labels.parquet").select("doc_id", domain.alias("domain")),
        corpus_pipeline.TARGETS,
    ).collect()
    clean = {r["doc_id"] for r in rated if r["_posterior"][0] >= r["_posterior"][1]}
    assert len(clean) >= 1_500 * (1 - share) - 5
    assert all(got[i] >= 1 for i in clean)
    assert all(got[i] <= 1 for i in range(1_500) if i not in clean)
    left = sum(got[i] for i in range(1_500) if i not in clean)
    assert left == 1_500 - len(clean) if share <= 0.01 else left < 0.6 * (1_500 - len(clean))


def test_hashed_words_and_shapes():
    texts = [b"The the  THE\tend", b"", b"ab cd!", b"x" * 10]
    block = next(W.blocks(pa.array(texts, pa.binary())))
    found = W.words(block)
    assert np.diff(found.offsets).tolist() == [4, 0, 2, 1]
    assert len(set(found.of(0)[:3].tolist())) == 1
    again = next(W.blocks(pa.array([b"zz the"], pa.binary())))
    assert W.words(again).of(0)[1] == found.of(0)[0]
    assert W.shingles(found.of(0)).size == 1 and W.shingles(found.of(1)).size == 0
