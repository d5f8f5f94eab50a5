"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for all operators."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxline.llm import (
    decontaminate, extract, jaccard, lblm, mixing, pseudonyms, quality, rules, shards, tokens,
)
from boxline.session import pin, shared_path

LONG = " ".join(f"w{i}" for i in range(30_000))
TEXT = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf tonight"
ROWS = [
    (1, TEXT), (2, TEXT), (2, TEXT), (3, None), (4, ""), (5, " \n\t "), (None, TEXT), (None, None),
    (6, LONG), (7, "one"), (8, "é ß\x1c日本 🙂 mixed"), (9, TEXT.upper()),
]
# Names that operators use for what they add.
CLASH = ["score", "size", "shard", "slot", "matches", "_tokens", "_rate", "n_email", "a", "b", "label"]


def table(spark, rows, schema="doc_id bigint, text string"):
    docs = spark.createDataFrame(rows, schema)
    for name in CLASH:
        docs = docs.withColumn(name, F.lit("kept"))
    return pin(docs)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, 0, 0), (6, 0, 1), (7, 0, 1), (None, 1, 0), (3, None, None), (99, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )


def by_id(rows, *names):
    return sorted(((r["doc_id"], *(r[n] for n in names)) for r in rows), key=repr)


def test_quality(docs, none, labels):
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    # Texts without words get one score, equal texts too.
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert len({r["score"] for r in rows if r["text"] == TEXT}) == 1
    assert quality.score(none, model).count() == 0
    assert quality.train(none, labels).probability(0.0) == pytest.approx(1.0)


def test_jaccard(docs, none):
    rows = jaccard.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    found = by_id(rows, "class_id", "n_links")
    same = [r for r in found if r[2] == 4]
    # Five rows of one text up to case: ids 1, 2, 2, null and 9.
    assert [r[0] for r in same].count(2) == 2 and len(same) == 5 and {r[1] for r in same} == {1}
    assert [r for r in found if r[0] in (3, 4, 5)] == [(3, 3, 0), (4, 4, 0), (5, 5, 0)]
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.one_per_group(docs).collect()
    assert {r["doc_id"] for r in kept if r["text"] and r["text"].lower() == TEXT} == {1}
    assert all(r["size"] == "kept" for r in kept)
    assert jaccard.one_per_group(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(1, TEXT), (1, TEXT), (None, TEXT), (2, None), (3, ""), (4, "two words"), (5, LONG[:2000])],
        "item_id bigint, text string",
    )
    rows = decontaminate.benchmark_matches(docs, items).collect()
    assert len(rows) == len(ROWS)
    found = {(r["doc_id"], m["item"], round(m["score"], 6)) for r in rows for m in r["matches"]}
    assert found == {
        (d, i, 1.0) for d in (1, 2, None, 9) for i in (1, None)
    } | {(6, 5, 1.0)}
    assert decontaminate.benchmark_matches(none, items).count() == 0
    assert decontaminate.benchmark_matches(docs, items.limit(0)).where("size(matches) > 0").count() == 0
    # Any cut of the items into blocks gives the same matches.
    small = decontaminate.benchmark_matches(docs, items, item_bytes=60).collect()
    assert found == {(r["doc_id"], m["item"], round(m["score"], 6)) for r in small for m in r["matches"]}


def test_mixing(docs, none, labels):
    marks = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("domain"))
    rows = mixing.mix(docs, marks, {"clean": 0.5, "toxic": 0.5}).collect()
    assert len(rows) == len(ROWS) and all(r["_rate"] >= 0 and r["_copies"] >= 0 for r in rows)
    assert all(r["_tokens"] == 0 for r in rows if not (r["text"] or "").strip())
    assert len({r["_rate"] for r in rows if r["text"] == TEXT}) == 1
    assert mixing.mix(none, marks, {"clean": 0.5, "toxic": 0.5}).count() == 0


def test_shards(docs, none):
    rows = shards.assign(docs, shards=4).collect()
    assert len(rows) == len(ROWS)
    for shard in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in rows)
    assert all(r["matches"] == "kept" for r in rows)
    assert shards.assign(none, with_text=False).count() == 0


def test_language_model(docs, none):
    rows = lblm.language_model_scores(docs).collect()
    assert len(rows) == len(ROWS)
    ends = [r for r in rows if r["n_tokens"] == 1]
    assert len(ends) == 4 and len({round(r["score"], 5) for r in ends}) == 1
    assert all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in rows)
    assert lblm.language_model_scores(none).count() == 0


def test_rules(docs, none):
    rows = rules.judge(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    assert sum(r["n_words"] == 0 for r in rows) == 4
    assert rules.judge(none).count() == 0


def test_pseudonyms(docs, none):
    rows = pseudonyms.pseudonymise(docs, b"k").collect()
    assert sorted((r["text"] for r in rows), key=repr) == sorted((t for _, t in ROWS), key=repr)
    assert all(r["n_email"] == 0 and r["size"] == "kept" for r in rows)
    assert pseudonyms.pseudonymise(none, b"k").count() == 0


def test_tokens(spark, docs, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    for frame, size in ((docs, len(ROWS)), (none, 0)):
        place = shared_path(spark, "tokens")
        tokens.write_tokens(frame, place, path)
        rows = tokens.document_digests(spark, place, "bigint").orderBy("start").collect()
        assert len(rows) == size
        starts = [0]
        for r in rows:
            assert r["start"] == starts[-1]
            starts.append(r["start"] + r["n_tokens"])
        ids = [r["doc"] for r in rows]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
        assert sum(r["n_tokens"] == 1 for r in rows) == (4 if size else 0)


def test_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "plain &amp; simple"), (3, "u", "<p>a<b>"),
            (4, "u", "<article>" + "<p>Long text, it is. " * 5_000), (5, "u", "<div><!-- <script>x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = pages.withColumn("text", F.lit("other")).withColumn("n_chars", F.lit("other"))
    weights = extract.train(pages)
    got = extract.extract_text(pages, weights).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(r["text"] == "" for r in got if r["page_id"] in (None, 1, 5))
    assert next(r for r in got if r["page_id"] == 4)["text"].count("\n") == 4_999
    assert extract.extract_text(pages.limit(0), weights).count() == 0


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, TEXT)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(
        [(1, 1, 0), (6, 1, 0), (7, 1, 1)], "doc_id bigint, quality int, toxic int"
    ).write.parquet(f"{folder}/labels.parquet")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, None, "s", 1) for i, t in ROWS]
    for name, part in (("some", rows), ("none", [])):
        place = f"{folder}/{name}"
        for other in ("benchmark", "labels"):
            spark.read.parquet(f"{folder}/{other}.parquet").write.parquet(f"{place}/{other}.parquet")
        spark.createDataFrame(part, schema).write.parquet(f"{place}/documents.parquet")
        out = corpus_pipeline.run(spark, place)
        assert set(schema.replace(",", "").split()[::2]) <= set(out.columns)
        got = out.collect()
        assert TEXT not in {(r["text"] or "").lower() for r in got}
        assert bool(got) == (name == "some")
        assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in got)
