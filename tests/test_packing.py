"""Greedy packing against a loop, with slices and chains forced small."""

import random

import pytest

from boxline.operators import packing as K
from boxline.plans.catalog import load


def _limit(widths, heights, strategy):
    mw, xw, mh = sum(widths) / len(widths), max(widths), sum(heights) / len(heights)
    if strategy == "conservative":
        wanted = int(mw * 2.5)
    elif strategy == "balanced":
        wanted = int(mw * 3 + (xw - mw) * 0.5)
    elif strategy == "aggressive":
        wanted = int(xw * 6)
    else:
        density = mw / (mh * 20)
        wanted = int(mw * (8 if density < 1 else 5 if density < 2 else 3))
        if mh < 20:
            wanted = int(wanted * 1.5)
        elif mh > 60:
            wanted = int(wanted * 0.8)
    return max(int(xw + 100), min(wanted, 8192))


def _packs(lines, limit):
    packs, width, members, heights = [], 0, 0, 0
    pack = -1
    for w, h in lines:
        needed = w + (20 if members else 0)
        fits = (members > 0 and width + needed <= limit and members < 20
                and abs(h - heights / members) / (heights / members) < 1.0)
        if fits:
            width, members, heights = width + needed, members + 1, heights + h
        else:
            pack, width, members, heights = pack + 1, w, 1, h
        packs.append(pack)
    return packs


def _images(seed, counts):
    rng = random.Random(seed)
    return {
        image: [(rng.randint(5, 400), rng.choice([12, 14, 16, 40, 48])) for _ in range(n)]
        for image, n in enumerate(counts)
    }


@pytest.mark.parametrize("strategy,size,fan", [
    ("conservative", 1_000, 1_000), ("balanced", 20, 2), ("aggressive", 20, 3),
    ("adaptive", 1_000, 1_000), ("adaptive", 20, 2),
])
def test_pack_lines(spark, monkeypatch, strategy, size, fan):
    monkeypatch.setattr(K, "FAN", fan)
    images = _images(7, [1, 3, 19, 20, 21, 60, 175])
    rows = [
        (image, i, w, h, int(w * 48 / h))
        for image, lines in images.items() for i, (w, h) in enumerate(lines)
    ]
    frame = spark.createDataFrame(
        rows, "image_id long, line_no int, effective_width int, char_height int, scaled_width int"
    )
    got = {}
    for r in K.pack_lines(frame, strategy=strategy, size=size).collect():
        got.setdefault(r.image_id, {})[r.line_no] = (r.pack, r.pack_limit)
    for image, lines in images.items():
        limit = _limit([w for w, _ in lines], [h for _, h in lines], strategy)
        expected = _packs([(int(w * 48 / h), h) for w, h in lines], limit)
        assert [got[image][i][0] for i in range(len(lines))] == expected
        assert {v[1] for v in got[image].values()} == {limit}


def test_narrow_lines_fill_packs_of_twenty(spark):
    frame = spark.createDataFrame(
        [(1, i, 700, 48, 5) for i in range(45)],
        "image_id long, line_no int, effective_width int, char_height int, scaled_width int",
    )
    got = K.pack_efficiency(K.pack_lines(frame, strategy="aggressive"), ["image_id"]).first()
    assert (got.lines, got.calls) == (45, 3)


def test_strategy_sweep_has_mean_times(spark, tmp_path):
    """Each strategy over whole documents, with the mean of 10 ms a call plus 1 ms a line."""
    rng = random.Random(3)
    lengths = [[rng.randint(0, 190) for _ in range(n)] for n in (1, 2, 7, 25, 60)]
    spark.createDataFrame(
        [(i, "\n".join("x" * n for n in doc)) for i, doc in enumerate(lengths)],
        "doc_id long, text string",
    ).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.strategy: r for r in load()[0]["strategy_sweep"](spark, str(tmp_path)).collect()}
    best = max(r.avg_efficiency for r in got.values())
    for strategy in ("conservative", "balanced", "aggressive", "adaptive"):
        calls = []
        for doc in lengths:
            wide, high = [n * 2 + 20 for n in doc], [14 + n % 60 for n in doc]
            scaled = [(int(w * (48.0 / h)), h) for w, h in zip(wide, high)]
            calls.append(_packs(scaled, _limit(wide, high, strategy))[-1] + 1)
        r, lines = got[strategy], [len(doc) for doc in lengths]
        assert (r.total_lines, r.total_calls) == (sum(lines), sum(calls))
        assert r.avg_time_ms == pytest.approx((10 * sum(calls) + sum(lines)) / 5, abs=1e-6)
        mean = sum(n / c for n, c in zip(lines, calls)) / 5
        assert r.avg_efficiency == pytest.approx(mean, abs=1e-6)
        assert r.is_best == (r.avg_efficiency == best)


def test_strategies_share_the_best_efficiency(spark):
    runs = spark.createDataFrame(
        [("a", 4, 2), ("b", 6, 3), ("c", 4, 4)], "strategy string, lines int, calls int"
    )
    got = {r.strategy: r.is_best for r in K.best_strategy(runs).collect()}
    assert got == {"a": True, "b": True, "c": False}


def test_batch_layout(spark):
    frame = spark.createDataFrame([(1, i, 10 + i) for i in range(5)], "image_id long, id int, width int")
    batched = K.micro_batches(frame, ["image_id"], ["id"], size=3)
    got = {r.id: (r.batch, r.batch_x, r.batch_width) for r in K.batch_layout(batched, ["image_id"]).collect()}
    assert got == {0: (0, 0, 43), 1: (0, 15, 43), 2: (0, 31, 43), 3: (1, 0, 32), 4: (1, 18, 32)}
