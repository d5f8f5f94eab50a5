"""Hot-group paths must give what the plain paths give."""

import random

from pyspark.sql import functions as F

from boxline.operators import ordered as O
from boxline.operators.hot import hot_keys, lookup_join
from boxline.testing import canonical

KEYS = ["k"]


def _rows(seed=1, n=400):
    rng = random.Random(seed)
    # One key holds most rows, one is null, the rest are small.
    return [
        (rng.choice([1, 1, 1, 1, 2, 3, None]), rng.randint(0, 20), i, rng.randint(-5, 5))
        for i in range(n)
    ]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k int, v int, id int, w int").repartition(3)


def _collect(df, columns):
    return canonical([tuple(r) for r in df.select(*columns).collect()])


def _expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    out = []
    for key, members in groups.items():
        members.sort(key=lambda r: (r[1], r[2]))
        total, before = 0, None
        for place, (k, v, i, w) in enumerate(members, 1):
            total += w
            out.append((k, i, place, total, before))
            before = w
    return canonical(out)


def _scan(df, **options):
    groups = O.OrderedGroups(df, KEYS, ["v", "id"], **options).row_number("place")
    groups = groups.running_sum(F.col("w"), "total").previous({"before": F.col("w")})
    return groups.frame()


def test_scan_plain_and_hot_match_a_loop(spark):
    rows = _rows()
    expected = _expected(rows)
    columns = ["k", "id", "place", "total", "before"]
    assert _collect(_scan(_frame(spark, rows)), columns) == expected
    assert _collect(_scan(_frame(spark, rows), limit=20), columns) == expected


def test_hot_groups_are_cut(spark):
    groups = O.OrderedGroups(_frame(spark, _rows()), KEYS, ["v", "id"], limit=20)
    sizes = groups.rows.groupBy("k", "_slice").count().where("_slice >= 0").collect()
    assert len([r for r in sizes if r.k == 1]) > 3
    assert max(r["count"] for r in sizes) < 120


def test_descending_order(spark):
    rows = _rows(3)
    order = [F.col("v").desc(), F.col("id")]
    plain = O.ranked(_frame(spark, rows), KEYS, order, "r")
    hot = O.ranked(_frame(spark, rows), KEYS, order, "r", limit=15)
    assert _collect(plain, ["id", "r"]) == _collect(hot, ["id", "r"])


def test_no_hot_keys(spark):
    assert hot_keys(_frame(spark, _rows()), KEYS, limit=1_000) is None


def test_lookup_join_hot_matches_plain(spark):
    big = _frame(spark, _rows())
    small = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "k int, name string")
    for how in ("inner", "left"):
        plain = lookup_join(big, small, KEYS, how)
        hot = lookup_join(big, small, KEYS, how, limit=10)
        assert plain.columns == hot.columns
        assert _collect(plain, plain.columns) == _collect(hot, plain.columns)


def test_first_rows_prunes_before_the_shuffle(spark):
    found = O.first_rows(_frame(spark, _rows()), KEYS, ["v", "id"], 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert found.groupBy("k").count().agg(F.max("count")).first()[0] == 3


def test_slices_hold_their_neighbours(spark):
    df = spark.range(25).select(F.col("id").alias("y"))
    cut = O.slice_rows(df, "y", 10, before=2, after=3)
    got = {}
    for r in cut.collect():
        got.setdefault(r._slice, []).append((r.y, r._own))
    assert sorted(y for y, own in got[1] if not own) == [8, 9, 20, 21, 22]
    assert sorted(y for y, own in got[1] if own) == list(range(10, 20))


def test_group_totals(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(23)] + [(2, 0, 5)], "g int, y int, v int")
    got = O.with_group_totals(O.slice_rows(df, "y", 5), ["g"], {"t": F.sum("v")})
    assert got.count() == 24
    assert {(r.g, r.t) for r in got.collect()} == {(1, sum(range(23))), (2, 5)}
