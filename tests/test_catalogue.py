"""Every query runs, matches DuckDB, and reads the given tables."""

import inspect

import duckdb
import pytest

import __spark_entry__ as entry
from boxline.plans.catalog import load
from boxline.testing import canonical

QUERIES, SQL = load()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, folder, con, name):
    frame = QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    rows = canonical([tuple(r) for r in frame.select(*columns).collect()])
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert rows == canonical([tuple(r[i] for i in order) for r in result.fetchall()])


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_queries_take_session_and_folder():
    assert all(len(inspect.signature(q).parameters) == 2 for q in entry.queries().values())
