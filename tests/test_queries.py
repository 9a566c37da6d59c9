"""Every query that has SQL against it, on the smallest tables; and the rest, that it runs."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables aren't there")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return db


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert found
    if name in entry.oracle_sql():
        rel = duck.sql(entry.oracle_sql()[name])
        assert sorted(rel.columns) == columns
        place = [rel.columns.index(c) for c in columns]
        assert found == sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
