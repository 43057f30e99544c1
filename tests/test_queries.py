"""Every query against its SQL on the smallest tables, as far as both are there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_like_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(names) and got
    order = sorted(names)
    assert sorted((tuple(r[c] for c in order) for r in got), key=repr) == sorted((tuple(r[names.index(c)] for c in order) for r in want), key=repr)


@pytest.mark.parametrize("name", ["markdown_chunks", "ask_questions"])
def test_has_rows(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
