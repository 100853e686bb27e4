"""Every registered query runs; those with a SQL twin give the same table.

Queries of the corpus operators are tested with their operators.
"""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(clean, key=lambda t: tuple((v is None, isinstance(v, str), v if isinstance(v, str) else v or 0) for v in t))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    got = table([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = table(cur.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9) if all(isinstance(v, (int, float)) for v in a) else all(
            x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-9, abs=1e-9)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    assert rows and len(df.columns) == len(set(df.columns))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "survival" in df.columns
