"""Every query: the same rows as its SQL in DuckDB, at the smallest scale; those without SQL give rows."""

import math

import duckdb
import pytest

from loomlight import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf, con, name):
    df = plans.queries()[name](spark, sf)
    rows, columns = df.collect(), sorted(df.columns)
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows and len(set(columns)) == len(columns)
        return
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == want


def test_every_sql_has_its_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert 0 < df.count() <= 10 and "rrf" in df.columns  # vectors without a document drop out
    assert set(plans.queries()) <= set(__spark_entry__.queries())
