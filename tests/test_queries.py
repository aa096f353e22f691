"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from hostmill.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def compare(spark, data, query, sql):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = query(spark, data)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    compare(spark, data, queries.queries()[name], oracle.oracle_sql()[name])


def test_entry(spark, monkeypatch):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
