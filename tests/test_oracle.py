"""Every query of the library with SQL equals that SQL, run by another engine on the same tables."""

from __future__ import annotations

import math

import pytest

from lectern import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return repr(round(float(x), 9)) if isinstance(x, float) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, key):
    got = registry.queries()[key](spark, SF)
    want = con.sql(registry.oracle_sql()[key])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_all_queries_are_registered_through_the_entry():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(registry.oracle_sql()) <= set(entry.oracle_sql())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
