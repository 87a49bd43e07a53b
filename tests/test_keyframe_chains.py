"""Containment of key frames where the shift is just at its limit, against the queries' SQL."""

from __future__ import annotations

import datetime

import pytest
from test_oracle import rows

from lectern import registry

LOW = 28.02  # 100 more, in floats, is not quite 100 away; of the two inks it is


@pytest.fixture(scope="module")
def at_limit(tmp_path_factory, spark):
    folder = tmp_path_factory.mktemp("limit")
    begin = datetime.datetime(2024, 1, 1)
    values = [LOW + 100, LOW, LOW + 100, 400.0]
    events = [(k, begin + datetime.timedelta(hours=3 * k), 7, "view", v, "{}") for k, v in enumerate(values)]
    # two rows of one time: their order is that of their places
    events += [(10 + k, begin + datetime.timedelta(hours=k // 2), 8, "view", v, "{}") for k, v in enumerate([20.0, 20.0, 20.5, 20.5, 90.0, 20.5])]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_the_limit_is_one():
    assert abs(LOW + 100 - LOW) > 100 and abs((100 + (LOW + 100)) - (100 + LOW)) == 100


@pytest.mark.parametrize("key", ["win_contained_last", "seq_keyframe_chain", "seq_ablation_grid"])
def test_shift_at_its_limit(spark, at_limit, key):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at_limit}/events.parquet/*.parquet'")
    got, want = registry.queries()[key](spark, at_limit), con.sql(registry.oracle_sql()[key])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
