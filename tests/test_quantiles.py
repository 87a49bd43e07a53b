"""Exact quantiles by passes equal sorting, whatever the sketch and the bound on a task's values."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(6)
    made = [("big", r.gauss(0, 1)) for _ in range(6000)] + [("ties", float(r.choice((1, 1, 1, 2, 5)))) for _ in range(3000)]
    made += [("small", 3.0), ("pair", 1.0), ("pair", 2.0), ("none", None), (None, 7.0), (None, None), (None, 9.0), ("one value", 4.0)] + [("flat", 2.5)] * 500
    return spark.createDataFrame(made, "g string, v double")


@pytest.mark.parametrize("most", [100_000, 200, 1])
def test_quantiles_equal_sorting(spark, rows, most):
    p = (0.0, 0.1, 0.5, 0.99, 1.0)
    got = {r.g: r for r in quantiles(rows, ["g"], {"a": F.col("v"), "b": -F.col("v")}, p, most).collect()}
    groups = {}
    for r in rows.collect():
        if r.v is not None:
            groups.setdefault(r.g, []).append(r.v)
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose(got[g].a, np.quantile(v, p), rtol=1e-12) and np.allclose(got[g].b, np.quantile(np.negative(v), p), rtol=1e-12)


def test_median_equals_the_built_in_one(spark, rows):
    want = {r.g: r.m for r in rows.groupBy("g").agg(F.median("v").alias("m")).collect() if r.m is not None}
    assert {r.g: r.m[0] for r in quantiles(rows, ["g"], {"m": F.col("v")}, most=50).collect()} == want
    whole = quantiles(rows, [], {"m": F.col("v")}, most=50).first()
    assert whole.m[0] == rows.agg(F.median("v")).first()[0]
    assert quantiles(rows.where("false"), ["g"], {"m": F.col("v")}).count() == 0


def test_a_task_holds_few_values(spark, rows):
    # the list that a task reads ranks off is as long as the bound says
    plan = quantiles(rows, ["g"], {"m": F.col("v")}, most=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan
    from lectern.operators import quantiles as q

    seen, original = [], q._inside

    def watched(flat, state, at, *more):
        out = original(flat, state, at, *more)
        seen.append(out)
        return out

    q._inside = watched
    try:
        quantiles(rows, ["g"], {"m": F.col("v")}, most=50).collect()
    finally:
        q._inside = original
    assert seen[-1].groupBy("g", "what", "k", "side").count().agg(F.max("count")).first()[0] <= 50
