"""Batches are the same whatever the partitioning; gradients equal differences; training equals one machine's and goes on where it was killed."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import training as R
from lectern.plans.training_queries import pictures

SF = "/root/testdata/sf0.001"


def test_batches_do_not_depend_on_partitions(spark):
    rows = pictures(spark, SF)
    read = lambda df: sorted((r.vec_id, r.place, r.batch, r.flip, tuple(r.box), tuple(r.pixels)) for r in R.augmented(R.shuffled(df, "vec_id", 5, 1, 7), 8).collect())
    once = read(rows)
    assert once == read(rows.repartition(13)) and sorted(r[1] for r in once) == list(range(len(once)))
    assert all(r[2] == r[1] // 7 for r in once)
    other = {r.vec_id: r.place for r in R.shuffled(rows, "vec_id", 5, 2, 7).collect()}
    assert [other[r[0]] for r in once] != [r[1] for r in once]
    assert 0.3 < sum(r[3] for r in once) / len(once) < 0.7


def test_boxes_move_with_pixels(spark):
    rows = pictures(spark, SF).limit(40).select("vec_id", "box", R.flipped_pixels(F.col("pixels"), 8).alias("pixels"), R.flipped_box(F.col("box")).alias("moved"))
    for r in rows.collect():
        grid = np.array(r.pixels).reshape(8, 8)
        ys, xs = np.nonzero(grid >= 0.9 * grid.max())
        assert r.moved == [xs.min() / 8, ys.min() / 8, (xs.max() + 1 - xs.min()) / 8, (ys.max() + 1 - ys.min()) / 8]
    assert spark.range(1).select(R.flipped_pixels(F.array().cast("array<double>"), 8).alias("p")).first().p == []


def _plain_loss(raw, truth):
    """The loss of one row by its definition."""

    def inside(b):
        x1, y1 = min(max(b[0], 0), 1), min(max(b[1], 0), 1)
        return x1, y1, max(min(max(b[0] + b[2], 0), 1), x1 + 1e-5), max(min(max(b[1] + b[3], 0), 1), y1 + 1e-5)

    p, t = inside(raw), inside(truth)
    flat = lambda c: (c[0], c[1], c[2] - c[0], c[3] - c[1])
    huber = 0.0
    for a, b in zip(flat(p), flat(t), strict=True):
        d = abs(a - b)
        huber += (d * d / 2 if d <= 0.05 else 0.05 * (d - 0.025)) / 4
    inter = max(0, min(p[2], t[2]) - max(p[0], t[0])) * max(0, min(p[3], t[3]) - max(p[1], t[1]))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return huber + 2 * (1 - inter / (area(p) + area(t) - inter + 1e-7))


def _plain_total(shape, w, xs, ts):
    n = shape.features
    out = 0.0
    for x, t in zip(xs, ts, strict=True):
        if shape.hidden:
            a, b = w[: (n + 1) * shape.hidden].reshape(n + 1, shape.hidden), w[(n + 1) * shape.hidden :].reshape(shape.hidden + 1, 4)
            x = np.maximum(np.append(x, 1) @ a, 0)
        else:
            b = w.reshape(n + 1, 4)
        out += _plain_loss(1 / (1 + np.exp(-(np.append(x, 1) @ b))), t)
    return out


@pytest.mark.parametrize("hidden", [0, 5])
def test_gradient_equals_differences(hidden):
    r = np.random.default_rng(3)
    shape = R.Shape(6, hidden)
    x, t, w = r.normal(size=(9, 6)), r.uniform(0.05, 0.5, size=(9, 4)), shape.start(1) + 0.05 * r.normal(size=shape.size)
    g, loss, _ = R.gradient(shape, w, x, t)
    assert loss == pytest.approx(_plain_total(shape, w, x, t), rel=1e-12)
    for k in range(shape.size):
        d = np.zeros(shape.size)
        d[k] = 1e-6
        assert g[k] == pytest.approx((_plain_total(shape, w + d, x, t) - _plain_total(shape, w - d, x, t)) / 2e-6, abs=2e-5)


FIELDS = "key long, features array<double>, box array<double>, held boolean"


def _rows(n=60):
    r = random.Random(4)
    rows = []
    for k in range(n):
        f = [r.gauss(0, 1) for _ in range(3)]
        s = [1 / (1 + math.exp(-v)) for v in f]
        rows.append((k, f, [s[0] / 2, s[1] / 2, 0.2 + s[2] / 4, 0.3], k % 4 == 0))
    return rows


def test_training_equals_one_machine_and_resumes(spark, tmp_path):
    data = _rows()
    odd = [(100, None, [0.1] * 4, False), (101, [1.0, 2.0, None], [0.1] * 4, False), (102, [1.0, 2.0], [0.1] * 4, True), (103, [1.0, 2.0, float("nan")], [0.1] * 4, False), (104, [1.0, 2.0, 3.0], None, False)]
    df = spark.createDataFrame(data + odd, FIELDS)
    shape = R.Shape(3)
    whole = R.fit(df.repartition(5), shape, f"{tmp_path}/a", 9, 0.05).orderBy("epoch").collect()
    R.fit(df.coalesce(1), shape, f"{tmp_path}/b", 4, 0.05)
    (tmp_path / "b" / "epoch-000004").mkdir()  # an epoch that was broken off
    parts = R.fit(df.coalesce(1), shape, f"{tmp_path}/b", 9, 0.05).orderBy("epoch").collect()
    assert [r.epoch for r in parts] == list(range(9))
    # the same on one machine: Adam on the mean gradient
    xs, ts, held = (np.array(c) for c in list(zip(*data, strict=True))[1:])
    w, m, v = shape.start(42), 0.0, 0.0
    for k, (one, two) in enumerate(zip(whole, parts, strict=True)):
        assert np.allclose(one.weights, w, atol=1e-9) and np.allclose(two.weights, w, atol=1e-9)
        assert one.loss == pytest.approx(_plain_total(shape, w, xs[~held], ts[~held]) / (~held).sum()) and one.val_loss == pytest.approx(_plain_total(shape, w, xs[held], ts[held]) / held.sum())
        g = np.array(R.gradient(shape, w, xs[~held], ts[~held])[0]) / (~held).sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - one.next_rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.999 ** (k + 1))) + 1e-7)
    assert whole[-1].val_loss < whole[0].val_loss
    found = R.predict(df.select("key", "features"), shape, R.best_weights(R.states(spark, f"{tmp_path}/a"))).collect()
    assert {r.key for r in found} == {k for k, *_ in data} | {104}
    assert all(0 <= r.x and r.x + r.w <= 1 + 1e-9 and 0 <= r.y and r.y + r.h <= 1 + 1e-9 for r in found)


def test_plateau_and_stop(spark, tmp_path):
    df = spark.createDataFrame(_rows(12), FIELDS)
    found = R.fit(df, R.Shape(3), f"{tmp_path}/s", 30, 0.0).orderBy("epoch").collect()
    assert len(found) == 11 and found[-1].stopped and not found[-2].stopped
    moving = R.fit(df, R.Shape(3), f"{tmp_path}/t", 6, 1e-9).orderBy("epoch").collect()
    assert [r.rate for r in moving] == [1e-9] * 6  # below the least rate it stays
    slow = R.fit(df, R.Shape(3), f"{tmp_path}/u", 7, 4e-6).orderBy("epoch").collect()
    assert [r.rate for r in slow] == [4e-6] * 5 + [2e-6] * 2


def test_nothing_to_train_on_and_too_large_a_model(spark, tmp_path):
    with pytest.raises(ValueError, match="no row"):
        R.fit(spark.createDataFrame([], FIELDS), R.Shape(3), f"{tmp_path}/e", 2)
    with pytest.raises(ValueError, match="at most"):
        R.fit(spark.createDataFrame([], FIELDS), R.Shape(3_000_000), f"{tmp_path}/e", 2)
    assert R.states(spark, f"{tmp_path}/none") is None
    alone = R.fit(spark.createDataFrame(_rows(8), FIELDS).withColumn("held", F.lit(None).cast("boolean")), R.Shape(3), f"{tmp_path}/v", 2).collect()
    assert all(r.loss == r.val_loss for r in alone)
