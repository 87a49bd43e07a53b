"""Box regressors: seeded batches of pictures with their boxes, and training by gradients that are summed over partitions.

A dataset is rows (key, pixels, box): a gray picture as an array of doubles from 0 to 1, row by row, and a box (x, y, w, h) as
shares of the picture. Order, batches and augmentation depend on the seed, the epoch and the key only, so that a rerun, a lost executor
or another partitioning changes nothing.

`fit` learns 4 outputs behind a sigmoid, with a hidden layer or without, from a feature array and a box. Each step is one pass: tasks sum
gradients and losses of their rows, the sums are added in a shuffle, and as many numbers as the model has weights reach the driver, which makes
Adam's step. After each epoch its state is written in a folder; a run that finds states there goes on behind the last.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights travel with each task and come back as sums, so a model may have so many (8 bytes each).
MOST_WEIGHTS = 1_000_000

# The loss, the plateau and the stop, the ranges of the augmentation.
HUBER_DELTA, IOU_WEIGHT, IOU_EPSILON, LEAST_SIDE = 0.05, 2.0, 1e-7, 1e-5
PLATEAU_FACTOR, PLATEAU_PATIENCE, PLATEAU_DELTA, LEAST_RATE, STOP_PATIENCE = 0.5, 4, 1e-4, 1e-6, 10
BRIGHTNESS, CONTRAST = 0.12, 0.15

STATE = "epoch int, loss double, val_loss double, val_iou double, rate double, best double, waited int, level double, flat int, weights array<double>, after array<double>, m array<double>, v array<double>, next_rate double, stopped boolean"


# --- the dataset --------------------------------------------------------------------------


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int, batch: int, digits: int = 3) -> DataFrame:
    """The rows with `draw` (32 hexadecimal digits of their key, the seed and the epoch), `place` from 0 in the order of draw and key, and `batch`.

    Places are exact without one task that sorts all: rows are counted by the first digits of their draw (4,096 counts by default, or
    16 to the digits), and numbered within them. Keys should differ; rows of one key stand side by side in any order. A null key draws as ''.
    """
    drawn = rows.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    drawn = drawn.withColumn("_part", F.substring("draw", 1, digits))
    counts = drawn.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # 16 ** digits rows at most: one task's window, and a bound for the broadcast
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = drawn.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy("draw", key)))
    placed = numbered.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_k") - 1)
    return placed.withColumn("batch", F.floor(F.col("place") / batch).cast("long")).drop("_part", "_k", "_before")


def _share(draw: Column, start: int) -> Column:
    """Four digits of a draw as a number from 0 to 1."""
    return F.conv(F.substring(draw, start, 4), 16, 10).cast("double") / 65535.0


def flipped_pixels(pixels: Column, width: int) -> Column:
    """The picture from right to left."""
    lines = F.sequence(F.lit(0), F.floor(F.size(pixels) / width).cast("int") - 1)
    return F.when(F.size(pixels) > 0, F.flatten(F.transform(lines, lambda r: F.reverse(F.slice(pixels, r * width + 1, width))))).otherwise(pixels)


def flipped_box(box: Column) -> Column:
    x, y, w, h = (F.get(box, F.lit(i)) for i in range(4))
    return F.array(1.0 - x - w, y, w, h)


def augmented(rows: DataFrame, width: int) -> DataFrame:
    """Shuffled rows with pixels and box as training sees them: half of them flipped, box and all, each brighter or darker and of other contrast; and `flip`."""
    draw, p = F.col("draw"), F.col("pixels")
    rows = rows.withColumn("flip", F.substring(draw, 9, 1) < "8")
    rows = rows.withColumn("pixels", F.when(F.col("flip"), flipped_pixels(p, width)).otherwise(p)).withColumn("box", F.when(F.col("flip"), flipped_box(F.col("box"))).otherwise(F.col("box")))
    lighter = (_share(draw, 10) * 2 - 1) * BRIGHTNESS
    contrast = 1 - CONTRAST + _share(draw, 14) * 2 * CONTRAST
    rows = rows.withColumn("_mean", F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p) + lighter).withColumn("_c", contrast).withColumn("_l", lighter)
    moved = F.transform(p, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + F.col("_l") - F.col("_mean")) * F.col("_c") + F.col("_mean"))))
    return rows.withColumn("pixels", moved).drop("_mean", "_c", "_l")


# --- the model ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Shape:
    """Features in, hidden units (0: none), and the cut of a flat array of weights into layers."""

    features: int
    hidden: int = 0

    @property
    def size(self) -> int:
        return (self.features + 1) * 4 if not self.hidden else (self.features + 1) * self.hidden + (self.hidden + 1) * 4

    def layers(self, flat: np.ndarray) -> list[np.ndarray]:
        """Matrices with the bias as their last row."""
        if not self.hidden:
            return [flat.reshape(self.features + 1, 4)]
        n = (self.features + 1) * self.hidden
        return [flat[:n].reshape(self.features + 1, self.hidden), flat[n:].reshape(self.hidden + 1, 4)]

    def start(self, seed: int) -> np.ndarray:
        r = np.random.default_rng(seed)
        return np.concatenate([(r.uniform(-1, 1, m.shape) * math.sqrt(6 / sum(m.shape)) * (np.arange(len(m)) < len(m) - 1)[:, None]).ravel() for m in self.layers(np.zeros(self.size))])


def outputs(shape: Shape, flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Raw boxes from 0 to 1, and the hidden layer."""
    layers = shape.layers(flat)
    inner = None
    if shape.hidden:
        inner = np.maximum(x @ layers[0][:-1] + layers[0][-1], 0)
    z = (x if inner is None else inner) @ layers[-1][:-1] + layers[-1][-1]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60))), inner


def corners(box: np.ndarray) -> np.ndarray:
    """(x1, y1, x2, y2) of boxes, inside the picture and with some side."""
    low = np.clip(box[:, :2], 0, 1)
    return np.concatenate([low, np.maximum(np.clip(box[:, :2] + box[:, 2:], 0, 1), low + LEAST_SIDE)], 1)


def losses(raw: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's loss, Huber + 2 (1 - IoU), its IoU, and the loss's gradient by the raw box."""
    p, t = corners(raw), corners(truth)
    side, wanted = p[:, 2:] - p[:, :2], t[:, 2:] - t[:, :2]
    off = np.concatenate([p[:, :2] - t[:, :2], side - wanted], 1)
    far = np.abs(off) > HUBER_DELTA
    huber = np.where(far, HUBER_DELTA * (np.abs(off) - HUBER_DELTA / 2), off * off / 2).mean(1)
    by_off = np.clip(off, -HUBER_DELTA, HUBER_DELTA) / 4
    common = np.maximum(np.minimum(p[:, 2:], t[:, 2:]) - np.maximum(p[:, :2], t[:, :2]), 0)
    inter = common.prod(1)
    union = side.prod(1) + wanted.prod(1) - inter + IOU_EPSILON
    # along each axis, what a corner's move does to the shared area and to the predicted one
    other, meet = common[:, ::-1], (common > 0).all(1)[:, None]
    inter_by = np.concatenate([-other * ((p[:, :2] > t[:, :2]) & meet), other * ((p[:, 2:] < t[:, 2:]) & meet)], 1)
    area_by = np.concatenate([-side[:, ::-1], side[:, ::-1]], 1)
    iou_by = (inter_by * union[:, None] - inter[:, None] * (area_by - inter_by)) / (union**2)[:, None]
    by_corner = np.concatenate([by_off[:, :2] - by_off[:, 2:], by_off[:, 2:]], 1) - IOU_WEIGHT * iou_by
    free = raw[:, :2] + raw[:, 2:] < 1
    by_low, by_high = by_corner[:, :2], by_corner[:, 2:] * free
    iou = inter / union
    return huber + IOU_WEIGHT * (1 - iou), iou, np.concatenate([by_low + by_high, by_high], 1)


def gradient(shape: Shape, flat: np.ndarray, x: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Sums over the rows: the loss's gradient by the weights, the losses, the IoUs."""
    raw, inner = outputs(shape, flat, x)
    loss, iou, by_raw = losses(raw, truth)
    dz = by_raw * raw * (1 - raw)
    into = x if inner is None else inner
    last = np.concatenate([into.T @ dz, dz.sum(0)[None]])
    if inner is None:
        return last.ravel(), float(loss.sum()), float(iou.sum())
    dh = (dz @ shape.layers(flat)[1][:-1].T) * (inner > 0)
    return np.concatenate([(x.T @ dh).ravel(), dh.sum(0), last.ravel()]), float(loss.sum()), float(iou.sum())


# --- training -----------------------------------------------------------------------------


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def usable(rows: DataFrame, features: int) -> DataFrame:
    """Rows whose features and box are whole: of the right length, without nulls and non-finite numbers."""
    whole = lambda c, n: (F.size(c) == n) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("features").isNotNull() & F.col("box").isNotNull() & whole("features", features) & whole("box", 4))


def sums(rows: DataFrame, shape: Shape, flat: np.ndarray) -> dict[bool, np.ndarray]:
    """By `held`: the summed gradient, loss and IoU, and the number of rows. One small row a task is shuffled for each of both, and one a weight collected."""

    def run(batches):
        total = {False: np.zeros(shape.size + 3), True: np.zeros(shape.size + 3)}
        for batch in batches:
            x, truth, held = _matrix(batch.column(0), shape.features), _matrix(batch.column(1), 4), np.asarray(batch.column(2)).astype(bool)
            for side in (False, True):
                on = held == side
                if on.any():
                    g, loss, iou = gradient(shape, flat, x[on], truth[on])
                    total[side] += np.concatenate([g, [loss, iou, on.sum()]])
        kept = [s for s in total if total[s][-1]]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.bool_()), pa.array([total[s].tolist() for s in kept], pa.list_(pa.float64()))], names=["held", "sums"])

    parts = rows.select(F.col("features").cast("array<double>"), F.col("box").cast("array<double>"), "held").mapInArrow(run, "held boolean, sums array<double>")
    found = parts.select("held", F.posexplode("sums").alias("k", "v")).groupBy("held", "k").agg(F.sum("v").alias("v")).toPandas()
    return {bool(side): g.sort_values("k")["v"].to_numpy() for side, g in found.groupby("held")}


def states(spark, folder: str) -> DataFrame | None:
    """What epochs have left in a folder, if any has: an epoch that was broken off has written nothing that counts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch-*/_SUCCESS"))
    paths = [x.getPath().getParent().toString() for x in there]
    return spark.read.schema(STATE).parquet(*paths) if paths else None


def fit(rows: DataFrame, shape: Shape, folder: str, epochs: int = 30, rate: float = 1e-3, seed: int = 42) -> DataFrame:
    """States of all epochs (STATE) after training on rows (features, box, held): losses are those of `weights`, `after` goes on from them.

    The rate halves after 4 epochs without a better held-out loss, and training stops after 10; without held-out rows the own loss decides. Rows that aren't
    whole take no part; without any that trains, ValueError. `rows` is read once an epoch: save it first where it is costly. An interrupted run is
    continued by the same call.
    """
    if shape.size > MOST_WEIGHTS:
        raise ValueError(f"a model of {shape.size} weights; {MOST_WEIGHTS} at most")
    spark = rows.sparkSession
    rows = usable(rows, shape.features).withColumn("held", F.coalesce("held", F.lit(False)))
    old = states(spark, folder)
    last = old.orderBy(F.desc("epoch")).first() if old is not None else None
    if last is None:
        zero = np.zeros(shape.size)
        flat, m, v, epoch, best, waited, level, flat_for, stopped = shape.start(seed), zero, zero, 0, math.inf, 0, math.inf, 0, False
    else:
        flat, m, v = (np.array(last[c]) for c in ("after", "m", "v"))
        epoch, rate, best, waited, level, flat_for, stopped = last["epoch"] + 1, last["next_rate"], last["best"], last["waited"], last["level"], last["flat"], last["stopped"]
    while epoch < epochs and not stopped:
        found = sums(rows, shape, flat)
        if False not in found:
            raise ValueError("no row to train on")
        own = found[False] / found[False][-1]
        judged = found[True] / found[True][-1] if True in found else own
        loss, val_loss, val_iou, now = float(own[-3]), float(judged[-3]), float(judged[-2]), rate
        waited = 0 if val_loss < best else waited + 1
        best = min(best, val_loss)
        flat_for = 0 if val_loss < level - PLATEAU_DELTA else flat_for + 1
        level = val_loss if flat_for == 0 else level
        if flat_for >= PLATEAU_PATIENCE:
            rate, flat_for = max(rate * PLATEAU_FACTOR, min(rate, LEAST_RATE)), 0
        stopped = waited >= STOP_PATIENCE
        g = own[:-3]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        after = flat - rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-7)
        row = (epoch, loss, val_loss, val_iou, now, best, waited, level, flat_for, flat.tolist(), after.tolist(), m.tolist(), v.tolist(), rate, stopped)
        spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch-{epoch:06d}")
        flat, epoch = after, epoch + 1
    return states(spark, folder)


def best_weights(found: DataFrame) -> np.ndarray:
    """The weights of the least held-out loss, the earliest on ties."""
    return np.array(found.orderBy("val_loss", "epoch").select("weights").first()["weights"])


def predict(rows: DataFrame, shape: Shape, flat: np.ndarray) -> DataFrame:
    """(key, x, y, w, h) of rows (key, features): boxes inside the picture; rows whose features aren't whole have none."""

    def run(batches):
        for batch in batches:
            c = corners(outputs(shape, flat, _matrix(batch.column(1), shape.features))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(k) for k in (c[:, 0], c[:, 1], c[:, 2] - c[:, 0], c[:, 3] - c[:, 1])]], names=["key", "x", "y", "w", "h"])

    some = usable(rows.withColumn("box", F.array(*[F.lit(0.0)] * 4)), shape.features).select(F.col("key").cast("long").alias("key"), F.col("features").cast("array<double>"))
    return some.mapInArrow(run, "key long, x double, y double, w double, h double")
