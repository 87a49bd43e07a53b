"""Datasets of pictures with boxes, and a regressor trained on them. Vectors of 64 numbers stand for pictures of 8 by 8 pixels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import training as R
from lectern.operators.cut import cut, delete, discard, shared_folder
from lectern.plans.catalog import query, table

_SIDE = 8


def pictures(spark, sf):
    """(vec_id, pixels, box): gray levels, and the box around the pixels of nine tenths of the brightest level or more."""
    level = lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 384 * e.cast("double")).cast("double"))) / 255.0
    rows = table(spark, sf, "embeddings").where(F.size("embedding") == _SIDE * _SIDE).select("vec_id", F.transform("embedding", level).alias("pixels"))
    bright = F.filter(F.sequence(F.lit(0), F.lit(_SIDE * _SIDE - 1)), lambda i: F.get("pixels", i) >= 0.9 * F.array_max("pixels"))
    rows = rows.withColumn("i", bright)
    at = lambda f, how: how(F.transform("i", f))
    column, line = (lambda i: i % _SIDE), (lambda i: F.floor(i / _SIDE))
    x, y = at(column, F.array_min) / _SIDE, at(line, F.array_min) / _SIDE
    w, h = (at(column, F.array_max) + 1) / _SIDE - x, (at(line, F.array_max) + 1) / _SIDE - y
    return rows.select("vec_id", "pixels", F.array(*[c.cast("double") for c in (x, y, w, h)]).alias("box"))


_PICTURES = """pictures AS (SELECT vec_id, p, list_min(list_transform(b, lambda i: (i - 1) % 8)) / 8.0::DOUBLE AS x1, list_min(list_transform(b, lambda i: (i - 1) // 8)) / 8.0::DOUBLE AS y1, (list_max(list_transform(b, lambda i: (i - 1) % 8)) + 1) / 8.0::DOUBLE AS x2, (list_max(list_transform(b, lambda i: (i - 1) // 8)) + 1) / 8.0::DOUBLE AS y2
    FROM (SELECT vec_id, p, list_filter(range(1, 65), lambda i: p[i] >= 0.9::DOUBLE * list_max(p)) AS b FROM (SELECT vec_id, list_transform(embedding, lambda e: least(255::DOUBLE, greatest(0::DOUBLE, floor(128 + 384 * e::DOUBLE))) / 255::DOUBLE) AS p FROM embeddings WHERE len(embedding) = 64)))"""


@query(
    "ml_dataset",
    f"""WITH {_PICTURES}, d AS (SELECT *, md5('42:3:' || vec_id) AS draw FROM pictures),
    f AS (SELECT vec_id, row_number() OVER (ORDER BY draw, vec_id) - 1 AS place, substr(draw, 9, 1) < '8' AS flip, x1, y1, x2 - x1 AS w, y2 - y1 AS h, p, (('0x' || substr(draw, 10, 4))::INT / 65535::DOUBLE * 2 - 1) * 0.12::DOUBLE AS l, 1 - 0.15::DOUBLE + ('0x' || substr(draw, 14, 4))::INT / 65535::DOUBLE * 2 * 0.15::DOUBLE AS c FROM d),
    g AS (SELECT *, CASE WHEN flip THEN list_transform(range(0, 64), lambda i: p[(i // 8) * 8 + 8 - i % 8]) ELSE p END AS q FROM f),
    m AS (SELECT *, list_reduce(q, lambda s, x: s + x) / 64 + l AS mean FROM g)
    SELECT vec_id, place, place // 16 AS batch, flip, CASE WHEN flip THEN 1 - x1 - w ELSE x1 END AS x, y1 AS y, w, h, list_sum(list_transform(range(1, 65), lambda i: i * floor(least(1::DOUBLE, greatest(0::DOUBLE, (q[i] + l - mean) * c + mean)) * 1000 + 0.5)::BIGINT))::BIGINT AS digest FROM m""",
)
def ml_dataset(spark, sf):
    """The fourth epoch's batches: a seeded order, half of the pictures flipped with their boxes, other light and contrast."""
    seen = R.augmented(R.shuffled(pictures(spark, sf), "vec_id", 42, 3, 16), _SIDE)
    levels = F.transform("pixels", lambda v, i: (i + 1) * F.floor(v * 1000 + 0.5))
    box = [F.get("box", F.lit(k)).alias(c) for k, c in enumerate("xywh")]
    return seen.select("vec_id", "place", "batch", "flip", *box, F.aggregate(levels, F.lit(0).cast("long"), lambda s, v: s + v).alias("digest"))


def _trained(spark, sf, epochs):
    shape, folder = R.Shape(_SIDE * _SIDE, 16), f"{shared_folder(spark)}/fit-{uuid.uuid4().hex}"
    rows = cut(pictures(spark, sf).select("vec_id", F.col("pixels").alias("features"), "box", (F.crc32(F.col("vec_id").cast("string")) % 5 == 0).alias("held")))
    try:
        found = R.fit(rows, shape, folder, epochs, 0.02)
        history = found.select("epoch", "loss", "val_loss", "val_iou", "rate").orderBy("epoch").collect()  # one row an epoch
        return shape, history, R.best_weights(found)
    finally:
        discard(rows)
        delete(spark, folder)


@query("ml_training")
def ml_training(spark, sf):
    """Losses by epoch of a regressor with 16 hidden units: no SQL, tested against gradients by differences and a run on one machine."""
    _, history, _ = _trained(spark, sf, 8)
    return spark.createDataFrame([tuple(r) for r in history], "epoch int, loss double, val_loss double, val_iou double, rate double")


@query("ml_prediction")
def ml_prediction(spark, sf):
    """Boxes of all pictures by the best of eight epochs: no SQL, tested with the training."""
    shape, _, best = _trained(spark, sf, 8)
    return R.predict(pictures(spark, sf).select(F.col("vec_id").alias("key"), F.col("pixels").alias("features")), shape, best).withColumnRenamed("key", "vec_id")
