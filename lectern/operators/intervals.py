"""Joins of points with intervals and with their neighbours in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within_intervals(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Each point (video, event_id, t) with its span (video, seg, a, b): the one that holds t, else the nearest by either end.

    Spans of a video don't overlap, so the last that starts before the point and
    the first behind it are all that count: one sort by video and time, no product.
    """
    p = points.select("video", "t", F.lit(1).alias("kind"), "event_id", F.lit(None).cast("long").alias("seg"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    s = spans.select("video", F.col("a").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event_id"), "seg", "a", "b")
    w = Window.partitionBy("video").orderBy("t", "kind", "seg")
    span = F.when(F.col("kind") == 0, F.struct("seg", "a", "b"))
    both = p.unionByName(s).withColumn("before", F.last(span, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("behind", F.first(span, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    gap = lambda c: F.when((F.col(f"{c}.a") <= F.col("t")) & (F.col("t") <= F.col(f"{c}.b")), F.lit(0.0)).otherwise(F.least(F.abs(F.col("t") - F.col(f"{c}.a")), F.abs(F.col("t") - F.col(f"{c}.b"))))
    near = F.when(F.col("before").isNull(), F.col("behind.seg")).when(F.col("behind").isNull() | (gap("before") <= gap("behind")), F.col("before.seg")).otherwise(F.col("behind.seg"))
    return both.where("kind = 1").select("video", "event_id", "t", near.alias("seg"))


def nearest_in_time(points: DataFrame, rows: DataFrame) -> DataFrame:
    """(event_id, idx): the other row of the video nearest in time to each point, the earliest on ties.

    Points are rows of the same video, so their neighbours by order are the only candidates.
    """
    w = Window.partitionBy("video").orderBy("idx")
    near = rows.select("video", "event_id", "t", "idx", F.lag("t").over(w).alias("t0"), F.lag("idx").over(w).alias("i0"), F.lead("t").over(w).alias("t1"), F.lead("idx").over(w).alias("i1"))
    # rows of one time stand side by side; the first of an equal time before is found by its time
    first = F.min("idx").over(Window.partitionBy("video", "t"))
    ties = rows.select("video", F.col("t").alias("t0"), F.col("idx").alias("i0"), first.alias("least"))
    chosen = F.when(F.col("t0").isNull(), F.col("i1")).when(F.col("t1").isNull() | (F.col("t") - F.col("t0") <= F.col("t1") - F.col("t")), F.col("least")).otherwise(F.col("i1"))
    found = near.join(ties, ["video", "t0", "i0"], "left").select("event_id", chosen.alias("idx")).where("idx IS NOT NULL")
    return found.join(points.select("event_id"), "event_id", "left_semi")
