"""Stateful segmentation of a stream equals the batch over all its events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.streaming.online import online_islands


def test_islands_over_two_batches_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "ts", "value")
    half = events.agg(F.expr("percentile_approx(ts, 0.5)").alias("t")).first()["t"]
    for k, part in enumerate((events.where(F.col("ts") <= half), events.where(F.col("ts") > half))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    q = online_islands(stream, 60.0).writeStream.format("memory").queryName("islands").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    change = F.coalesce((F.abs(F.col("value") - F.lag("value").over(w)) > 60.0).cast("int"), F.lit(1))
    want = events.withColumn("is_change", change).select("event_id", "is_change", (F.sum("is_change").over(w) - 1).alias("seg"))
    assert {(r.event_id, r.is_change, r.seg) for r in spark.table("islands").collect()} == {tuple(r) for r in want.collect()}
