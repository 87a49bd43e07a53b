"""Physical layout: tables bucketed and sorted by the keys that queries ask for, as secondary indexes serve them in a database."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lectern.operators.cut import shared_folder


def laid_out(df: DataFrame, keys: list[str], order: list[str], buckets: int, name: str | None = None, path: str | None = None) -> DataFrame:
    """The table, written with its rows dealt into buckets by `keys` and sorted by them and `order`, one file a bucket.

    Grouping, windows and joins by the keys then need no exchange, and joins of tables with equally many buckets meet bucket by
    bucket. Buckets should be many enough that one fits a task: total size over some hundred megabytes. A key's rows are in one
    bucket; a key that most rows have is better served by sorting on more keys.
    """
    spark = df.sparkSession
    name = name or f"laid_out_{uuid.uuid4().hex}"
    path = path or f"{shared_folder(spark)}/{name}"
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys, *order)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path).format("parquet").mode("overwrite").saveAsTable(name)
    return spark.table(name)
