"""Cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: The folder of a local session that names none.
_own: list[str | None] = [None]


def shared_folder(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without it one folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own[0] = _own[0] or tempfile.mkdtemp(prefix="lectern-")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder: plans that use them many times read them there, with their sizes known."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df.saved_at)


def delete(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
