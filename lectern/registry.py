"""All queries of the library's own operators, by key, and the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import catalog, format_queries, frame_queries, geometry_queries, keyframe_queries, lecture_queries, library_queries, markup_queries, note_queries, region_queries, source_queries, summary_queries, table_queries, text_queries, training_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.QUERIES["seq_keyframes"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
