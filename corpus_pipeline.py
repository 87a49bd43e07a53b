"""A training-data pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, jaccard_join, line_dedup, pieces, toxicity
from lectern.llm.common import discard, save, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below its threshold. The model learns from the whole labelled table."""
    model = toxicity.fit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document before them has, or nearly has.

    Copies go whole: documents that lose all their text, and those that lose all their longer lines
    and whose short ones all stand in the documents where the longer lines stay.
    """
    out = line_dedup.cut_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.col("text")) == "")
    rest = F.split("text", "\n")
    short = (F.col("n_removed") > 0) & ~F.exists(rest, lambda x: F.octet_length(x) >= line_dedup.MIN_BYTES)
    out = out.where(~F.coalesce(emptied, F.lit(False))).withColumn("shape", F.when(short, F.xxhash64("text", "kept_in")))
    left = save(spark, out.where("shape IS NOT NULL").select("doc_id", "row", "shape", F.array_distinct(rest).alias("rest"), "kept_in"), "fragments")
    # each kind of fragment is looked up once, however many copies have it
    kinds = left.dropDuplicates(["shape"])
    asked = kinds.select("shape", F.explode("rest").alias("line"), "kept_in")
    keepers = kinds.select(F.explode("kept_in").alias("keeper")).select("keeper.*").distinct()
    stand = line_dedup.rows_of(docs).join(keepers, ["doc_id", "row"], "left_semi").select(F.struct("doc_id", "row").alias("keeper"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    stand = stand.where(F.octet_length("line") < line_dedup.MIN_BYTES)
    found = asked.select("shape", "line", F.explode("kept_in").alias("keeper")).join(stand, ["keeper", "line"], "left_semi").select("shape", "line").distinct()
    own = asked.join(found, ["shape", "line"], "left_anti").select("shape").distinct()
    copies = save(spark, left.join(own, "shape", "left_anti").select("doc_id", "row").distinct(), "copies")
    discard(left)
    out = out.join(copies.hint("shuffle_merge"), ["doc_id", "row"], "left_anti")
    return out.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return jaccard_join.keep_first(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document; round_trip tells whether they decode to its text."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", toxic),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", encoded),
]

#: No SQL has the trained scores, edit joins or shortest paths; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, saved = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = save(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*saved)
        saved = [docs]
    return docs
