"""Centrality over similarity graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.cut import cut


def pagerank(edges: DataFrame, rounds: int = 12, damping: float = 0.85) -> DataFrame:
    """(node, rank) over weighted edges (src, dst, weight), a fixed number of rounds of joins; every node has an edge."""
    step, nodes = _shares(edges, [])
    return _rounds(step, nodes.withColumn("n", F.lit(nodes.count())), [], rounds, damping).select("node", "rank")


def pagerank_by(edges: DataFrame, graph: str, rounds: int = 12, damping: float = 0.85) -> DataFrame:
    """(graph, node, rank) of many graphs at once, edges (graph, src, dst, weight).

    The shares of edges are written once, and ranks every fourth round, so that a
    lost executor repeats four rounds at most.
    """
    step, nodes = _shares(edges, [graph])
    return _rounds(step, cut(nodes.join(nodes.groupBy(graph).agg(F.count("*").alias("n")), graph)), [graph], rounds, damping)


def _shares(edges: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """What each edge passes on of its source's rank, and the nodes."""
    edges = edges.where("weight > 0")
    out = edges.groupBy(*by, "src").agg(F.sum("weight").alias("all"))
    step = cut(edges.join(out, [*by, "src"]).select(*by, "src", "dst", (F.col("weight") / F.col("all")).alias("share")))
    return step, cut(step.select(*by, F.col("src").alias("node")).union(step.select(*by, "dst")).distinct())


def _rounds(step: DataFrame, nodes: DataFrame, by: list[str], rounds: int, damping: float) -> DataFrame:
    rank = nodes.select(*by, "node", (1.0 / F.col("n")).alias("rank"))
    for k in range(rounds):
        sent = step.join(rank.withColumnRenamed("node", "src"), [*by, "src"]).groupBy(*by, F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = nodes.join(sent, [*by, "node"], "left").select(*by, "node", ((1 - damping) / F.col("n") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 4 == 3 and k < rounds - 1:
            rank = cut(rank)
    return rank
