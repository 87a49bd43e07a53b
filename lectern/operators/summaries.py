"""Extractive summaries of documents' sentences, and how far summaries agree.

Sentences are (doc_id, i, text). Every measure gives (doc_id, i, score); a summary
keeps the better half of a document's sentences, rounded up, ties by place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.maths import round6
from lectern.operators import whole as W


def sentence_rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "text")).withColumn("i", F.col("i").cast("long"))


def better_half(scores: DataFrame) -> DataFrame:
    """(doc_id, i, score, place) of the better half, by score, ties by place in the text."""
    w = Window.partitionBy("doc_id")
    ranked = scores.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "i"))).withColumn("n", F.count("*").over(w))
    return ranked.where("place <= ceil(n / 2.0)").select("doc_id", "i", "score", F.col("place").cast("long").alias("place"))


def luhn(sentences: DataFrame, gap: int = 4, least: int = 2) -> DataFrame:
    """Clusters of significant words (of a document's tokens those that stand `least` times or more), at most `gap` other words between two.

    A cluster scores the square of its words over its length; a sentence as much as its best cluster.
    """
    words = sentences.select("doc_id", "i", F.posexplode(T.tokens(F.col("text"))).alias("p", "token"))
    often = words.groupBy("doc_id", "token").agg(F.count("*").alias("tf")).where(F.col("tf") >= least)
    hits = words.join(often.select("doc_id", "token"), ["doc_id", "token"])
    w = Window.partitionBy("doc_id", "i").orderBy("p")
    fresh = F.coalesce((F.col("p") - F.lag("p").over(w) > gap + 1).cast("int"), F.lit(0))
    clusters = hits.withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(w)).groupBy("doc_id", "i", "k").agg(F.count("*").alias("m"), (F.max("p") - F.min("p") + 1).alias("length"))
    best = clusters.groupBy("doc_id", "i").agg(F.max(F.col("m") * F.col("m") / F.col("length")).alias("score"))
    return sentences.select("doc_id", "i").join(best, ["doc_id", "i"], "left").select("doc_id", "i", round6(F.coalesce("score", F.lit(0.0))).alias("score"))


def _scores(sentences: DataFrame, ranks) -> DataFrame:
    return W.by_document(W.gathered(sentences), lambda doc: [(doc.doc_id, i, x) for i, x in enumerate(ranks(doc))], "doc_id long, i long, score double")


def text_rank(sentences: DataFrame) -> DataFrame:
    """Rank in the graph of sentences, weighted by the words that two share over the words that they have. A document's i count from 0."""
    return _scores(sentences, W.text_ranks)


def lex_rank(sentences: DataFrame, least: float = 0.1) -> DataFrame:
    """Rank in the graph of sentences whose cosine by term and inverse sentence frequency is above a threshold. A document's i count from 0."""
    return _scores(sentences, lambda doc: W.lex_ranks(doc, least))


def topic_strength(counts: np.ndarray, topics: int = 3) -> np.ndarray:
    """Length of each column of a terms x sentences matrix in its strongest topics."""
    if not counts.size:
        return np.zeros(counts.shape[1])
    _, s, vt = np.linalg.svd(counts, full_matrices=False)
    k = min(topics, len(s))
    return np.sqrt(((s[:k, None] ** 2) * vt[:k] ** 2).sum(0))


def latent(sentences: DataFrame, topics: int = 3) -> DataFrame:
    """Strength of each sentence in its document's main topics, by singular values of the counts of its tokens."""
    rows = sentences.select("doc_id", "i", T.tokens(F.col("text")).alias("tokens"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        terms = {t: k for k, t in enumerate(sorted({t for ts in pdf["tokens"] for t in ts}))}
        counts = np.zeros((len(terms), len(pdf)))
        for k, ts in enumerate(pdf["tokens"]):
            np.add.at(counts, ([terms[t] for t in ts], k), 1)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "i": pdf["i"], "score": np.round(topic_strength(counts, topics), 6)})

    return rows.groupBy("doc_id").applyInPandas(run, "doc_id long, i long, score double")


def bigrams(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gram, c) of summaries (keys, text)."""
    t = summaries.select(*keys, T.tokens(F.col("text")).alias("t")).where(F.size("t") > 1)
    return t.select(*keys, F.explode(F.expr("transform(sequence(0, size(t) - 2), i -> concat(t[i], ' ', t[i + 1]))")).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("c"))


def rouge2(summaries: DataFrame) -> DataFrame:
    """(doc_id, target, prediction, precision, recall, f) of all summaries (doc_id, method, text) of a document against each other: shared bigrams, as multisets."""
    g = bigrams(summaries, ["doc_id", "method"])
    sizes = summaries.select("doc_id", "method").join(g.groupBy("doc_id", "method").agg(F.sum("c").alias("n")), ["doc_id", "method"], "left").na.fill(0, ["n"])
    a, b = g.select("doc_id", "gram", F.col("method").alias("target"), F.col("c").alias("x")), g.select("doc_id", "gram", F.col("method").alias("prediction"), F.col("c").alias("y"))
    shared = a.join(b, ["doc_id", "gram"]).groupBy("doc_id", "target", "prediction").agg(F.sum(F.least("x", "y")).alias("both"))
    side = lambda m, n: sizes.select("doc_id", F.col("method").alias(m), F.col("n").alias(n))
    j = side("target", "nt").join(side("prediction", "np"), "doc_id").join(shared, ["doc_id", "target", "prediction"], "left").na.fill(0, ["both"])
    p = F.when(F.col("np") > 0, F.col("both") / F.col("np")).otherwise(0.0)
    r = F.when(F.col("nt") > 0, F.col("both") / F.col("nt")).otherwise(0.0)
    return j.select("doc_id", "target", "prediction", round6(p).alias("precision"), round6(r).alias("recall"), round6(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).alias("f"))


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence: a row of the table is one number, of as many bits as a has words."""
    at, full = {}, (1 << len(a)) - 1
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    row = full
    for w in b:
        if found := row & at.get(w, 0):
            row = (row + found | row - found) & full
    return len(a) - row.bit_count()


def scores_l(a: list, b: list) -> tuple[float, float, float]:
    """Precision, recall and f of b against a by their longest common subsequence."""
    k = common_length(a, b)
    p, r = k / max(len(b), 1), k / max(len(a), 1)
    return tuple(np.round([p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0], 6).tolist())


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(keys, precision, recall, f) of pairs (doc_id, target, prediction, a, b: token arrays) by their longest common subsequence."""

    def run(parts):
        for pdf in parts:
            scores = np.array([scores_l(list(a), list(b)) for a, b in zip(pdf["a"], pdf["b"])]).reshape(-1, 3)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "target": pdf["target"], "prediction": pdf["prediction"], "precision": scores[:, 0], "recall": scores[:, 1], "f": scores[:, 2]})

    return pairs.select("doc_id", "target", "prediction", "a", "b").mapInPandas(run, "doc_id long, target string, prediction string, precision double, recall double, f double")
