"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model.

The model is over n-grams of bytes (BYTES: all 256, five at a time). Trusted texts
(quality 1) are counted in their tasks and summed by gram in shuffles; continuation
counts, discounts (from counts of counts), context masses and interpolated
probabilities are joins and sums over gram keys, dealt over all partitions. What is
counted grows with the trusted text: nothing is pruned or capped.

Documents are scored by joining their distinct grams with the model: score_by_joins
does it in shuffles, grams that the corpus asks for level by level from the longest
order down, at any size. Its shuffles are many times the text. So, while the model
has at most BROADCAST_GRAMS rows, score_by_lookup makes the same join inside the
tasks that read the texts; both give the same perplexities.

A text that the model has counted looks better to it than its like. So a fifth of
the trusted documents, by a hash of their ids, stays out of the counts (unless there
would be none). A document is kept if its perplexity is at most its language's
threshold: the QUANTILE of the counted documents' perplexities, raised by how much
higher the median of those that stayed out is. A language without trusted documents,
or a null one, takes the threshold of all. Without any trusted text all is kept.

Nulls: a null or empty text has no perplexity (null) and is not kept. Rows of
labels with null ids or quality teach nothing; a document is trusted if a row of
its id has quality 1 and none has 0. Repeated rows are scored each for itself; a
text that is listed twice among the trusted ones counts twice. Other columns don't
matter.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import discard, held_out, in_task, owner, save, slices, table, text_bytes

QUANTILE = 0.99
#: One in so many trusted documents is not counted, for the thresholds.
FOLD = 5
#: Rows of a model that is looked up inside tasks, at most: 16 bytes each.
BROADCAST_GRAMS = 4_000_000
#: Languages whose thresholds are broadcast, at most.
BROADCAST_LANGS = 10_000
_SLICE = 500_000


class Alphabet(NamedTuple):
    """Symbol of each byte (0 also stands in front of each text), bits of a symbol, and how many make a gram."""

    symbols: np.ndarray
    bits: int
    order: int


def _symbols() -> np.ndarray:
    """0 white space; 1-26 small and 27-52 capital letters; then digits, frequent marks, other marks and non-ASCII bytes in classes."""
    out = np.full(256, 57, np.int64)
    out[[32, 9, 10, 11, 12, 13]] = 0
    out[97:123], out[65:91] = np.arange(1, 27), np.arange(27, 53)
    out[48:58] = 53
    out[ord(".")], out[ord(",")] = 54, 55
    out[[ord(c) for c in "!?;:'\"-()"]] = 56
    out[[ord(c) for c in "#$%&*|"]] = 58
    out[128:] = 59 + np.arange(128) % 5
    return out


#: 64 classes of bytes: small enough for a table of all grams (dense_log2), which the tests hold the joins against.
CLASSES = Alphabet(_symbols(), 6, 4)
#: Every byte for itself.
BYTES = Alphabet(np.arange(256), 8, 5)


def gram_codes(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Code of the gram that ends at each byte, and the bytes' rows."""
    sizes = np.diff(offsets)
    rows, before = len(sizes), alphabet.order - 1
    body = np.zeros(len(data) + before * rows, np.int64)
    row = np.repeat(np.arange(rows), sizes)
    at = np.arange(len(data)) + before * (row + 1)
    body[at] = alphabet.symbols[data]
    code = body[at]
    for k in range(1, alphabet.order):
        code = code | (body[at - k] << (alphabet.bits * k))
    return code, row


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all (keys, counts), and their sums."""
    keys, n = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def count_grams(texts: DataFrame, alphabet: Alphabet = CLASSES) -> DataFrame:
    """(gram, n) of all texts: summed within a task first, then by gram."""

    def run(batches):
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in slices(offsets, _SLICE):
                code, _ = gram_codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], alphabet)
                held.append(np.unique(code, return_counts=True))
                if len(held) > 8:
                    held = [_summed(held)]
        keys, n = _summed(held)
        for lo in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], names=["gram", "n"])

    return texts.select("text").mapInArrow(in_task(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, alphabet: Alphabet = CLASSES) -> DataFrame:
    """(k, gram, p, rest) of all orders: the discounted share of a gram in its context, and what its context leaves to the lower order.

    Orders below the highest count in how many grams of the next order their gram ends.
    """
    bits, base = alphabet.bits, 1 << alphabet.bits
    orders = {alphabet.order: counts}
    for k in range(alphabet.order - 1, 0, -1):
        orders[k] = orders[k + 1].groupBy((F.col("gram") % F.lit(1 << (bits * k))).alias("gram")).agg(F.count("*").alias("n"))
    out = None
    for k, grams in orders.items():
        # discounts by modified Kneser-Ney, from how many grams stand once to four times: four numbers
        c = grams.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        y = c["n1"] / max(c["n1"] + 2 * c["n2"], 1)
        d = [max(0.1, min(i - 0.05, i - (i + 1) * y * c[f"n{i + 1}"] / max(c[f"n{i}"], 1))) for i in (1, 2, 3)]
        context = (
            grams.groupBy(F.expr(f"gram div {base}").alias("context"))
            .agg(F.sum("n").alias("total"), *[F.count_if(F.col("n") == i).alias(f"m{i}") for i in (1, 2)], F.count_if(F.col("n") >= 3).alias("m3"))
            .select("context", "total", ((d[0] * F.col("m1") + d[1] * F.col("m2") + d[2] * F.col("m3")) / F.col("total")).alias("rest"))
        )
        scored = grams.withColumn("context", F.expr(f"gram div {base}")).join(context, "context")
        part = scored.select(
            F.lit(k).alias("k"), "gram", ((F.col("n") - F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])) / F.col("total")).alias("p"), "rest"
        )
        out = part if out is None else out.unionByName(part)
    return out


def interpolated(shares: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(k, kind, gram, log2): kind 0: probability of a gram that was counted, all lower orders in; kind 1: what a context leaves.

    A gram that was not counted takes its context's rest times the probability of its suffix, which is one order lower.
    """
    bits = alphabet.bits
    full, out = None, None
    for k in range(1, alphabet.order + 1):
        own = shares.where(F.col("k") == k)
        if full is None:
            full = own.select("gram", (F.col("p") + F.col("rest") / (1 << bits)).alias("full"))
        else:
            lower = full.withColumnRenamed("gram", "suffix").withColumnRenamed("full", "lower")
            full = own.withColumn("suffix", F.col("gram") % (1 << (bits * (k - 1)))).join(lower, "suffix").select("gram", (F.col("p") + F.col("rest") * F.col("lower")).alias("full"))
        left = own.groupBy(F.expr(f"gram div {1 << bits}").alias("gram")).agg(F.first("rest").alias("rest"))
        part = full.select(F.lit(k).alias("k"), F.lit(0).alias("kind"), "gram", F.log2("full").alias("log2")).unionByName(left.select(F.lit(k).alias("k"), F.lit(1).alias("kind"), "gram", F.log2("rest").alias("log2")))
        out = part if out is None else out.unionByName(part)
    return out


def dense_log2(model) -> np.ndarray:
    """log2 of the interpolated probability of every gram code over CLASSES, from the collected shares: for tests and small models."""
    lower = np.full(64, 1 / 64)
    for k in range(1, CLASSES.order + 1):
        own = model[model["k"] == k]
        gram, p, rest = own["gram"].to_numpy(), own["p"].to_numpy(), own["rest"].to_numpy()
        left = np.ones(64 ** (k - 1))
        left[gram // 64] = rest
        # the lower order's probability is that of the same gram without its first symbol
        full = (left[:, None] * np.tile(lower.reshape(-1, 64), (64 if k > 1 else 1, 1))).ravel()
        full[gram] += p
        lower = full
    return np.log2(lower).astype(np.float32)


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked key among the ascending keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def log2_of(codes: np.ndarray, levels: dict, alphabet: Alphabet) -> np.ndarray:
    """log2 of the interpolated probability of each code; levels[k, kind]: ascending grams and their log2."""
    out, live = np.zeros(len(codes)), np.arange(len(codes))
    for k in range(alphabet.order, 0, -1):
        gram = codes[live] & ((1 << (alphabet.bits * k)) - 1)
        at, hit = _found(levels[k, 0][0], gram)
        out[live[hit]] += levels[k, 0][1][at[hit]]
        live, gram = live[~hit], gram[~hit]
        at, hit = _found(levels[k, 1][0], gram >> alphabet.bits)
        out[live[hit]] += levels[k, 1][1][at[hit]]
    out[live] -= alphabet.bits
    return out


def score_by_lookup(documents: DataFrame, model: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(doc_id, lang, perplexity) of every row, null where there is no byte; the model's size must have been checked."""
    rows = model.toArrow()
    k, kind, gram, log2 = (np.asarray(rows[c]) for c in ("k", "kind", "gram", "log2"))
    levels = {}
    for pair in ((i, j) for i in range(1, alphabet.order + 1) for j in (0, 1)):
        at = np.flatnonzero((k == pair[0]) & (kind == pair[1]))
        at = at[np.argsort(gram[at])]
        levels[pair] = (gram[at], log2[at])
    shared = documents.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, _SLICE):
                code, row = gram_codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], alphabet)
                kinds, same = np.unique(code, return_inverse=True)
                size = np.diff(offsets[i : j + 1])
                bits = -np.bincount(row, log2_of(kinds, shared.value, alphabet)[same], j - i) / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(2).slice(i, j - i), pa.array(np.exp2(bits), mask=size == 0)], names=["doc_id", "lang", "perplexity"])

    return documents.select("doc_id", "text", "lang").mapInArrow(in_task(run), "doc_id long, lang string, perplexity double")


def score_by_joins(documents: DataFrame, model: DataFrame, alphabet: Alphabet) -> DataFrame:
    """The same by shuffles, for a model of any size."""
    spark = documents.sparkSession
    rows = save(spark, documents.select("doc_id", "lang", "text").withColumn("row", F.monotonically_increasing_id()), "rows")

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, _SLICE):
                code, row = gram_codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], alphabet)
                order = np.lexsort((code, row))
                code, row = code[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])) if len(code) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new] + i)), pa.array(code[new]), pa.array(np.diff(np.append(new, len(code))))], names=["row", "code", "n"])

    grams = save(spark, rows.select("row", "text").mapInArrow(in_task(run), "row long, code long, n long"), "document-grams")
    # what the corpus asks for, each gram once; those that a level has are answered, the others go on with what their context leaves
    live = grams.select("code").distinct().withColumn("log2", F.lit(0.0))
    answers = None
    for k in range(alphabet.order, 0, -1):
        of = lambda kind, name: model.where(f"k = {k} AND kind = {kind}").select(F.col("gram").alias(name), F.col("log2").alias(f"{name}_log2"))  # noqa: E731, B023
        gram = F.col("code") % (1 << (alphabet.bits * k))
        step = live.withColumn("gram", gram).join(of(0, "gram"), "gram", "left").withColumn("context", F.expr(f"gram div {1 << alphabet.bits}")).join(of(1, "context"), "context", "left")
        step = save(spark, step.select("code", "log2", "gram_log2", F.coalesce("context_log2", F.lit(0.0)).alias("context_log2")), f"level-{k}")
        done = step.where("gram_log2 IS NOT NULL").select("code", (F.col("log2") + F.col("gram_log2")).alias("log2"))
        answers = done if answers is None else answers.unionByName(done)
        live = step.where("gram_log2 IS NULL").select("code", (F.col("log2") + F.col("context_log2")).alias("log2"))
    answers = answers.unionByName(live.select("code", (F.col("log2") - alphabet.bits).alias("log2")))
    bits = grams.join(answers, "code").groupBy("row").agg((-F.sum(F.col("n") * F.col("log2")) / F.sum("n")).alias("bits"))
    return rows.select("row", "doc_id", "lang").join(bits, "row", "left").select("doc_id", "lang", F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"))


def classify(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, alphabet: Alphabet = BYTES, most: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) of every row."""
    spark = documents.sparkSession
    trusted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    # as a merge join at every size: the list of trusted documents grows with the corpus
    texts = documents.select("doc_id", "text").join(trusted.hint("shuffle_merge"), "doc_id", "left_semi")
    counts = save(spark, count_grams(texts.where(~held_out("doc_id", FOLD, 0)), alphabet), "grams")
    if counts.isEmpty():
        discard(counts)
        counts = save(spark, count_grams(texts, alphabet), "grams")
    shares = save(spark, kneser_ney(counts, alphabet), "shares")
    model = save(spark, interpolated(shares, alphabet), "model")
    discard(counts, shares)
    score = score_by_lookup if model.count() <= most else score_by_joins
    scored = save(spark, score(documents, model, alphabet), "perplexity")
    discard(model)
    known = scored.join(trusted, "doc_id", "left_semi").where("perplexity IS NOT NULL")
    apart = held_out("doc_id", FOLD, 0)
    at = lambda c, q: F.percentile_approx(c, q, 10000)
    inside, outside = F.when(~apart, F.col("perplexity")), F.when(apart, F.col("perplexity"))
    # greatest() passes over a null, where no document stayed out or none was counted
    limit_of = F.coalesce(at(inside, quantile), at(F.col("perplexity"), quantile)) * F.greatest(F.lit(1.0), at(outside, 0.5) / at(inside, 0.5))
    by_lang = save(spark, known.where("lang IS NOT NULL").groupBy("lang").agg(limit_of.alias("own")), "thresholds")
    overall = known.agg(limit_of.alias("overall")).first()["overall"]
    # one row a language: broadcast, so that a language of most documents isn't one task's; more languages than that have none so large
    few = by_lang.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    joined = scored.join(F.broadcast(by_lang) if few else by_lang, "lang", "left")
    limit = F.coalesce("own", F.lit(float("inf") if overall is None else overall))
    return joined.select("doc_id", "lang", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))


@owner
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
