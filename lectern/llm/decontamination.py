"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

DataFrame functions only.

* Texts become words (runs of letters and digits, lower case) and 5-word shingles.
* A window of a document has as many words as a benchmark item; a document of
  fewer words is one window. A window reaches the similarity only if the shingles
  that it shares with the item weigh that part of the item at least. So, from each
  place where a shingle of an item stands, its weight is added to all windows over
  it, and windows whose sum falls short are left out: no window that qualifies is,
  and the work is linear in the shared places.
* Each window left and each item gets a 64-bit SimHash of its weighted shingles.
  Shingles count by the root of their weight there: the cosine of two such vectors
  is the shared weight over the mean of both, 0.889 at least where the similarity is 0.8, however
  unequal the weights, so a bit differs with probability 0.152 at most and more than RADIUS of 64 bits once in 28,000.
  With RADIUS + 1 blocks, two fingerprints within RADIUS agree in a block at least:
  a window meets the items that it shares enough weight with by block, all pairs within the radius.
* Of these, the exact weighted Jaccard similarity decides: a shingle weighs its
  length in characters, times its count.

Nulls: a null or empty text has no words; items or documents of fewer than five
words match nothing, nor do documents with a null id. Rows with equal ids are told
apart by nothing but their text; the best window of an id and item is reported
once. Other columns don't matter and go through decontaminate as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import discard, quoted, save, table

SHINGLE = 5
SIMILARITY = 0.8
#: A window of similarity 0.8 is ten bits away at most, on average.
RADIUS = 22
#: Item tables up to so many shingles are broadcast; larger ones are joined by shuffles.
BROADCAST_SHINGLES = 200_000
#: Documents with a shared shingle, up to so many, are found again by a broadcast of their ids.
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(w: str, size: int = SHINGLE) -> Column:
    """Hashes of all shingles of an array column of words, by position."""
    parts = ", ".join(f"{w}[i + {j}]" for j in range(size))
    return F.expr(f"CASE WHEN size({w}) >= {size} THEN transform(sequence(0, size({w}) - {size}), i -> xxhash64({parts})) ELSE array() END").cast("array<bigint>")


def weighted_shingles(w: str, size: int = SHINGLE) -> Column:
    parts = ", ".join(f"{w}[i + {j}]" for j in range(size))
    chars = " + ".join(f"length({w}[i + {j}])" for j in range(size))
    return F.expr(f"transform(sequence(0, size({w}) - {size}), i -> named_struct('h', xxhash64({parts}), 'w', CAST({chars} AS BIGINT)))")


def simhash(shingles: str) -> Column:
    """64 sign bits of the sum of the shingles' hash bits, each by the root of its weight."""
    roots = f"transform({shingles}, x -> named_struct('h', x.h, 'w', CAST(round(1000 * sqrt(x.w)) AS BIGINT)))"
    # the one-element array binds the roots, so that they are taken once for all bits
    return F.expr(
        f"transform(array({roots}), r -> aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(CAST(aggregate(r, 0L, (s, x) -> s + IF((shiftright(x.h, b) & 1L) = 1L, x.w, -x.w)) > 0 AS BIGINT), b)))[0]"
    )


def fingerprint_blocks(fingerprint: str, radius: int) -> Column:
    """(block, value) of radius + 1 blocks that have all 64 bits between them."""
    n = radius + 1
    bounds = [64 * k // n for k in range(n + 1)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.expr(f"shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L").alias("value")) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))])


def find(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the best window of each document and item that reaches the similarity."""
    spark = documents.sparkSession
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE)
    items = save(
        spark,
        items.select("item_id", F.size("w").alias("n"), weighted_shingles("w").alias("shingles")).withColumn("fingerprint", simhash("shingles")),
        "items",
    )
    marks = items.select("item_id", "n", F.expr("aggregate(shingles, 0L, (s, x) -> s + x.w)").alias("total"), F.explode("shingles").alias("x")).select("item_id", "n", "total", "x.h", "x.w")
    if marks.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES:
        marks = F.broadcast(marks)
    shared = (
        documents.select("doc_id", words(F.col("text")).alias("w"))
        .select("doc_id", F.size("w").alias("size"), shingle_hashes("w").alias("hashes"))
        .select("doc_id", "size", F.posexplode_outer("hashes").alias("i", "h"))  # outer: else a filter on the hashes is inferred, pushed down and computes them again
        .join(marks, "h")
        .select("doc_id", "size", "item_id", "n", "total", "i", "w")
    )
    shared = save(spark, shared, "shared")
    enough = F.sum("w") >= similarity * F.first("total")
    able = shared.groupBy("doc_id", "item_id").agg(enough.alias("enough")).where("enough").select("doc_id", "item_id")
    # the windows of an item's size over the place i
    over = F.sequence(F.greatest(F.lit(0), F.col("i") - F.col("n") + SHINGLE), F.greatest(F.lit(0), F.least(F.col("i"), F.col("size") - F.col("n"))))
    seeds = (
        shared.join(able, ["doc_id", "item_id"], "left_semi")
        .select("doc_id", "item_id", "n", "total", "w", F.explode(over).alias("start"))
        .groupBy("doc_id", "item_id", "n", "start")
        .agg(enough.alias("enough"))
        .where("enough")
        .select("doc_id", "item_id", "n", "start")
    )
    seeds = save(spark, seeds, "seeds")
    discard(shared)
    ids = seeds.select("doc_id").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = documents.select("doc_id", "text").join(ids, "doc_id", "left_semi").distinct()
    # the words of a document travel with its own windows only
    # the one-element array binds the words, so that they are split once for all windows of a document
    cut = F.flatten(
        F.transform(
            F.array(words(F.col("text"))),
            lambda w: F.transform(
                # n is the item's size, also of a window that is a whole shorter document
                F.filter("windows", lambda at: (at.start + at.n <= F.size(w)) | ((at.start == 0) & (F.size(w) >= SHINGLE))),
                lambda at: F.struct(at.n.alias("n"), at.start.alias("start"), F.slice(w, at.start + 1, at.n).alias("w")),
            ),
        )
    )
    windows = (
        texts.join(seeds.groupBy("doc_id").agg(F.collect_set(F.struct("n", "start")).alias("windows")), "doc_id")
        .select("doc_id", F.explode_outer(cut).alias("x"))
        .where("x IS NOT NULL")
        .select("doc_id", "x.n", "x.start", weighted_shingles("x.w").alias("shingles"))
        .withColumn("fingerprint", simhash("shingles"))
    )
    windows = save(spark, windows, "windows")
    # a window is held only against items whose shingles it shares, not against all of one size
    near = (
        windows.select("doc_id", "n", "start", "fingerprint")
        .join(seeds, ["doc_id", "n", "start"])
        .select("doc_id", "item_id", "n", "start", "fingerprint", F.explode(fingerprint_blocks("fingerprint", radius)).alias("b"))
        .select("doc_id", "item_id", "n", "start", "fingerprint", "b.block", "b.value")
        .join(items.select("item_id", "n", F.col("fingerprint").alias("own"), F.explode(fingerprint_blocks("fingerprint", radius)).alias("b")).select("item_id", "n", "own", "b.block", "b.value"), ["item_id", "n", "block", "value"])
        .withColumn("hamming", F.expr("bit_count(fingerprint ^ own)"))
        .where(F.col("hamming") <= radius)
        .select("doc_id", "n", "start", "item_id", "hamming")
        .distinct()
    )
    sums = "aggregate({0}, 0L, (s, x) -> s + x.w)"
    # a shingle that stands k times in one and m times in the other counts min(k, m) times
    shared = "aggregate(array_distinct(theirs), 0L, (s, x) -> s + x.w * least(size(filter(theirs, y -> y.h = x.h)), size(filter(shingles, y -> y.h = x.h))))"
    found = (
        near.join(windows.select("doc_id", "n", "start", "shingles"), ["doc_id", "n", "start"])
        .join(items.select("item_id", F.col("shingles").alias("theirs")), "item_id")
        .withColumn("shared", F.expr(shared))
        .withColumn("similarity", F.expr(f"shared / ({sums.format('shingles')} + {sums.format('theirs')} - shared)"))
        .where(F.col("similarity") >= similarity)
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct(F.col("start").cast("long").alias("start_word"), (F.size("shingles") + SHINGLE - 1).cast("long").alias("n_words"), F.col("hamming").cast("int").alias("hamming"), "similarity"), F.struct("similarity", -F.col("start"))).alias("best"))
        .select("doc_id", "item_id", "best.*")
    )
    out = save(spark, found, "matches")
    discard(items, seeds, windows)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; documents with null ids stay."""
    return documents.join(find(documents, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*quoted(documents.columns))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
