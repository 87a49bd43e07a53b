"""Mixing sources to target weights by entropy balancing.

Each source has a target of tokens. Among all rates of its documents that meet it, entropy balancing takes those nearest to 1
(least relative entropy, no rate above MOST): rate = min(MOST, exp(l * size / mean size)), an exponential tilt with one
multiplier l a source. l solves the convex dual, whose slope is the source's tokens at these rates less its target.

1. Sizes are counted once from the texts; all that follows reads (source, size, part) and how many documents each has.
2. Targets share all tokens by weight; one that would be above MOST times its source's tokens stops there and the excess is shared again.
3. Newton's steps for all sources at once: each is one aggregation over (source, size), and a bracket around each root
   takes over where a step would leave it. Sums are decimals, so their order doesn't matter and reruns agree to the bit.
4. Rounding: a source's sizes in descending order, each cell (source, size) gets the whole number of copies that brings the
   source's words nearest to what its rates give so far; what is left over goes on to the next, smaller size. So the source's total
   misses its target by about its smallest documents. A cell's copies are dealt evenly to its documents, in order of a hash of the id;
   parts by that hash keep a cell of very many documents (copies, empty texts) from being ranked in one task.

Weights repeat along the sources in code-point order, a null source last. A null text has size 0; its documents, and those of blank
texts, take nothing. A null id is an id like others; rows of one id and size are dealt copies each for itself. Without words all
targets are 0. Other columns don't matter. An empty table gives no row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import discard, in_task, save, shuffle_width, table

WEIGHTS = (5, 2, 1)
MOST = 3
_ROUNDS = 100
#: Documents of a part at most, where one cell holds a third of all.
_PART = 30_000


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, key, size) of every document; key: the source, never null."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return documents.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), size.alias("size"))


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their number in code-point order, null last: ranges are sorted, and each range starts where those before it end."""
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    ranged = save(spark, ranged.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "ranged")
    before, starts = 0, []
    for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("range").collect():  # one row a range
        starts.append((r["range"], before - r["first"]))
        before += r["n"]
    shift = spark.createDataFrame(starts, "range int, shift long")
    out = save(spark, ranged.join(shift, "range").select("source", "key", "words", "docs", (F.col("at") + F.col("shift")).alias("number")), "numbered")
    discard(ranged)
    return out


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Sources (key, words, docs, number) with their target. Two numbers a round reach the driver."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    limit = (most * F.col("words")).cast("double")
    first = sources.agg(F.sum("words").alias("words"), F.sum(weight).alias("weight")).first()
    total, rest, shared, stopped = first["words"] or 0, first["words"] or 0, first["weight"] or 1.0, -1
    while True:
        above = weight * F.lit(float(rest)) / F.lit(shared) >= limit
        now = sources.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, most * F.col("words"))).alias("words"), F.sum(F.when(~above, weight)).alias("weight")).first()
        if now["n"] == stopped or not now["weight"]:
            break
        stopped, rest, shared = now["n"], total - (now["words"] or 0), now["weight"]
    full = above if total else F.lit(True)
    return sources.select("key", "words", "docs", full.alias("full"), F.when(full, limit).otherwise(weight * F.lit(float(rest)) / F.lit(shared)).alias("target"))


def rate(size, tilt, mean, most: int = MOST):
    return F.least(F.lit(float(most)), F.exp(tilt * size / mean))


def balance(counts: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """Sources with their multiplier `tilt`: Newton's iterations over counts (key, size, n), all sources at once."""
    spark = sources.sparkSession
    # sources at their limit take all copies of everything; those without words take none
    idle = F.col("full") | (F.col("words") == 0)
    mean = F.col("words") / F.greatest(F.col("docs"), F.lit(1))
    state = save(spark, sources.select("key", "words", "full", "target", mean.alias("mean"), F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), (~idle).alias("open")), "tilts")
    size, n = F.col("size"), F.col("n")
    for round_ in range(_ROUNDS):
        if state.where("open").isEmpty():
            break
        now = rate(size, F.col("tilt"), F.col("mean"), most)
        words = n * size * now
        slope = F.when(now < most, words * size / F.col("mean")).otherwise(0.0)
        exact = lambda x: F.sum(x.cast("decimal(34,6)")).cast("double")
        sums = counts.join(state.where("open").select("key", "tilt", "mean"), "key").groupBy("key").agg(exact(words).alias("sum"), exact(slope).alias("slope"))
        miss = F.col("sum") - F.col("target")
        near = F.abs(miss) <= F.greatest(F.lit(0.01), 1e-12 * F.col("target"))
        lo, hi = F.when(miss < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(miss < 0, F.col("hi")).otherwise(F.col("tilt"))
        stepped = state.join(sums, "key", "left").select("key", "words", "full", "target", "mean", "tilt", lo.alias("lo"), hi.alias("hi"), (F.col("tilt") - miss / F.col("slope")).alias("newton"), (F.col("open") & ~near).alias("open"))
        bounded = (F.col("lo") > float("-inf")) & (F.col("hi") < float("inf"))
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        # every third step of a bracketed root halves its bracket, so that it ends whatever Newton's steps do
        outward = F.when(F.col("hi") < float("inf"), F.col("tilt") - 1 - F.abs("tilt")).otherwise(F.col("tilt") + 1 + F.abs("tilt"))
        halved = F.when(bounded, (F.col("lo") + F.col("hi")) / 2).otherwise(outward)
        nxt = F.when(inside & (~bounded | F.lit(round_ % 3 != 2)), F.col("newton")).otherwise(halved)
        spent = bounded & ((nxt <= F.col("lo")) | (nxt >= F.col("hi")))
        new = stepped.select("key", "words", "full", "target", "mean", F.when(F.col("open"), nxt).otherwise(F.col("tilt")).alias("tilt"), "lo", "hi", (F.col("open") & ~spent).alias("open"))
        new = save(spark, new, "tilts")
        discard(state)
        state = new
    return state


def rounded(cells: DataFrame, most: int = MOST) -> DataFrame:
    """Cells (key, size, n, rate) with `copies`: one pass over each source's sizes, largest first, that carries the words left over."""
    shape = "key string, size long, n long, copies long"

    def run(batches):
        source, over = None, 0.0
        for batch in batches:
            copies = []
            for key, size, n, r in zip(*(c.to_pylist() for c in batch.columns)):
                if key != source:
                    source, over = key, 0.0
                if not size:
                    copies.append(0)
                    continue
                want = over + n * size * r
                least = int(r)
                k = min(max(round(want / size), least * n), min(least + (r > least), most) * n)
                over = want - k * size
                copies.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(copies, pa.int64())], names=["key", "size", "n", "copies"])

    order = cells.select("key", F.col("size").cast("long").alias("size"), F.col("n").cast("long").alias("n"), "rate")
    return order.repartition(shuffle_width(cells.sparkSession), "key").sortWithinPartitions("key", F.desc("size")).mapInArrow(in_task(run), shape)


def mix(documents: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of (doc_id, text, source)."""
    spark = documents.sparkSession
    sized = save(spark, sizes(documents), "sizes")
    parts = max(16, sized.count() // (3 * _PART))
    sized_in = sized.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(parts)).cast("int"))
    dealt = save(spark, sized_in.groupBy("source", "key", "size", "part").agg(F.count("*").alias("n")), "parts")
    counts = save(spark, dealt.groupBy("source", "key", "size").agg(F.sum("n").alias("n")), "counts")
    sources = numbered(counts.groupBy("source", "key").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs")))
    aimed = save(spark, targets(sources, weights, most), "targets")
    tilts = balance(counts, aimed, most)
    own = F.when(F.col("full"), F.lit(float(most))).otherwise(rate(F.col("size"), F.col("tilt"), F.col("mean"), most))
    cells = rounded(counts.join(tilts.where("words > 0").select("key", "full", "tilt", "mean"), "key").withColumn("rate", own), most)
    # a cell's copies by its parts: all documents alike, and the copies left over in proportion
    upto = F.sum("n").over(Window.partitionBy("key", "size").orderBy("part"))
    met = dealt.join(cells.select("key", "size", F.col("n").alias("all"), "copies"), ["key", "size"], "left").withColumn("upto", upto)
    left = F.coalesce(F.col("copies"), F.lit(0)) % F.coalesce(F.col("all"), F.lit(1))
    share = lambda x: F.floor(left.cast("decimal(20,0)") * x / F.col("all")).cast("long")
    quota = met.select("key", "size", "part", F.coalesce(F.floor(F.col("copies") / F.col("all")), F.lit(0)).alias("each"), F.coalesce(share(F.col("upto")) - share(F.col("upto") - F.col("n")), F.lit(0)).alias("more"))
    quota = save(spark, quota.join(aimed.select("key", F.col("words").alias("source_size"), "target"), "key"), "quotas")
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id"))
    out = sized_in.join(quota, ["key", "size", "part"]).withColumn("rank", rank)
    taken = F.col("size") * (F.col("each") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0))
    out = save(spark, out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken")), "mix")
    discard(sized, dealt, counts, sources, aimed, tilts, quota)
    return out


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
