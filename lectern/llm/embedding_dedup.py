"""Embedding near-dedup: sign hashing in several tables, exact cosine, connected components.

Equal vectors are one vector with a count from the start. Each distinct vector
gets one code of sign bits in each table; vectors that share a code of a table
are compared by their exact cosine in double precision. A pair that meets in
several tables counts in the first of them only. A bucket above BLOCK rows is
cut into parts, and each pair of parts is a group of its own, so no task holds
more than two parts and nothing is dropped. A task passes on, for each vector,
how many vectors it is linked with and one spanning star for each linked group,
not the pairs.

Bits and tables follow the number of distinct vectors: about four vectors a
bucket, and as many tables as give a pair at the threshold RECALL to meet.

Nulls: vectors that are null, zero, or hold null or non-finite components link
with nothing; vectors of different lengths never link. Rows with the same id
are separate vectors: inside, each distinct vector has a number of its own, and
ids come back only as the smallest of a component. Rows with a null id are linked
like others; if a component has no other id, its id is null. Every row of the
table is returned, with its id only: other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import complete_groups, connected_components, discard, group_starts, in_task, local_roots, owner, save, shuffle_width, table

RECALL = 0.998
BLOCK = 1024
_PAIRS = 100_000


def plan_tables(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a code and number of tables for n distinct vectors."""
    bits = min(24, max(6, round(math.log2(max(n, 2))) - 2))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _linked(ids, counts, codes, tables, x, group, first, threshold):
    """Links of the rows of complete groups: rows (id, links, root). group: run number of each row; first: rows of the lower part."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sizes = np.bincount(group)
    begin = np.cumsum(sizes) - sizes
    # each row with all later rows of its group, a bounded number of pairs at a time
    later = begin[group] + sizes[group] - 1 - np.arange(len(group))
    ends = np.cumsum(later)
    links, left, right = np.zeros(len(ids), np.int64), [], []
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PAIRS, side="right")))
        a = np.repeat(np.arange(i, j), later[i:j])
        b = np.arange(len(a)) - np.repeat(ends[i:j] - later[i:j] - (ends[i - 1] if i else 0), later[i:j]) + a + 1
        ok = first[a] | first[b]  # in a pair of unlike parts, only pairs across
        ok &= (first[a] != first[b]) | (first[a] & first[b] & (tables[a] >= 0))
        a, b = a[ok], b[ok]
        if len(a):
            cos = np.einsum("ij,ij->i", unit[a], unit[b])
            near = cos >= threshold
            a, b = a[near], b[near]
            fresh = (codes[a] == codes[b]).argmax(1) == np.abs(tables[a]) - 1
            a, b = a[fresh], b[fresh]
            np.add.at(links, a, counts[b])
            np.add.at(links, b, counts[a])
            left.append(a)
            right.append(b)
        i = j
    if not left:
        return None
    root = local_roots(len(ids), np.concatenate(left), np.concatenate(right))
    some = links > 0
    return ids[some], links[some], ids[root[some]]


def link(embeddings: DataFrame, threshold: float = 0.95, recall: float = RECALL, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    spark = embeddings.sparkSession
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = embeddings.select("vec_id", "embedding", F.coalesce(fine, F.lit(False)).alias("fine"))
    keys = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")]
    kinds = rows.where("fine").select("vec_id", "embedding", *keys).groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    # numbered as they are written: ids may repeat among unlike vectors, these numbers can't
    distinct = save(spark, kinds.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    about = distinct.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    members = rows.select("vec_id", "fine", *keys)
    if not about["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits, tables = plan_tables(about["n"], threshold, recall)
    planes = np.random.default_rng(seed).standard_normal((about["d"], tables * bits))

    def hashed(batches):
        weights = 1 << np.arange(bits)
        for batch in batches:
            size = np.asarray(pa.compute.list_value_length(batch.column(2)))
            codes = np.zeros((len(size), tables), np.int64)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = _vectors(batch.column(2).take(pa.array(at)))
                codes[at] = ((x @ planes[:d]) > 0).reshape(len(at), tables, bits) @ weights
            flat = pa.array(codes.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * tables), flat)], names=["rep", "n", "embedding", "codes"])

    kind = dict(distinct.dtypes)["embedding"]
    coded = distinct.select("rep", "n", "embedding").mapInArrow(in_task(hashed), f"rep long, n long, embedding {kind}, codes array<int>")
    coded = save(spark, coded.withColumn("d", F.size("embedding")), "codes")
    slots = coded.select("d", "rep", F.posexplode("codes").alias("t", "code"))
    large = slots.groupBy("d", "t", "code").agg(F.count("*").alias("m")).where(F.col("m") > block).select("d", "t", "code", F.ceil(F.col("m") / block).cast("int").alias("parts"))
    # ids and codes alone meet the large buckets; vectors follow once each row has its groups
    placed = (
        coded.select("*", F.posexplode("codes").alias("t", "code"))
        .join(large, ["d", "t", "code"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("d", "t", "code", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("low"), "rep", "n", "codes", "embedding")
    )
    width = max(shuffle_width(spark), 8) * 2
    dealt = placed.repartition(width, "d", "t", "code", "i", "j").sortWithinPartitions("d", "t", "code", "i", "j")

    def compared(batches):
        for part in complete_groups(batches, ["d", "t", "code", "i", "j"]):
            new = np.zeros(part.num_rows, np.int64)
            new[group_starts(part, ["d", "t", "code", "i", "j"])] = 1
            group = np.cumsum(new) - 1
            size, t, i, j = (np.asarray(part[c]).astype(np.int64) for c in ("d", "t", "i", "j"))
            # rows of a part met with itself are all "low"; tables < 0 marks groups of two unlike parts
            signed_table = np.where(i == j, t + 1, -(t + 1))
            low = part["low"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                sub = part.take(pa.array(at))
                found = _linked(np.asarray(sub["rep"]), np.asarray(sub["n"]), _vectors(sub["codes"]).astype(np.int64), signed_table[at], _vectors(sub["embedding"]), group[at] - group[at[0]], low[at], threshold)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["rep", "links", "root"])

    found = save(spark, dealt.mapInArrow(in_task(compared), "rep long, links long, root long"), "links")
    components = connected_components(spark, found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "components")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    placed_in = distinct.select("k1", "k2", "rep", "n", "least").join(links, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    placed_in = save(spark, placed_in.withColumn("component", F.coalesce("component", "rep")).select("k1", "k2", "n", "least", "links", "component"), "placed")
    discard(coded, found, components, distinct)
    named = placed_in.groupBy("component").agg(F.min("least").alias("id"))
    whole = placed_in.join(named, "component").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.col("id").alias("component"), F.lit(True).alias("fine"))
    return members.join(whole, ["k1", "k2", "fine"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


@owner
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
