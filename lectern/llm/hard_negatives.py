"""Hard negatives: for each anchor and each of its nearest rows of the same label, the best rows of other labels in a window of scores.

All rows are scored against all anchors in cells of row part x anchor block: a task holds one block of at most some
thousand anchors, and rows stream by it. What leaves a cell is only what can be among an anchor's first:

1. Positives: the first few rows of the anchor's label out of each batch of rows.
2. Negatives: with the positives known, the first few rows of other labels in each positive's window, out of each batch.
3. The secondary sort: each is packed into a binary key (anchor, descending score, positives before negatives, id), dealt by its
   anchor and sorted within partitions (repartition and sortWithinPartitions, the DataFrame form of
   repartitionAndSortWithinPartitions). One pass over the keys opens a window at each positive and emits the negatives
   that follow into the windows that are open and not full: its state is the windows of one anchor.

A window lies below its positive's score, so its negatives come behind it in the order.

Rows with a null id, label or vector, or any null or non-finite component take no part. Only vectors of one length have a
score together. A row that stands twice with the same id, label and vector is one row; rows of one id that differ are rows of their own, and
such anchors mine each for itself. Scores are exact; one that a long can't hold is held at the long's end. Other columns don't matter.
An empty table, or one without anchors, gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import discard, in_task, save, shuffle_width, table

#: Anchors of a block, on average.
BLOCK = 2048
#: Scores that a task holds at once.
_SCORES = 400_000
_KEY = 41  # bytes: anchor and its row's hash, score, kind, id and its row's hash
_SIGN = np.uint64(1 << 63)


def usable(embeddings: DataFrame) -> DataFrame:
    """(id, h, label, x) of the rows that take part; h tells rows of one id apart."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.xxhash64("embedding", F.col("label").cast("long")).alias("h"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("x"))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows, exact: as doubles where no sum leaves their exact range, else as Python's integers."""
    bound = np.sqrt((a * a).sum(1).max(initial=0)) * np.sqrt((b * b).sum(1).max(initial=0))
    if bound < 2**52:
        return a @ b.T
    exact = np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) @ np.array([[int(v) for v in r] for r in b], object).reshape(b.shape).T
    return np.minimum(np.maximum(exact, -(2**63)), 2**63 - 1)


def first_of_each(values: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed values of each row; the smaller column first on ties."""
    if values.dtype != object and values.shape[1] > 4 * k:
        masked = np.where(allowed, values, -np.inf)
        least = np.partition(masked, -k, axis=1)[:, -k]
        allowed = allowed & (values >= least[:, None])
    row, column = np.nonzero(allowed)
    if values.dtype == object:
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -values[row[i], column[i]], column[i])), np.int64)
    else:
        order = np.lexsort((column, -values[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


def pack(anchor, anchor_h, score, negative: bool, ids, h) -> pa.Array:
    """Keys that sort bytewise by anchor, descending score, kind and id."""
    n = len(anchor)
    out = np.empty((n, _KEY), np.uint8)

    def put(at, x):
        out[:, at : at + 8] = x.astype(">u8").view(np.uint8).reshape(n, 8)

    up = lambda x: np.asarray(x, np.int64).view(np.uint64) ^ _SIGN
    put(0, up(anchor))
    put(8, up(anchor_h))
    put(16, ~up(score))
    out[:, 24] = negative
    put(25, up(ids))
    put(33, up(h))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * _KEY).astype(np.int32)), pa.py_buffer(out.tobytes())])


def unpack(keys: pa.Array) -> tuple[np.ndarray, ...]:
    """(anchor, anchor_h, score, negative, id, h)."""
    x = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(len(keys), _KEY)
    get = lambda at, flip: (np.ascontiguousarray(x[:, at : at + 8]).view(">u8").ravel().astype(np.uint64) ^ flip ^ _SIGN).view(np.int64)
    none, all_ = np.uint64(0), ~np.uint64(0)
    return get(0, none), get(8, none), get(16, all_), x[:, 24].astype(bool), get(25, none), get(33, none)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(256 * np.asarray(column.flatten(), np.float64)).reshape(len(column), -1)


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, parts: int, choose) -> DataFrame:
    """(key) of what `choose` takes from each meeting of a batch of rows with some anchors of a block.

    choose(scores, same, other, bounds): (anchor, column) pairs and whether they are negatives; same and other: which pairs
    of two rows have one label and which don't; bounds: the scores of each anchor's positives.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("id", "h"), F.lit(parts)).cast("int")
    block = F.pmod(F.xxhash64("h", "id"), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("array<long>")
    here = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), block.alias("block"), F.lit(0).alias("kind"), "id", "h", "label", "x", "bounds")
    there = rows.select(part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "h", "label", "x", none.alias("bounds"))
    cells = here.union(there).withColumn("d", F.size("x")).repartition(2 * shuffle_width(spark), "part", "block").sortWithinPartitions("part", "block", "kind")

    def run(batches):
        cell, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            got = pa.Table.from_batches([batch])
            marks = np.stack([np.asarray(got[c]) for c in ("part", "block", "kind")], 1)
            cuts = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(1)))
            for i, j in zip(cuts, np.append(cuts[1:], len(marks))):
                if cell != tuple(marks[i, :2]):
                    cell, held = tuple(marks[i, :2]), []
                if marks[i, 2] == 0:
                    held.append(got.slice(i, j - i))
                elif held:
                    held = [pa.concat_tables(held)]
                    yield from met(held[0], got.slice(i, j - i))

    def met(own: pa.Table, others: pa.Table):
        for d in np.intersect1d(np.asarray(own["d"]), np.asarray(others["d"])):
            a = own.filter(pa.compute.equal(own["d"], int(d)))
            b = others.filter(pa.compute.equal(others["d"], int(d))).sort_by([("id", "ascending"), ("h", "ascending")])
            ids, h, label, x = np.asarray(b["id"]), np.asarray(b["h"]), np.asarray(b["label"]), _matrix(b["x"])
            step = max(1, _SCORES // len(ids))
            for i in range(0, a.num_rows, step):
                some = a.slice(i, step)
                aid, ah = np.asarray(some["id"]), np.asarray(some["h"])
                s = scores(_matrix(some["x"]), x)
                self_ = (aid[:, None] == ids) & (ah[:, None] == h)
                same = np.asarray(some["label"])[:, None] == label
                r, c, negative = choose(s, same & ~self_, ~same, some["bounds"].to_pylist())
                if len(r):
                    yield pa.RecordBatch.from_arrays([pack(aid[r], ah[r], s[r, c].astype(np.int64), negative, ids[c], h[c])], names=["key"])

    return cells.mapInArrow(in_task(run), "key binary")


def _in_order(keys: DataFrame) -> DataFrame:
    """Keys dealt by their anchor and sorted within partitions."""
    return keys.repartition(shuffle_width(keys.sparkSession), F.substring("key", 1, 16)).sortWithinPartitions("key")


def _streamed(positives: int, negatives: int, low: int, high: int, emit_positives: bool):
    """The pass over sorted keys. Emits positives as (id, h, score, key), or negatives as rows of the result."""

    def run(batches):
        anchor, last, windows = None, None, []
        for batch in batches:
            out = []
            for key, a, ah, s, negative, i, h in zip(batch.column(0).to_pylist(), *(c.tolist() for c in unpack(batch.column(0)))):
                if key == last:
                    continue  # a repeated row
                if (a, ah) != anchor:
                    anchor, windows = (a, ah), []
                last = key
                if not negative:
                    if len(windows) < positives:
                        windows.append([i, s, 0])
                        if emit_positives:
                            out.append((a, ah, s, key))
                    continue
                for w in windows:
                    if w[2] < negatives and low * w[1] <= 100 * s <= high * w[1]:
                        w[2] += 1
                        out.append((a, w[0], w[2], i, w[1], s))
            if out:
                columns = list(zip(*out))
                names = ["id", "h", "score", "key"] if emit_positives else ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()] if emit_positives else [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """Negatives of rows (id, h, label, x) for anchors of the same columns; low and high are percent of the positive's score, 0 to 100."""
    spark = rows.sparkSession
    anchors = save(spark, anchors.dropDuplicates(["id", "h"]), "anchors")
    n, asked = rows.count(), anchors.count()
    blocks = max(1, -(-asked // block))
    parts = max(1, -(-n // 16_384), min(4 * shuffle_width(spark), n // 256))

    def nearest(s, same, other, bounds):
        return (*first_of_each(s, same, positives), False)

    def windows(s, same, other, bounds):
        found = []
        for k in range(max(map(len, bounds))):
            # a window without a score lies above all
            lo = np.array([-(-low * b[k] // 100) if k < len(b) and b[k] >= 0 else 2**63 for b in bounds], object)
            hi = np.array([high * b[k] // 100 if k < len(b) and b[k] >= 0 else -1 for b in bounds], object)
            if s.dtype != object:
                lo, hi = lo.astype(float), hi.astype(float)
            found.append(np.stack(first_of_each(s, other & (s >= lo[:, None]) & (s <= hi[:, None]), negatives)))
        row, column = np.unique(np.concatenate(found, axis=1), axis=1)
        return row, column, True

    near = _meet(rows, anchors.withColumn("bounds", F.lit(None).cast("array<long>")), blocks, parts, nearest)
    found = save(spark, _in_order(near).mapInArrow(in_task(_streamed(positives, 0, low, high, True)), "id long, h long, score long, key binary"), "positives")
    bounds = found.groupBy("id", "h").agg(F.collect_list("score").alias("bounds"))
    far = _meet(rows, anchors.join(bounds, ["id", "h"]), blocks, parts, windows)
    out = save(spark, _in_order(far.union(found.select("key"))).mapInArrow(in_task(_streamed(positives, negatives, low, high, False)), RESULT), "negatives")
    discard(anchors, found)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(e.select("vec_id", moved.alias("label"), "embedding"))
    return mine(rows, rows.where(F.col("id") % 100 == 0))
