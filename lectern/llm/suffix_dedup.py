"""Suffix-array dedup: every byte that a repeated string of LENGTH bytes covers is removed.

Blockwise, so that no task sorts more than its suffix buckets:

1. Each suffix is placed in a bucket by its anchor: among the GRAM-byte hashes of its
   first WINDOW bytes the least. Equal strings of LENGTH bytes have their anchor at
   the same place, so a bucket is an anchor string (what all its suffixes share) and
   suffixes of unlike buckets never match. A run of neighbouring suffixes of one anchor
   is a context; contexts, not suffixes, go through the shuffles.
2. A bucket with one context holds no repetition, and all suffixes of a context that
   stands twice are repeated. Only the other contexts, one of each kind, bring
   their bytes to a task.
3. There one bucket is sorted at a time: suffixes by their first V - 1 and last V of
   LENGTH bytes, and ties by the precomputed ranks of the difference cover's samples:
   for any two suffixes some d < V takes both to a sample, whose rank stands for the
   LENGTH - V + 1 bytes between. Ties are split by three-way partitions, all groups at once.
4. Buckets of more than LARGE contexts are dealt by suffix fingerprints instead:
   exact as well, and evenly spread however many contexts share an anchor.

Fingerprints are 64 bits (128 in step 4). Ranks are in the order of the samples' bytes:
suffixes are held against a pivot at offsets that differ from one to the next, and only
an order of the strings themselves puts equal suffixes on the same side at each.

Strings count wherever they start in any document, the same included; matches
never cross documents. Nulls: a null text is empty. Rows are told apart by id
and text; equal rows are repetitions of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import complete_groups, discard, group_starts, in_task, mix, owner, prefix_hash, save, shuffle_width, signed, slices, span_hash, table, text_bytes

LENGTH = 400
WINDOW = 180
GRAM = 32
#: A difference cover: every residue of 57 is a difference of two of these. Fixed values.
V = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
LARGE = 4096
_BLOCK_BYTES = 1_500_000


def _cover_steps() -> np.ndarray:
    """d for two residues: both residues plus d are in the cover."""
    inside = np.zeros(V, bool)
    inside[list(COVER)] = True
    d = np.arange(V)
    both = inside[(np.arange(V)[:, None, None] + d) % V] & inside[(np.arange(V)[None, :, None] + d) % V]
    assert both.any(2).all()
    return both.argmax(2)


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, window: int, gram: int):
    """(row, first, last, anchor, key, context) of the runs of suffixes with one anchor; places within the row."""
    n = len(data)
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    bits = np.uint64(max(1, int(n).bit_length()))
    place = np.full(-(-(n + window) // window) * window, np.iinfo(np.uint64).max)
    place[: len(at)] = (span_hash(prefix, at, at + gram) >> bits << bits) | at.astype(np.uint64)
    grid = place.reshape(-1, window)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(at)], before[window - 1 : window - 1 + len(at)])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    count = np.maximum(sizes - length + 1, 0)
    if not count.sum():
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    row = np.repeat(np.arange(len(sizes)), count)
    p = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + offsets[row]
    a = anchor[p]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])]))
    first, last = p[new], p[np.append(new[1:], len(p)) - 1]
    row, a = row[new], a[new]
    key = span_hash(prefix, a, a + (length - window))
    context = mix(span_hash(prefix, first, last + length) + (a - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, first - offsets[row], last - offsets[row], a - offsets[row], key, context


def byte_ranks(body: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Rank of each body[p : p + length], p in `at`, in the order of bytes; the strings must be distinct."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    order, group, start = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    rank = np.zeros(len(at), np.int64)
    for step in range(0, length, 8):  # only strings with equal bytes before are looked at again
        width = min(8, length - step)
        word = padded[(at[order] + step)[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64) >> np.uint64(8 * (8 - width))
        nxt = np.lexsort((word, group))
        order, group, word = order[nxt], group[nxt], word[nxt]
        base = start[nxt]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])])
        first = np.concatenate([[True], group[1:] != group[:-1]])
        k = np.arange(len(order))
        # a string's rank: that of its group and its part's place there
        start = base + np.maximum.accumulate(np.where(new, k, 0)) - np.maximum.accumulate(np.where(first, k, 0))
        rank[order] = start
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        order, group, start = order[many], group[many], start[many]
        if not len(order):
            break
    return rank


def repeated(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, back: np.ndarray, runs: np.ndarray, bucket: np.ndarray, length: int):
    """(context, place) of each suffix, and whether another context of its bucket has its first `length` bytes.

    Contexts are body[start:end]; back: the anchor's place in each; runs: its number of suffixes.
    """
    which = np.repeat(np.arange(len(starts)), runs)
    place = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = starts[which] + place
    prefix = prefix_hash(body)
    tail = mix(span_hash(prefix, at + length - V, at + length))
    head = mix(span_hash(prefix, at, at + V - 1) + tail + bucket[which].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (back[which] - place).astype(np.uint64))
    # groups of equal heads
    order = np.argsort(head, kind="stable")
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(head[order][1:] != head[order][:-1])
    # the cover's samples behind the starts of tied suffixes, and their ranks, for the whole block at once
    tied = at[order[np.bincount(group)[group] > 1]] if len(order) else order
    edge = np.bincount(tied, minlength=len(body) + V) - np.bincount(tied + V, minlength=len(body) + V)[: len(body) + V]
    sample = np.flatnonzero((np.cumsum(edge)[: len(body)] > 0) & np.isin(np.arange(len(body)) % V, COVER))
    sample = sample[sample + length - V + 1 <= len(body)]
    rank = np.zeros(len(body), np.int64)
    if len(sample):
        _, one, same = np.unique(span_hash(prefix, sample, sample + length - V + 1), return_index=True, return_inverse=True)
        rank[sample] = byte_ranks(body, sample[one], length - V + 1)[same]
    steps = _cover_steps()
    # three-way partitions until every group is one string
    found = np.zeros(len(which), bool)
    while len(order):
        size = np.bincount(group)
        many = size[group] > 1
        order, group = order[many], group[many]
        if not len(order):
            break
        group = np.unique(group, return_inverse=True)[1]
        size = np.bincount(group)
        pivot = order[np.cumsum(size) - size + size // 2][group]
        x, y = at[order], at[pivot]
        d = steps[x % V, y % V]
        side = np.sign(rank[x + d] - rank[y + d])
        same = side == 0
        alike = np.bincount(group, same) > 1
        found[order[same & alike[group]]] = True
        order, group, side = order[~same], group[~same], side[~same]
        nxt = np.argsort(group * 2 + (side > 0), kind="stable")
        order, group = order[nxt], (group * 2 + (side > 0))[nxt]
    return which, place, found


def row_id():
    """A row's identity by id and text, the same in every scan; equal rows share it, and all their bytes are repeated anyway."""
    return F.xxhash64("doc_id", "text")


def repeats(documents: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """(row_id, first, last): places, from first to last, where repeated strings of `length` bytes start; documents need (row_id, text)."""
    spark = documents.sparkSession

    def cut(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0)
            for i, j in slices(offsets):
                row, first, last, anchor, key, context = contexts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, window, gram)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + i)), *[pa.array(c.astype(np.int32)) for c in (first, last, anchor)], pa.array(signed(key)), pa.array(signed(context))], names=["row_id", "first", "last", "anchor", "key", "context"])

    runs = save(spark, documents.select("row_id", "text").mapInArrow(in_task(cut), "row_id long, first int, last int, anchor int, key long, context long"), "runs")
    kinds = runs.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "first", "last", "anchor")).alias("one"))
    buckets = kinds.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("all > 1")
    kinds = save(spark, kinds.join(buckets.select("key", "m"), "key"), "kinds")
    whole = runs.join(kinds.where("n > 1").select("key", "context"), ["key", "context"]).select("row_id", "first", "last")
    # one of each kind of context of a bucket with several, with its bytes
    wanted = kinds.where("m > 1").select("key", "n", F.col("m").alias("bucket_size"), "one.*")
    by_row = wanted.groupBy("row_id").agg(F.collect_list(F.struct("key", "n", "bucket_size", "first", "last", "anchor")).alias("wanted"))
    kind = "key long, n long, bucket_size long, row_id long, first int, last int, anchor int, body binary"

    def bodies(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            first, last = np.asarray(flat.field("first")), np.asarray(flat.field("last"))
            for lo in range(0, len(row), 10_000):
                at = slice(lo, lo + 10_000)
                found = [data[offsets[r] + f : offsets[r] + e + length].tobytes() for r, f, e in zip(row[at], first[at], last[at])]
                part = flat.slice(lo, 10_000)
                yield pa.RecordBatch.from_arrays([part.field("key"), part.field("n"), part.field("bucket_size"), batch.column(0).take(pa.array(row[at])), part.field("first"), part.field("last"), part.field("anchor"), pa.array(found, pa.binary())], names=["key", "n", "bucket_size", "row_id", "first", "last", "anchor", "body"])

    dealt = documents.select("row_id", "text").join(by_row, "row_id").mapInArrow(in_task(bodies), kind)
    cuts = save(spark, dealt, "contexts")

    def sort(batches):
        for part in complete_groups(batches, ["key"]):
            starts = np.append(group_starts(part, ["key"]), part.num_rows)
            size = np.asarray(part["last"]) - np.asarray(part["first"]) + length
            held, total = 0, 0
            for k in range(len(starts) - 1):  # whole buckets, of bounded bytes together
                total += int(size[starts[k] : starts[k + 1]].sum())
                if total >= _BLOCK_BYTES or k == len(starts) - 2:
                    yield from solve(part.slice(starts[held], starts[k + 1] - starts[held]))
                    held, total = k + 1, 0

    def solve(part: pa.Table):
        body, at = text_bytes(part["body"])
        first, last, anchor, n = (np.asarray(part[c]).astype(np.int64) for c in ("first", "last", "anchor", "n"))
        which, place, found = repeated(body, at[:-1], at[1:], anchor - first, last - first + 1, np.asarray(part["key"]), length)
        found &= n[which] == 1  # contexts that stand twice are repeated as a whole already
        at = np.flatnonzero(found)
        if len(at):
            gap = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(which[at]) > 0)])
            begin, end = at[gap], at[np.append(np.flatnonzero(gap)[1:], len(at)) - 1]
            base = first[which[begin]]
            yield pa.RecordBatch.from_arrays([part["row_id"].combine_chunks().take(pa.array(which[begin])), pa.array((base + place[begin]).astype(np.int32)), pa.array((base + place[end]).astype(np.int32))], names=["row_id", "first", "last"])

    width = max(8, shuffle_width(spark)) * 2
    result = "row_id long, first int, last int"
    partly = cuts.where(F.col("bucket_size") <= large).repartition(width, "key").sortWithinPartitions("key").mapInArrow(in_task(sort), result)

    def fingerprints(batches):
        for batch in batches:
            body, at = text_bytes(batch.column(7))
            first, last, n = (np.asarray(batch.column(c)).astype(np.int64) for c in (4, 5, 1))
            run = last - first + 1
            which = np.repeat(np.arange(len(run)), run)
            place = np.arange(len(which)) - np.repeat(np.cumsum(run) - run, run)
            for lo in range(0, len(which), 500_000):
                w, q = which[lo : lo + 500_000], place[lo : lo + 500_000]
                p = prefix_hash(body)
                s = at[w] + q
                h = span_hash(p, s, s + length)
                g = mix(span_hash(p, s, s + length // 2) + np.uint64(3) * span_hash(p, s + length // 2, s + length))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(g)), pa.array(n[w]), batch.column(3).take(pa.array(w)), pa.array((first[w] + q).astype(np.int32))], names=["h", "g", "n", "row_id", "first"])

    each = cuts.where(F.col("bucket_size") > large).mapInArrow(in_task(fingerprints), "h long, g long, n long, row_id long, first int")
    often = each.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    spread = each.where("n = 1").join(often, ["h", "g"]).select("row_id", "first", F.col("first").alias("last"))
    return whole.unionByName(partly).unionByName(spread)


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row_id, doc_id, n_bytes, n_removed, n_spans, kept): kept are the remaining bytes of each text."""
    spark = documents.sparkSession
    found = save(spark, repeats(documents, length), "repeats")
    by_row = found.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))

    def strip(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            out = {"n_removed": [], "n_spans": [], "kept": []}
            spans = batch.column(3)
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                if not spans[k].is_valid:
                    out["n_removed"].append(0), out["n_spans"].append(0), out["kept"].append(text.tobytes())
                    continue
                own = spans[k].values
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, np.asarray(own.field("first")), 1)
                np.add.at(edge, np.asarray(own.field("last")) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                out["kept"].append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.binary())], names=["row_id", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = documents.select("row_id", "doc_id", "text").join(by_row, "row_id", "left")
    return joined.mapInArrow(in_task(strip), "row_id long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@owner
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("row_id", row_id())
    out = remove_repeats(documents)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
