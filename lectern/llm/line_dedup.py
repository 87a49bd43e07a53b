"""Line dedup: a segment-partition edit join over the distinct lines of a corpus.

Two lines of MIN_BYTES bytes or more are near copies when their edit distance
over UTF-8 bytes is at most THRESHOLD. A line within t edits of another keeps
one of t + 1 even segments whole, so:

* every distinct line is indexed by its length and segments, and probes the
  lengths l - t ... l with just those substrings whose place is possible both
  from the left and from the right of the segment;
* equal keys meet in a shuffle of packed arrays. Before a pair leaves its task, the
  counts of its bytes in 16 classes must be within 2t, as t edits can't change more;
* the pairs left are verified by a banded bit-parallel edit distance, all pairs of
  a batch at once.

Near copies form classes (connected components); of each class the first line of
the corpus by (doc_id, row, line number) stays and the others go. Shorter lines
are never near copies of each other; with short_lines their exact repeats go as
well, but for blank lines, which only set others apart.

Equal lines are told by 128 bits of hash, near ones by their distance. A row is
told by its id and a hash of id and text: rows with one id but unlike texts are
documents of their own, and rows equal in both are one document listed twice, so
both keep the same lines.

Nulls: a null text has no lines; an empty text is one empty line. Documents with
a null id keep their lines, and no other document loses a line to them. Other
columns go through as they are, whatever their names; n_lines, n_removed, n_near
and kept_in of the input give way to the operator's own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import connected_components, discard, in_group, in_task, mix, owner, prefix_hash, save, shuffle_width, signed, slices, span_hash, table, text_bytes

THRESHOLD = 2
MIN_BYTES = 30
#: Candidate lines, up to so many, are found again by a broadcast of their hashes (8 bytes each).
BROADCAST_LINES = 2_000_000
_FLUSH = 600_000
_LOW48 = np.uint64((1 << 48) - 1)
_CLASS = (np.arange(256) * 7919 % 251 % 16).astype(np.int64)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Columns that dedup_lines puts behind those of the documents.
ADDED = ("n_lines", "n_removed", "n_near", "kept_in")


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number within its row of every line."""
    cuts = np.flatnonzero(data == 10)
    rows = np.arange(len(offsets) - 1)
    row = np.concatenate([rows, np.searchsorted(offsets, cuts, side="right") - 1])
    # a row's own beginning comes before the lines behind its newlines; rows without bytes have one empty line
    order = np.lexsort((np.repeat([0, 1], [len(rows), len(cuts)]), row))
    starts, row = np.concatenate([offsets[:-1], cuts + 1])[order], row[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    ends[last] = offsets[row[last] + 1]
    first = np.searchsorted(row, rows)
    return starts, ends, row, np.arange(len(row)) - first[row]


def _hashed(data, offsets):
    starts, ends, row, number = line_spans(data, offsets)
    prefix = prefix_hash(data)
    return starts, ends, row, number, span_hash(prefix, starts, ends), prefix


def byte_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of 16 byte classes, 4 bits each, of each span: sixteen counts modulo 16 in one number."""
    out = np.zeros(len(starts), np.uint64)
    kind = _CLASS[data]
    total = np.zeros(len(data) + 1, np.int64)
    for c in range(16):
        np.cumsum(kind == c, out=total[1:])
        out |= ((total[ends] - total[starts]) & 15).astype(np.uint64) << np.uint64(4 * c)
    return out


def counts_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most the sum of the differences of the 16 counts."""
    out = np.zeros(len(a), np.int64)
    for c in range(16):
        d = ((a >> np.uint64(4 * c)).astype(np.int64) - (b >> np.uint64(4 * c)).astype(np.int64)) & 15
        out += np.minimum(d, 16 - d)
    return out


def segments(length: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of segment k of lines of these lengths; the last ones take the remainder."""
    n = threshold + 1
    base, more = length // n, length % n
    return k * base + np.maximum(0, k - (n - more)), base + (k >= n - more)


def join_keys(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int):
    """(key, line, probe) of all index and probe entries."""
    length = ends - starts
    keys, lines, probes = [], [], []

    def add(at, begin, size, target, k, probe):
        h = span_hash(prefix, starts[at] + begin, starts[at] + begin + size)
        keys.append(mix(h + (target * (threshold + 1) + k).astype(np.uint64)))
        lines.append(at)
        probes.append(np.full(len(at), probe))

    every = np.arange(len(starts))
    for k in range(threshold + 1):
        begin, size = segments(length, k, threshold)
        add(every, begin, size, length, k, False)
        for shorter in range(threshold + 1):
            target = length - shorter
            begin, size = segments(target, k, threshold)
            low = np.maximum(begin - k, begin + shorter - (threshold - k))
            high = np.minimum(begin + k, begin + shorter + (threshold - k))
            for step in range(2 * threshold + 1):
                at = np.flatnonzero((low + step <= high) & (low + step >= 0) & (low + step + size <= length))
                if len(at):
                    add(at, (low + step)[at], size[at], target[at], k, True)
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(probes)


def banded_distance(data_a, start_a, len_a, data_b, start_b, len_b, threshold: int) -> np.ndarray:
    """Edit distance of each pair, or threshold + 1: one 64-bit band of bit vectors for each pair, all pairs a column at a time.

    The strings a must be at least as long as their b, and by threshold at most.
    """
    one = np.uint64(1)
    n = len(start_a)
    out = np.full(n, threshold + 1, np.int64)
    live = np.argsort(-len_b, kind="stable")
    vp = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(63 - threshold), np.uint64)
    vn, dist = np.zeros(n, np.uint64), np.full(n, threshold, np.int64)
    edge = np.full(n, 62, np.uint64)
    stop = 2 * threshold + len_b - len_a
    j = 0
    while len(live):
        over = len_b[live] <= j
        if over.any():
            ended = live[over]
            out[ended] = np.minimum(dist[ended], threshold + 1)
            live = live[~over]
            if not len(live):
                break
        char = data_b[start_b[live] + j]
        x = np.zeros(len(live), np.uint64)
        for k in range(2 * threshold + 1):
            q = j + threshold - k
            inside = (q >= 0) & (q < len_a[live])
            same = inside & (data_a[np.where(inside, start_a[live] + q, 0)] == char)
            x |= same.astype(np.uint64) << np.uint64(63 - k)
        p, m = vp[live], vn[live]
        d0 = (((x & p) + p) ^ p) | x | m
        hp, hn = m | ~(d0 | p), d0 & p
        diagonal = j < len_a[live] - threshold
        e = edge[live]
        step = np.where(diagonal, 1 - (d0 >> np.uint64(63)).astype(np.int64), ((hp >> e) & one).astype(np.int64) - ((hn >> e) & one).astype(np.int64))
        edge[live] = np.where(diagonal, e, e - one)
        dist[live] += step
        vp[live], vn[live] = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
        live = live[dist[live] <= stop[live]]
        j += 1
    return out


_PARTS = "bucket int, payload binary"


def candidate_pairs(documents: DataFrame, threshold: int, min_bytes: int) -> DataFrame:
    """Distinct pairs (a, b) of hashes of unlike lines that share a key and whose byte counts are near; a is as long as b or longer."""
    bits = min(20, max(6, math.ceil(math.log2(2 * shuffle_width(documents.sparkSession)))))
    shift = np.uint64(48 - bits)

    def scatter(batches):
        held, total, known = [], 0, np.zeros(0, np.uint64)

        def flush():
            keys, lines, counts, probe = (np.concatenate(c) for c in zip(*held))
            bucket = (keys >> shift).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, lines, counts, probe, bucket = keys[order], lines[order], counts[order], probe[order], bucket[order]
            bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            parts = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                k = keys[lo:hi]
                parts.append(b"".join([(k >> np.uint64(32)).astype(np.uint16).tobytes(), k.astype(np.uint32).tobytes(), lines[lo:hi].tobytes(), counts[lo:hi].tobytes(), probe[lo:hi].astype(np.uint8).tobytes()]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]]), pa.array(parts, pa.binary())], names=["bucket", "payload"])

        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in slices(offsets):
                body = data[offsets[i] : offsets[j]]
                starts, ends, _, _, lines, prefix = _hashed(body, offsets[i : j + 1] - offsets[i])
                ok = ends - starts >= min_bytes
                starts, ends, lines = starts[ok], ends[ok], lines[ok]
                lines, first = np.unique(lines, return_index=True)
                new = ~np.isin(lines, known)
                lines, starts, ends = lines[new], starts[first][new], ends[first][new]
                if not len(lines):
                    continue
                known = np.concatenate([known, lines])
                keys, at, probe = join_keys(prefix, starts, ends, threshold)
                held.append((keys & _LOW48, lines[at], byte_counts(body, starts, ends)[at], probe))
                total += len(keys)
                if total >= _FLUSH:
                    yield flush()
                    held, total, known = [], 0, np.zeros(0, np.uint64)
        if held:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        keys, lines, counts, probe = [], [], [], []
        for x in group["payload"]:
            x = x.as_buffer()
            n = len(x) // 23
            keys.append((np.frombuffer(x, np.uint16, n).astype(np.uint64) << np.uint64(32)) | np.frombuffer(x, np.uint32, n, 2 * n))
            lines.append(np.frombuffer(x, np.uint64, n, 6 * n))
            counts.append(np.frombuffer(x, np.uint64, n, 14 * n))
            probe.append(np.frombuffer(x, np.uint8, n, 22 * n))
        keys, lines, counts, probe = (np.concatenate(c) for c in (keys, lines, counts, probe))
        # keys that stand in both ways and for more than one line
        order = np.argsort(keys)
        keys, lines, counts, probe = keys[order], lines[order], counts[order], probe[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(begin, len(keys)))
        unlike = np.maximum.reduceat(lines, begin) != np.minimum.reduceat(lines, begin)
        both = (np.maximum.reduceat(probe, begin) == 1) & (np.minimum.reduceat(probe, begin) == 0) & unlike
        keep = np.repeat(both, size)
        keys, lines, counts, probe = keys[keep], lines[keep], counts[keep], probe[keep]
        order = np.lexsort((lines, probe, keys))
        keys, lines, counts, probe = keys[order], lines[order], counts[order], probe[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (probe[1:] != probe[:-1]) | (lines[1:] != lines[:-1])
        keys, lines, counts, probe = keys[new], lines[new], counts[new], probe[new]
        index = np.flatnonzero(probe == 0)
        ask = np.flatnonzero(probe == 1)
        lo, hi = np.searchsorted(keys[index], keys[ask], side="left"), np.searchsorted(keys[index], keys[ask], side="right")
        found_a, found_b, i = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
        many = np.cumsum(hi - lo)
        while i < len(ask):  # a bounded number of pairs at a time
            j = max(i + 1, int(np.searchsorted(many, (many[i - 1] if i else 0) + 1_000_000, side="right")))
            n = hi[i:j] - lo[i:j]
            a = np.repeat(ask[i:j], n)
            b = index[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[i:j], n)]
            ok = lines[a] != lines[b]
            a, b = a[ok], b[ok]
            ok = counts_apart(counts[a], counts[b]) <= 2 * threshold
            found_a.append(lines[a[ok]])
            found_b.append(lines[b[ok]])
            i = j
        pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)], 1), axis=0)
        return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), "b": pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))})

    return documents.select("text").mapInArrow(in_task(scatter), _PARTS).groupBy("bucket").applyInArrow(in_group(meet), "a long, b long").distinct()


def occurrences(documents: DataFrame, min_bytes: int, short_lines: bool) -> DataFrame:
    """(doc_id, row, number, line, check) of every line of min_bytes bytes or more, and with short_lines of all that aren't blank."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            ids, rows = batch.column(0).cast(pa.int64()), batch.column(1)
            for i, j in slices(offsets):
                body = data[offsets[i] : offsets[j]]
                starts, ends, row, number, lines, prefix = _hashed(body, offsets[i : j + 1] - offsets[i])
                ok = ends - starts >= min_bytes
                if short_lines:
                    seen = np.concatenate([[0], np.cumsum(~_BLANK[body])])
                    ok |= seen[ends] > seen[starts]
                starts, ends, row, number, lines = starts[ok], ends[ok], row[ok], number[ok], lines[ok]
                middle = (starts + ends) // 2
                check = mix(span_hash(prefix, starts, middle) + np.uint64(3) * span_hash(prefix, middle, ends))
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([ids.take(at), rows.take(at), pa.array(number.astype(np.int32)), pa.array(signed(lines)), pa.array(signed(check))], names=["doc_id", "row", "number", "line", "check"])

    return documents.select("doc_id", "row", "text").mapInArrow(in_task(run), "doc_id long, row long, number int, line long, check long")


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) of the wanted lines."""
    spark = documents.sparkSession
    few = wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    shared = spark.sparkContext.broadcast(np.sort(np.asarray(wanted.toArrow()["line"]))) if few else None

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in slices(offsets):
                body = data[offsets[i] : offsets[j]]
                starts, ends, _, _, lines, _ = _hashed(body, offsets[i : j + 1] - offsets[i])
                lines = signed(lines)
                at = np.arange(len(lines))
                if shared is not None and len(shared.value):
                    k = np.minimum(np.searchsorted(shared.value, lines), len(shared.value) - 1)
                    at = at[shared.value[k] == lines]
                lines_at, first = np.unique(lines[at], return_index=True)
                at = at[first]
                fresh = [k for k in at if int(lines[k]) not in seen]
                if len(seen) < 200_000:
                    seen.update(int(lines[k]) for k in fresh)
                yield pa.RecordBatch.from_arrays([pa.array(lines[fresh], pa.int64()), pa.array([body[starts[k] : ends[k]].tobytes() for k in fresh], pa.binary())], names=["line", "text"])

    found = documents.select("text").mapInArrow(in_task(run), "line long, text binary")
    found = found if few else found.join(wanted, "line", "left_semi")
    return found.groupBy("line").agg(F.first("text").alias("text"))


def links(documents: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(a, b, distance): hashes of unlike lines within the threshold."""
    spark = documents.sparkSession
    pairs = save(spark, candidate_pairs(documents, threshold, min_bytes), "pairs")
    texts = save(spark, _texts(documents, pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct()), "lines")
    left = texts.select(F.col("line").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("line").alias("b"), F.col("text").alias("y"))

    def verify(batches):
        for batch in batches:
            x, at_x = text_bytes(batch.column(2))
            y, at_y = text_bytes(batch.column(3))
            d = banded_distance(x, at_x[:-1], np.diff(at_x), y, at_y[:-1], np.diff(at_y), threshold)
            ok = pa.array(d <= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(d.astype(np.int32)).filter(ok)], names=["a", "b", "distance"])

    found = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(in_task(verify), "a long, b long, distance int")
    out = save(spark, found, "links")
    discard(pairs, texts)
    return out


def rows_of(documents: DataFrame) -> DataFrame:
    """(doc, doc_id, row, text): doc holds all columns of the documents, out of the way of any other name."""
    return documents.select(F.struct("*").alias("doc"), "doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def removed_lines(rows: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, short_lines: bool = False) -> DataFrame:
    """(doc_id, row, gone, n_near, kept_in) of rows that lose lines: their numbers, how many go as near copies, and the rows (doc_id, row) where those that stay are."""
    spark = rows.sparkSession
    known = rows.where("doc_id IS NOT NULL")
    where = save(spark, occurrences(known, min_bytes, short_lines), "occurrences")
    near = links(known, threshold, min_bytes)
    classes = connected_components(spark, near, "classes")
    # one row a line first, so that a line of very many documents meets its class once
    lines = where.groupBy("line", "check").agg(F.min(F.struct("doc_id", "row", "number")).alias("first"), F.count("*").alias("n"))
    lines = lines.join(classes.withColumnRenamed("node", "line"), "line", "left")
    # a line without near copies is a class of its own, under all its bits
    lines = lines.withColumn("kind", F.coalesce("component", "line")).withColumn("rest", F.when(F.col("component").isNull(), F.col("check")).otherwise(F.lit(0).cast("long")))
    keep = lines.groupBy("kind", "rest").agg(F.min_by(F.struct("first", "line"), "first").alias("kept"), F.sum("n").alias("n")).where("n > 1")
    stay = lines.join(keep.drop("n"), ["kind", "rest"]).select("line", "check", F.col("kept.first").alias("first"), (F.col("kept.line") != F.col("line")).alias("near"))
    gone = where.join(stay, ["line", "check"]).where("NOT (doc_id = first.doc_id AND row = first.row AND number = first.number)")
    # equal rows give equal entries: sets count them once
    gone = gone.groupBy("doc_id", "row").agg(
        F.collect_set("number").alias("gone"),
        F.size(F.collect_set(F.when(F.col("near"), F.col("number")))).alias("n_near"),
        F.array_sort(F.collect_set(F.struct("first.doc_id", "first.row"))).alias("kept_in"),
    )
    out = save(spark, gone, "gone")
    discard(where, near, classes)
    return out


def cut_lines(documents: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, short_lines: bool = False) -> DataFrame:
    """(doc, doc_id, row, text, n_lines, n_removed, n_near, kept_in) of every row: text is what remains, doc the row as it was.

    kept_in: the rows (doc_id, row), ascending, where the removed lines stay; null if none were removed.
    """
    rows = rows_of(documents)
    gone = removed_lines(rows, threshold, min_bytes, short_lines)
    # the one-element array binds the lines, so that a text is split once; places that stay are a difference of sets, linear in the lines
    rest = F.get(F.transform(F.array(F.split("text", "\n")), lambda w: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), F.col("gone")), lambda i: F.get(w, i)), "\n")), F.lit(0))
    # as a merge join at every size: the list of documents with removed lines grows with the corpus
    joined = rows.join(gone.hint("shuffle_merge"), ["doc_id", "row"], "left")
    return joined.select(
        "doc",
        "doc_id",
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "kept_in",
    )


def dedup_lines(documents: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, short_lines: bool = False) -> DataFrame:
    """The documents with their remaining lines as text, and n_lines, n_removed, n_near (removed as near copies), kept_in (see cut_lines)."""
    out = cut_lines(documents, threshold, min_bytes, short_lines)
    return out.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in documents.columns if c not in ADDED], *ADDED)


@owner
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short_lines=True)
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
