"""N-gram Jaccard join with a token-group matrix.

A document is its set of word shingles; equal sets are one set from the start.
Two sets link when 100 * |A & B| >= percent * |A | B|. The join is exact:

1. All tokens go, as packed arrays, once through a shuffle by token, where each
   learns in how many sets it stands (copies count once). Tokens of one set
   only can't make a link and stay behind.
2. The others go to their sets. With all tokens of a set in order of rarity, any
   two linked sets share one of their first n - ceil(percent * n / 100) + 1. Most
   sets have nothing but lone tokens there: they link with nothing.
3. The remaining sets are partitioned into groups of like sets (by their smallest
   token hash). The matrix holds each group's union of such tokens and its range of
   sizes. A set and a group qualify when the tokens in common, with all
   that the set has outside its beginning, can reach the overlap that the sizes ask for.
   That bound holds for the set whose beginning ends first in the order of rarity: what its
   beginning shares with the other set stands in the other's beginning too. So of each pair
   the set with the lesser end asks.
4. Each group is first compared with its own first set, and components are
   formed of the links found. Then qualifying groups are opened, but only for
   members that are not yet in the component of the asking set: links inside a
   component change nothing. So a group of n near copies costs n comparisons.

Components are those of all links; links inside a component are not listed.

Nulls: a null, empty or wordless text has no shingles and links with nothing; a
text of fewer words than a shingle has its whole sequence as its one shingle.
Rows with equal ids count as documents of their own; keep_first keeps or drops
rows of one id together. Other columns go through keep_first as they are,
whatever their names. 48-bit tokens and a 64-bit set hash stand for the strings:
the chance that a pair's overlap is one off is below the product of their sizes
over 2**48.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import complete_groups, connected_components, discard, group_starts, in_group, in_task, local_roots, lower_ascii, mix, owner, prefix_hash, quoted, save, shuffle_width, signed, slices, span_hash, table, text_bytes, word_spans

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOW48 = np.uint64((1 << 48) - 1)
_FLUSH = 600_000
#: Sets of a block that one task compares with another block.
BLOCK = 256
#: Ids of copies, up to so many, are broadcast.
BROADCAST_IDS = 1_000_000


def shingles(data: np.ndarray, offsets: np.ndarray, size: int, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of fewer than 65536 rows: row << 48 | token, ascending; and how many each row has."""
    rows = len(offsets) - 1
    low = lower_ascii(data)
    starts, ends, row = word_spans(low, offsets, is_word)
    words = span_hash(prefix_hash(low), starts, ends)
    m = len(words)
    counts = np.bincount(row, minlength=rows)
    at = np.arange(max(m - size + 1, 0))
    at = at[row[at] == row[at + size - 1]] if len(at) else at
    token = np.full(len(at), size, np.uint64)
    for j in range(size):
        token = mix(token * np.uint64(0x9E3779B97F4A7C15) + words[at + j])
    short = np.flatnonzero((counts > 0) & (counts < size))
    begin = (np.cumsum(counts) - counts)[short]
    whole = counts[short].astype(np.uint64)
    for j in range(size - 1):
        more = counts[short] > j
        whole[more] = mix(whole[more] * np.uint64(0x9E3779B97F4A7C15) + words[begin[more] + j])
    keys = (np.concatenate([row[at], short]).astype(np.uint64) << np.uint64(48)) | (np.concatenate([token, whole]) & _LOW48)
    keys = np.unique(keys)
    return keys, np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=rows)


def set_hashes(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each row's set; 0 for an empty one."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        begin = (np.cumsum(counts) - counts)[some]
        total = np.add.reduceat(mix((keys & _LOW48) + np.uint64(1)), begin)
        out[some] = mix(total + counts[some].astype(np.uint64)) | np.uint64(1)
    return out


def _blocks(batch):
    data, offsets = text_bytes(batch.column(1))
    for i, j in slices(offsets):
        for a in range(i, j, 65_000):
            b = min(a + 65_000, j)
            yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def set_table(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_id); set_id null for an empty set."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in _blocks(batch):
                keys, counts = shingles(data, offsets, size)
                ids = signed(set_hashes(keys, counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(ids, mask=counts == 0)], names=["doc_id", "n_shingles", "set_id"])

    return documents.select("doc_id", "text").mapInArrow(in_task(run), "doc_id long, n_shingles long, set_id long")


def _pack(tokens, index, sets, sizes, classes=None) -> bytes:
    """One payload: the sets it names, and 6-byte tokens with their set's place among these."""
    head = np.array([len(sets), len(tokens)], np.int64).tobytes()
    body = [head, sets.tobytes(), sizes.astype(np.int32).tobytes(), index.astype(np.uint16 if len(sets) <= 65536 else np.int32).tobytes(), (tokens >> np.uint64(32)).astype(np.uint16).tobytes(), tokens.astype(np.uint32).tobytes()]
    return b"".join(body + ([classes.astype(np.uint8).tobytes()] if classes is not None else []))


def _unpack(payloads, classes: bool = False):
    """All payloads' tokens and their sets' places in the joint, distinct set list."""
    sets, sizes, index, tokens, kinds, base = [], [], [], [], [], 0
    for x in payloads:
        s, n = np.frombuffer(x, np.int64, 2)
        at = 16
        parts = []
        for kind, length in ((np.int64, s), (np.int32, s), (np.uint16 if s <= 65536 else np.int32, n), (np.uint16, n), (np.uint32, n), *([(np.uint8, n)] if classes else [])):
            parts.append(np.frombuffer(x, kind, length, at))
            at += parts[-1].nbytes
        sets.append(parts[0])
        sizes.append(parts[1])
        index.append(parts[2].astype(np.int64) + base)
        tokens.append((parts[3].astype(np.uint64) << np.uint64(32)) | parts[4])
        kinds.extend(parts[5:])
        base += int(s)
    ids, first, same = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    return ids, np.concatenate(sizes)[first], same[np.concatenate(index)], np.concatenate(tokens), np.concatenate(kinds) if classes else None


def _pieces(bucket: np.ndarray, tokens, index, sets, sizes, classes=None):
    """(bucket, payload) for each bucket, naming only the sets that it has."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        at = order[lo:hi]
        named, local = np.unique(index[at], return_inverse=True)
        yield int(bucket[at[0]]), _pack(tokens[at], local, sets[named], sizes[named], None if classes is None else classes[at])


_PARTS = "bucket int, payload binary"


def _batch(parts) -> pa.Table:
    parts = list(parts)
    return pa.table({"bucket": pa.array([p[0] for p in parts], pa.int32()), "payload": pa.array([p[1] for p in parts], pa.binary())})


def active_sets(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Sets that may link, with the tokens that other sets have too: (set_id, n, rest, grp, last, prefix, tokens).

    prefix: tokens of the beginning; last: the place of its last in the order of rarity; rest: how many tokens the set has behind it;
    grp: the smallest token hash, which like sets mostly share.
    """
    spark = documents.sparkSession
    bits = min(20, max(6, math.ceil(math.log2(2 * shuffle_width(spark)))))
    shift = np.uint64(48 - bits)
    set_bits = max(5, bits - 3)  # what is left after the first shuffle is less; each bucket writes a payload for each of these

    def scatter(batches):
        held, sets, sizes, total, known = [], [], [], 0, set()

        def flush():
            row = np.concatenate([np.full(len(t), k) for k, t in enumerate(held)])
            tokens = np.concatenate(held)
            return _batch(_pieces((tokens >> shift).astype(np.int32), tokens, row, np.array(sets, np.int64), np.array(sizes))).to_batches()

        for batch in batches:
            for _, _, data, offsets in _blocks(batch):
                keys, counts = shingles(data, offsets, size)
                ids = signed(set_hashes(keys, counts))
                ends = np.cumsum(counts)
                for k in np.flatnonzero(counts):
                    if ids[k] not in known:
                        known.add(ids[k])
                        held.append(keys[ends[k] - counts[k] : ends[k]] & _LOW48)
                        sets.append(ids[k])
                        sizes.append(counts[k])
                        total += int(counts[k])
                if total >= _FLUSH:
                    yield from flush()
                    held, sets, sizes, total, known = [], [], [], 0, set()
        if held:
            yield from flush()

    def frequent(group: pa.Table) -> pa.Table:
        ids, sizes, index, tokens, _ = _unpack([x.as_py() for x in group["payload"]])
        order = np.lexsort((index, tokens))
        tokens, index = tokens[order], index[order]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (index[1:] != index[:-1])])
        tokens, index = tokens[new], index[new]
        begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        df = np.diff(np.append(begin, len(tokens)))
        each = np.repeat(df, df)
        many = each > 1
        classes = np.minimum(255, np.floor(8 * np.log2(each[many])))
        index = index[many]
        return _batch(_pieces((mix(ids.view(np.uint64))[index] >> np.uint64(64 - set_bits)).astype(np.int32), tokens[many], index, ids, sizes, classes))

    def gather(group: pa.Table) -> pa.Table:
        ids, sizes, index, tokens, classes = _unpack([x.as_py() for x in group["payload"]], True)
        order = np.lexsort((tokens, classes, index))
        index, tokens, classes = index[order], tokens[order], classes[order]
        begin = np.searchsorted(index, np.arange(len(ids) + 1))
        shared = np.diff(begin)
        first = sizes - (percent * sizes + 99) // 100 + 1
        left = np.minimum(first - (sizes - shared), shared)
        out = {"set_id": [], "n": [], "rest": [], "grp": [], "last": [], "prefix": [], "tokens": []}
        for k in np.flatnonzero(left > 0):
            own = tokens[begin[k] : begin[k + 1]]
            out["set_id"].append(int(ids[k]))
            out["n"].append(int(sizes[k]))
            out["rest"].append(int(sizes[k] - first[k]))
            out["last"].append((int(classes[begin[k] + left[k] - 1]) << 48) | int(own[left[k] - 1]))
            out["prefix"].append(own[: left[k]].astype(np.int64))
            own = np.sort(own)
            out["grp"].append(int(own[0]))
            out["tokens"].append(own.tobytes())
        return pa.table({"set_id": pa.array(out["set_id"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "rest": pa.array(out["rest"], pa.int64()), "grp": pa.array(out["grp"], pa.int64()), "last": pa.array(out["last"], pa.int64()), "prefix": pa.array(out["prefix"], pa.list_(pa.int64())), "tokens": pa.array(out["tokens"], pa.binary())})

    parts = documents.select("doc_id", "text").mapInArrow(in_task(scatter), _PARTS)
    return (
        parts.groupBy("bucket")
        .applyInArrow(in_group(frequent), _PARTS)
        .groupBy("bucket")
        .applyInArrow(in_group(gather), "set_id long, n long, rest long, grp long, last long, prefix array<long>, tokens binary")
    )


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link, of rows (a, b, n_a, n_b, tokens_a, tokens_b): exact, from the tokens that either shares with any set."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(4), batch.column(5)
            na, nb = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            ok = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok[k] = 100 * both >= percent * (int(na[k]) + int(nb[k]) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b").mapInArrow(in_task(run), "a long, b long")


def _opened(qualified: DataFrame, active: DataFrame, placed: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between asking sets and members of the groups opened for them, one star for each linked part.

    Members and asking sets of a group are cut into blocks, and each pair of
    blocks is compared inside one task: what travels is sets, not pairs.
    """
    width = max(8, shuffle_width(qualified.sparkSession))
    blocks = (
        qualified.groupBy("grp").agg(F.count("*").alias("asking"))
        .join(placed.groupBy("grp").agg(F.count("*").alias("members")), "grp")
        .select("grp", *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("asking", "members")])
    )
    what = active.select("set_id", "n", "last", "tokens").join(placed.select("set_id", "component", F.col("grp").alias("own")), "set_id")
    part = lambda c: F.pmod(F.xxhash64("set_id"), F.col(c).cast("long")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asks = qualified.join(what.drop("own"), "set_id").join(blocks, "grp").select("grp", part("asking").alias("x"), every("members").alias("y"), F.lit(True).alias("asks"), "set_id", "n", "last", "component", "tokens")
    members = what.withColumnRenamed("own", "grp").join(blocks, "grp").select("grp", every("asking").alias("x"), part("members").alias("y"), F.lit(False).alias("asks"), "set_id", "n", "last", "component", "tokens")
    dealt = asks.unionByName(members).repartition(width, "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "asks")

    def compared(batches):
        for table_ in complete_groups(batches, ["grp", "x", "y"]):
            starts = np.append(group_starts(table_, ["grp", "x", "y"]), table_.num_rows)
            ids, n, last, comp = (np.asarray(table_[c]) for c in ("set_id", "n", "last", "component"))
            asking = table_["asks"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            tokens = table_["tokens"].combine_chunks()
            out_a, out_b = [], []
            for lo, hi in zip(starts[:-1], starts[1:]):
                member, ask = np.flatnonzero(~asking[lo:hi]) + lo, np.flatnonzero(asking[lo:hi]) + lo
                if not len(member) or not len(ask):
                    continue
                fits = 100 * np.minimum(n[ask][:, None], n[member]) >= percent * np.maximum(n[ask][:, None], n[member])
                before = (last[ask][:, None] < last[member]) | ((last[ask][:, None] == last[member]) & (ids[ask][:, None] < ids[member]))
                fits &= before & (comp[ask][:, None] != comp[member])
                a, b = np.nonzero(fits)
                if not len(a):
                    continue
                a, b = ask[a], member[b]
                both = _overlaps(tokens, a, b)
                ok = 100 * both >= percent * (n[a] + n[b] - both)
                if ok.any():
                    root = local_roots(hi - lo, a[ok] - lo, b[ok] - lo) + lo
                    moved = np.flatnonzero(root != np.arange(lo, hi)) + lo
                    out_a.append(ids[moved])
                    out_b.append(ids[root[moved - lo]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return dealt.mapInArrow(in_task(compared), "a long, b long")


def _overlaps(tokens: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at rows a and b."""
    rows, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = [np.frombuffer(tokens[int(r)].as_buffer(), np.uint64) for r in rows]
    if len(a) < 4 * len(rows):
        out = np.empty(len(a), np.int64)
        for k, (i, j) in enumerate(zip(where[: len(a)], where[len(a) :])):
            x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            out[k] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
        return out
    sizes = [len(x) for x in sets]
    uniq, index = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    total = np.zeros((len(rows), len(rows)), np.float32)
    for lo in range(0, len(uniq), 8192):  # bounded columns at a time
        ok = (index >= lo) & (index < lo + 8192)
        part = np.zeros((len(rows), min(8192, len(uniq) - lo)), np.float32)
        part[row[ok], index[ok] - lo] = 1
        total += part @ part.T
    return total[where[: len(a)], where[len(a) :]].astype(np.int64)


def components(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id): component_id is the smallest doc_id reachable by links."""
    spark = documents.sparkSession
    sets = save(spark, set_table(documents, size), "sets")
    active = save(spark, active_sets(documents, size, percent), "active")
    info = active.select("set_id", "n", "grp")
    groups = info.groupBy("grp").agg(F.min("set_id").alias("pivot"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.count("*").alias("m"))
    # each group against its own first set
    near = active.join(groups.where("m > 1").select("grp", "pivot"), "grp").where("set_id <> pivot")
    pivots = active.select(F.col("set_id").alias("pivot"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    star = near.select(F.col("set_id").alias("a"), "pivot", F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a")).join(pivots, "pivot").withColumnRenamed("pivot", "b")
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    star = save(spark, _linked(star.where(fits), percent), "star")
    first = connected_components(spark, star, "star")
    placed = save(spark, info.join(first.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "placed")
    # the matrix: each group's union of tokens, its sizes, and its component if it has but one
    ranges = placed.groupBy("grp").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("component").alias("c_min"), F.max("component").alias("c_max"))
    token = F.explode("prefix").alias("token")
    matrix = active.select("grp", token).distinct().join(ranges, "grp")
    asking = active.select("set_id", "rest", token).join(placed.select("set_id", "n", "component"), "set_id")
    need = f"ceil({percent} * (n + greatest(n_min, ceil({percent} * n / 100.0))) / {100 + percent}.0)"
    qualified = (
        asking.join(matrix, "token")
        .where(f"100 * n >= {percent} * n_min AND 100 * n_max >= {percent} * n AND NOT (c_min = c_max AND c_min = component)")
        .groupBy("set_id", "grp", "n", "rest", "component", "n_min")
        .agg(F.count("*").alias("shared"))
        .where(f"shared + rest >= {need}")
    )
    qualified = save(spark, qualified.select("set_id", "grp"), "qualified")
    rest = _opened(qualified, active, placed, percent)
    joined = connected_components(spark, first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest), "sets")
    discard(active, star, first, placed, qualified)
    least = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc"))
    whole = least.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    named = whole.groupBy("component").agg(F.min("doc").alias("component_id"))
    ids = whole.join(named, "component").select("set_id", "component_id")
    return sets.join(ids, "set_id", "left").select("doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the smallest doc_id, with all its columns; rows with a null id stay."""
    parts = components(documents, size, percent).groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("first"))
    gone = save(documents.sparkSession, parts.where("NOT first").select("doc_id"), "copies")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return documents.join(gone, "doc_id", "left_anti").select(*quoted(documents.columns))


@owner
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")
