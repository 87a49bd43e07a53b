"""Shared helpers of the training-data operators.

Bytes of many texts are handled as one uint8 array with document offsets, so
that tokenizing and hashing are whole-array numpy work inside Spark tasks.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 500_000

#: Bytes of an Arrow batch between Spark and its Python workers: both sides hold a batch whole.
BATCH_BYTES = 8_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
#: The folder of a local session that names none.
_own_dir: list[str | None] = [None]


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "67108864b").rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without one; it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir[0] = _own_dir[0] or tempfile.mkdtemp(prefix="lectern-")
    return found


def save(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it again."""
    bound_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    for made in _owned[-1:]:
        made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


#: Paths of the tables that the queries under way have saved, a list a query.
_owned: list[list[str]] = []


def owner(run: Callable) -> Callable:
    """A query (spark, sf_dir) that leaves one table behind, its result: all others that it has saved are deleted once that is written."""

    @functools.wraps(run)
    def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        _owned.append([])
        try:
            return save(spark, run(spark, sf_dir), "result")
        finally:
            made = _owned.pop()
            result = made.pop() if made and "/result-" in made[-1] else None
            for path in made:
                _delete(spark, path)
            if result and _owned:
                _owned[-1].append(result)

    return wrapped


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def discard(*saved: DataFrame) -> None:
    """Delete saved tables that nothing will read again; what was made of them must have been written."""
    for df in saved:
        _delete(df.sparkSession, df.saved_at)


def quoted(names: list[str]) -> list[str]:
    """Column names for select(), whatever characters they have."""
    return ["`" + c.replace("`", "``") + "`" for c in names]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out(doc_id: str, modulus: int, remainder: int):
    """crc32 of the id's text: the folds that the contracts fix."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus == remainder


def release() -> None:
    """Hand freed memory back to the system: a Python worker lives on between tasks and would keep what its largest one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others need not
    if trim:
        trim(0)


def in_task(run: Callable) -> Callable:
    """A function for mapInArrow that releases its memory at the end of each task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def in_group(run: Callable) -> Callable:
    """The same for a function over one group."""

    def wrapped(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            release()

    return wrapped


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and the int64 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each; always one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n; a worker keeps those of one slice, longer ones are made anew."""
    if len(_powers.get("up", ())) < n:
        made = {}
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            x = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            x[0] = 1
            made[name] = np.multiply.accumulate(x)
        if n > SLICE_BYTES + 1:
            return made["up"][:n], made["down"][:n]
        _powers.update(made)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = powers(len(data) + 1)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in each [start, end); equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and each word's row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = is_word[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n nodes that each reaches over the edges a-b, within a task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, a, low)
        np.minimum.at(nxt, b, low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            return label
        label = nxt


def complete_groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys; a group that a batch cuts is held for the next."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, now]) if held is not None else now
        last = group_starts(held, keys)[-1]
        if last:
            yield held.slice(0, last).combine_chunks()
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def group_starts(part: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(part.num_rows, bool)
    new[:1] = True
    for c in keys:
        x = np.asarray(part[c])
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def connected_components(spark: SparkSession, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b).

    Minimum labels spread over the edges and are shortcut through their own
    labels; each round is one table in the shared folder, deleted when the next
    one stands. Nothing but whether labels changed reaches the driver.
    """
    both = edges.select("a", "b").where("a <> b").distinct()
    both = save(spark, both.union(both.select(F.col("b"), F.col("a"))), f"{tag}-edges")
    labels = save(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"), F.lit(True).alias("moved")), tag)
    changed = True
    while changed:
        spread = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        near = labels.join(spread, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        roots = near.select(F.col("node").alias("component"), F.col("component").alias("root"))
        least = F.least("component", F.coalesce("root", "component"))
        nxt = save(spark, near.join(roots, "component", "left").select("node", least.alias("component"), (least != F.col("old")).alias("moved")), tag)
        discard(labels)
        labels = nxt
        changed = not nxt.where("moved").isEmpty()
    discard(both)
    out = labels.select("node", "component")
    out.saved_at = labels.saved_at
    return out
