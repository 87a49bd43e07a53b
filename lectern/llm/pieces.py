"""SentencePiece encoding and decoding as a shortest path in a weighted transducer.

Three transducers are compiled from a public model file:

* the normaliser (one dummy space in front; a space becomes the word mark),
* the pieces (an arc for each piece, its weight the negated score),
* byte fallback (an arc for each byte, dearer than any path of pieces).

Composed with a text they give a lattice whose states are byte positions; the
path of least total weight in the tropical (min, +) semiring is the encoding.
No piece has a word mark behind another byte, and bytes that no piece has are
only crossed by fallback, so the lattice falls apart at these states and the
shortest path of the whole is the concatenation of those of its parts. Equal
parts of a slice of texts are solved once, all at the same time.

The model's own library merges pairs greedily; the shortest path over the same
scores may choose other pieces. Decoding gives back every text exactly, also
texts that hold the word mark itself (it goes through byte fallback).

Nulls: a null text has null ids; an empty text has none. The dummy space of a
non-empty text is dropped again by decoding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import in_task, prefix_hash, slices, span_hash, table, text_bytes

#: Where the model file is; a parameter of everything here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The word mark within a task: a byte that UTF-8 never has.
MARK = 0xFF
FALLBACK = 1e11
_SLICE = 1_000_000


@dataclass
class Transducer:
    """Arrays over the pieces of the vocabulary: bounded by its size, not by the corpus."""

    keys: np.ndarray  # hashes of the pieces' bytes, ascending
    ids: np.ndarray
    costs: np.ndarray
    lengths: np.ndarray  # the byte lengths that pieces have
    seen: np.ndarray  # a bitmap of the keys' upper bits
    spanned: np.ndarray  # bytes that some piece has
    single: np.ndarray  # bytes that are a piece
    data: np.ndarray  # all pieces' bytes by id
    offsets: np.ndarray
    first_byte: int


def compile_model(path: str = MODEL) -> Transducer:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, arcs, first = [], [], None
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            first = i if first is None else first
            texts.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            texts.append(b"")
        else:
            texts.append(model.id_to_piece(i).encode().replace("▁".encode(), bytes([MARK])))
            arcs.append(i)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    arcs = np.array(arcs)
    keys = span_hash(prefix_hash(data), offsets[arcs], offsets[arcs + 1])
    order = np.argsort(keys)
    seen = np.zeros(1 << 22, bool)
    seen[(keys >> np.uint64(42)).astype(np.int64)] = True
    spanned = np.zeros(256, bool)
    for i in arcs:
        spanned[data[offsets[i] : offsets[i + 1]]] = True
    single = np.zeros(256, bool)
    single[[data[offsets[i]] for i in arcs if offsets[i + 1] - offsets[i] == 1]] = True
    costs = np.array([-model.get_score(int(i)) for i in arcs[order]])
    return Transducer(keys[order], arcs[order].astype(np.int32), costs, np.unique(np.diff(offsets)[arcs]), seen, spanned, single, data, offsets, first)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _paths(t: Transducer, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shortest paths of the parts [start, end) of data: ids one after the other, and how many each part has."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    body = data[_ragged(starts, sizes)]
    n = len(body)
    local = np.arange(n) - np.repeat(offsets[:-1], sizes)
    left = np.repeat(sizes, sizes) - local
    prefix = prefix_hash(body)
    at = np.flatnonzero(~t.single[body])  # bytes that are a piece need no dearer arc
    begin, end, piece, cost = [at], [at + 1], [body[at].astype(np.int32) + t.first_byte], [np.full(len(at), FALLBACK)]
    at = np.arange(n)
    for size in t.lengths:
        at = at[left[at] >= size]
        if not len(at):
            break
        keys = span_hash(prefix, at, at + size)
        ok = t.seen[(keys >> np.uint64(42)).astype(np.int64)]
        some, keys = at[ok], keys[ok]
        k = np.minimum(np.searchsorted(t.keys, keys), len(t.keys) - 1)
        ok = t.keys[k] == keys
        some, k = some[ok], k[ok]
        begin.append(some)
        end.append(some + size)
        piece.append(t.ids[k])
        cost.append(t.costs[k])
    begin, end, piece, cost = map(np.concatenate, (begin, end, piece, cost))
    depth = local[end - 1]
    if n < 1 << 24:
        order = np.argsort((depth << 38) | (end << 14) | np.minimum(end - begin, 16383))
    else:
        order = np.lexsort((end - begin, end, depth))
    begin, end, piece, cost, depth = begin[order], end[order], piece[order], cost[order], depth[order]
    # a state for each position, and one more for the start of each part: state of position p in part k is p + k
    part = np.repeat(np.arange(len(sizes)), sizes)
    source = begin + part[begin]
    target = end + part[end - 1]
    best = np.zeros(n + len(sizes))
    back = np.zeros(n + len(sizes), np.int64)
    bounds = np.searchsorted(depth, np.arange(int(sizes.max(initial=0)) + 1))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        way = best[source[lo:hi]] + cost[lo:hi]
        goal = target[lo:hi]
        new = np.flatnonzero(np.concatenate([[True], goal[1:] != goal[:-1]]))
        least = np.minimum.reduceat(way, new)
        best[goal[new]] = least
        hit = np.flatnonzero(way == np.repeat(least, np.diff(np.append(new, hi - lo))))
        back[goal[hit[::-1]]] = hit[::-1] + lo  # the first of equal ways stays
    where = offsets[1:] + np.arange(len(sizes))
    floor = offsets[:-1] + np.arange(len(sizes))
    live, out_part, out_id = np.arange(len(sizes)), [], []
    where = where.copy()
    while len(live):
        live = live[where[live] > floor[live]]
        arc = back[where[live]]
        out_part.append(live)
        out_id.append(piece[arc])
        where[live] = source[arc]
    parts, ids = np.concatenate(out_part[::-1]), np.concatenate(out_id[::-1])
    order = np.argsort(parts, kind="stable")
    return ids[order], np.bincount(parts, minlength=len(sizes))


#: Parts solved before, kept per Python worker: keys ascending, where their ids begin, how many, all ids.
_known: dict[str, np.ndarray] = {}
_KNOWN_PARTS, _KNOWN_BYTES = 400_000, 32


def _solved(t: Transducer, keys: np.ndarray, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct parts, where each part's begin, and how many; earlier slices' parts are looked up."""
    if not np.array_equal(_known.get("vocabulary"), t.offsets):
        _known.update(vocabulary=t.offsets, keys=np.zeros(0, np.uint64), at=np.zeros(0, np.int64), counts=np.zeros(0, np.int64), ids=np.zeros(0, np.int32))
    old = _known["keys"]
    k = np.minimum(np.searchsorted(old, keys), max(len(old) - 1, 0))
    hit = old[k] == keys if len(old) else np.zeros(len(keys), bool)
    new = np.flatnonzero(~hit)
    fresh, n = _paths(t, body, starts[new], ends[new]) if len(new) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    ids = np.concatenate([_known["ids"], fresh])
    at, counts = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    at[hit], counts[hit] = _known["at"][k[hit]], _known["counts"][k[hit]]
    at[new], counts[new] = np.cumsum(n) - n + len(_known["ids"]), n
    short = new[(ends - starts)[new] <= _KNOWN_BYTES][: _KNOWN_PARTS - len(old)]
    if len(short):
        joined = np.concatenate([old, keys[short]])
        order = np.argsort(joined)
        kept = ids[_ragged(at[short], counts[short])]
        begin = np.cumsum(counts[short]) - counts[short] + len(_known["ids"])
        _known.update(keys=joined[order], at=np.concatenate([_known["at"], begin])[order], counts=np.concatenate([_known["counts"], counts[short]])[order], ids=np.concatenate([_known["ids"], kept]))
    return ids, at, counts


def encode_bytes(t: Transducer, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and the offsets of each row's."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    shift = np.cumsum(sizes > 0)
    # the normaliser: a mark in front of each text, and one for each space
    begin = offsets[:-1] + shift - (sizes > 0)
    body = np.full(len(data) + int((sizes > 0).sum()), MARK, np.uint8)
    body[np.arange(len(data)) + np.repeat(shift, sizes)] = np.where(data == 0x20, MARK, data)
    if not len(body):
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    mark, alone = body == MARK, ~t.spanned[body]
    cut = np.zeros(len(body), bool)
    cut[1:] = (mark[1:] & ~mark[:-1]) | alone[1:] | alone[:-1]
    cut[begin[sizes > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(body))
    keys, first, same = np.unique(span_hash(prefix_hash(body), starts, ends), return_index=True, return_inverse=True)
    ids, at, counts = _solved(t, keys, body, starts[first], ends[first])
    each = counts[same]
    out = ids[_ragged(at[same], each)]
    row = np.searchsorted(begin[sizes > 0], starts, side="right") - 1
    total = np.zeros(rows, np.int64)
    total[sizes > 0] = np.bincount(row, each, int((sizes > 0).sum())).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(total)])


def decode_bytes(t: Transducer, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and the offsets of each row's."""
    sizes = np.diff(t.offsets)[ids]
    body = t.data[_ragged(t.offsets[ids], sizes)]
    raw = np.repeat((ids >= t.first_byte) & (ids < t.first_byte + 256), sizes)
    body = np.where((body == MARK) & ~raw, 0x20, body).astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
    some = np.diff(ends) > 0
    keep = np.ones(len(body), bool)
    keep[ends[:-1][some]] = False  # the dummy space
    return body[keep], ends - np.concatenate([[0], np.cumsum(some)])


def encode(documents: DataFrame, path: str = MODEL, check: bool = True) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip): round_trip tells whether decoding the ids gave the text's bytes again."""
    shared = documents.sparkSession.sparkContext.broadcast(compile_model(path))

    def run(batches):
        t = shared.value
        for batch in batches:
            column = batch.column(1)
            data, offsets = text_bytes(column)
            missing = np.asarray(column.is_null())
            for i, j in slices(offsets, _SLICE):
                own, body = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
                ids, at = encode_bytes(t, body, own)
                same = np.ones(j - i, bool)
                if check:
                    back, ends = decode_bytes(t, ids, at)
                    if len(back) != len(body) or (back != body).any():
                        same = np.array([bytes(back[ends[k] : ends[k + 1]]) == bytes(body[own[k] : own[k + 1]]) for k in range(j - i)])
                gone = missing[i:j]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(gone, False)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(np.diff(at)), lists, pa.array(same, mask=gone)], names=["doc_id", "n_ids", "ids", "round_trip"])

    return documents.select("doc_id", "text").mapInArrow(in_task(run), "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); ids outside the vocabulary raise, null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(compile_model(path))

    def run(batches):
        t = shared.value
        for batch in batches:
            column = batch.column(1)
            gone = np.asarray(column.is_null())
            column = column.fill_null(pa.scalar([], column.type)) if gone.any() else column
            flat, at = np.asarray(column.flatten()), np.asarray(column.offsets).astype(np.int64)
            data, ends = decode_bytes(t, flat, at - at[0])
            texts = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            values = [None if gone[k] else texts[k].as_py().decode("utf-8", "replace") for k in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(in_task(run), "doc_id long, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
