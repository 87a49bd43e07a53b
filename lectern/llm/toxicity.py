"""Toxicity: a linear-chain conditional random field over the words of a text.

Two labels a word (0 clean, 1 toxic). A word's features are its hash and the
hashes of its first 4, 5 and 6 bytes, as far as the lexicon has them; the
lexicon is learned from documents whose label is known, and so are the weights
and transitions. Words without a feature of the lexicon all have the same
potentials, so a run of k of them is the k-th power of one 2x2 matrix and
forward-backward visits only the words with features: exact, and linear in hits.

Document score: noisy-or of the marginals of label 1, calibrated by a logistic
regression on the same labelled sample. Offending spans are the words whose
marginal is 0.5 or more.

Nulls: a null text counts as empty and scores as a text without hits; rows with
null labels or ids teach nothing; repeated labels of a document count once (the
largest). Without labels the score is 0. Repeated rows are scored each for itself.
Other columns don't matter and go through keep_clean as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import held_out, in_task, lower_ascii, prefix_hash, slices, span_hash, table, text_bytes, word_spans

#: Labelled documents that the model is fitted on, at most (chosen by a hash of their ids).
TRAIN_DOCS = 12_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
_FAR = 512

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z, and the capitals of Latin-1 in UTF-8."""
    out = lower_ascii(data)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    return np.where(after & (out >= 0x80) & (out <= 0x9E) & (out != 0x97), out + 32, out).astype(np.uint8)


def _features(data: np.ndarray, offsets: np.ndarray):
    """Word rows and spans, and the hashes of each word (0: the word; then its prefixes, 0 where the word is shorter)."""
    low = _lower(data)
    starts, ends, rows = word_spans(low, offsets, WORD)
    prefix = prefix_hash(low)
    columns = [np.where(ends - starts >= 3, span_hash(prefix, starts, ends), 0).astype(np.uint64)]
    for n in PREFIXES:
        stop = np.minimum(starts + n, len(low))
        columns.append(np.where(ends - starts > n, span_hash(prefix, starts, stop) ^ np.uint64(n), 0).astype(np.uint64))
    return starts, ends, rows, columns


@dataclass
class Model:
    """Everything that scoring needs. Its features come from the bounded sample, so it travels in closures."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0
    trans: np.ndarray = field(default_factory=lambda: np.array([[0.0, -1.0], [0.0, 0.0]]))
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float = 0.0

    def filters(self) -> np.ndarray:
        seen = np.zeros(1 << 18, bool)
        seen[(self.keys >> np.uint64(46)).astype(np.int64)] = True
        return seen


def _powers_of(step: np.ndarray) -> np.ndarray:
    """step**k for k below _FAR, each scaled to largest entry 1, and their log scales; beyond, the ratio of columns no longer changes."""
    out, cur = np.empty((_FAR, 2, 2)), np.eye(2)
    for k in range(_FAR):
        out[k] = cur
        cur = cur @ step
        cur /= cur.max()
    return out


def _log_scales(step: np.ndarray) -> np.ndarray:
    out, cur, s = np.empty(_FAR + 1), np.eye(2), 0.0
    for k in range(_FAR + 1):
        out[k] = s
        cur = cur @ step
        m = cur.max()
        s, cur = s + np.log(m), cur / m
    return out


def forward_backward(docs: np.ndarray, places: np.ndarray, lengths: np.ndarray, emit: np.ndarray, bias: float, trans: np.ndarray):
    """Marginals of label 1 of the given words, and log Z of each document that has one.

    docs: document number of each word, ascending; places: its index among the
    words of the document; lengths: words by document; emit: score of label 1.
    """
    step = np.exp(trans) * np.array([1.0, np.exp(bias)])
    far, scale = _powers_of(step), _log_scales(step)
    growth = scale[_FAR] - scale[_FAR - 1]

    def gap(k):
        k = np.maximum(k, 0)
        near = np.minimum(k, _FAR - 1)
        return far[near], scale[near] + np.maximum(k - near, 0) * growth

    ids, first, counts = np.unique(docs, return_index=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    first, counts, lens = first[order], counts[order], lengths[ids[order]]
    n, most = len(ids), int(counts.max(initial=0))
    hit = np.stack([np.ones(len(emit)), np.exp(np.clip(emit, -30, 30))], 1)
    alpha, beta = np.empty((len(emit), 2)), np.empty((len(emit), 2))
    logz = np.zeros(n)
    # what stands before the first word with features: a run of background words that starts the chain
    head = np.array([1.0, np.exp(bias)])
    for t in range(most):
        live = int(np.searchsorted(-counts, -t, side="left"))  # documents with more than t hits come first
        at = first[:live] + t
        if t == 0:
            k = places[at]
            m, s = gap(k - 1)
            v = np.where((k > 0)[:, None], np.einsum("i,nij->nj", head, m) @ np.exp(trans), 1.0)
            logz[:live] += np.where(k > 0, s, 0)
        else:
            m, s = gap(places[at] - places[at - 1] - 1)
            v = np.einsum("ni,nij->nj", alpha[at - 1], m) @ np.exp(trans)
            logz[:live] += s
        v = v * hit[at]
        top = v.sum(1)
        alpha[at] = v / top[:, None]
        logz[:live] += np.log(top)
    last = first + counts - 1
    m, s = gap(lens - 1 - places[last])
    end = m.sum(2)
    logz += s + np.log((alpha[last] * end).sum(1))
    beta[last] = end / end.max(1, keepdims=True)
    for t in range(most - 2, -1, -1):
        live = int(np.searchsorted(-counts, -(t + 1), side="left"))
        at = first[:live] + t
        m, _ = gap(places[at + 1] - places[at] - 1)
        v = np.einsum("nij,nj->ni", m @ np.exp(trans), hit[at + 1] * beta[at + 1])
        beta[at] = v / v.max(1, keepdims=True)
    post = alpha * beta
    back = np.empty(n)
    back[order] = logz
    return post[:, 1] / post.sum(1), back


def background_logz(lengths: np.ndarray, bias: float, trans: np.ndarray) -> np.ndarray:
    step = np.exp(trans) * np.array([1.0, np.exp(bias)])
    far, scale = _powers_of(step), _log_scales(step)
    k = np.maximum(lengths - 1, 0)
    near = np.minimum(k, _FAR - 1)
    v = np.einsum("i,nij->n", np.array([1.0, np.exp(bias)]), far[near])
    return np.where(lengths > 0, np.log(v) + scale[near] + (k - near) * (scale[_FAR] - scale[_FAR - 1]), 0.0)


def _hits(model: Model, seen: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    starts, ends, rows, columns = _features(data, offsets)
    lengths = np.bincount(rows, minlength=len(offsets) - 1)
    base = np.concatenate([[0], np.cumsum(lengths)])
    maybe = np.zeros(len(rows), bool)
    for c in columns:
        maybe |= seen[(c >> np.uint64(46)).astype(np.int64)] & (c != 0)
    at = np.flatnonzero(maybe)
    found = np.full((len(at), len(columns)), -1)
    for j, c in enumerate(columns):
        k = np.minimum(np.searchsorted(model.keys, c[at]), max(len(model.keys) - 1, 0))
        if len(model.keys):
            found[:, j] = np.where(model.keys[k] == c[at], k, -1)
    keep = (found >= 0).any(1)
    at, found = at[keep], found[keep]
    return starts[at], ends[at], rows[at], at - base[rows[at]], lengths, found


def _emit(model_weights: np.ndarray, bias: float, found: np.ndarray) -> np.ndarray:
    return bias + np.where(found >= 0, model_weights[found], 0.0).sum(1) if len(found) else np.zeros(0)


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most train_docs labelled documents, all of them outside the held-out fold. The lexicon: features of three toxic documents or more, and of four times as many as clean ones."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", 4, 2))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_docs)
    )
    # at most train_docs rows of two numbers: the bound that lets this side be broadcast
    sample = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def count(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            label = np.asarray(batch.column(2))
            for i, j in slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                _, _, rows, columns = _features(data[offsets[i] : offsets[j]], own)
                keys, docs = np.concatenate(columns), np.concatenate([rows] * len(columns))
                keys, docs = keys[keys != 0], docs[keys != 0]
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
                keys, pos = keys[new], label[i:j][docs[new]]
                uniq, at, n = np.unique(keys, return_index=True, return_counts=True)
                p = np.add.reduceat(pos, at) if len(at) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(p.astype(np.int64)), pa.array((n - p).astype(np.int64))], names=["key", "pos", "neg"])

    counts = (
        sample.mapInArrow(in_task(count), "key long, pos long, neg long")
        .groupBy("key")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where("pos >= 3 AND pos >= 4 * neg")
        .toPandas()
    )
    model = Model(keys=np.sort(counts["key"].to_numpy(np.int64).view(np.uint64)))
    model.weights = np.zeros(len(model.keys))
    seen = model.filters()

    def gather(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            label = batch.column(2).to_pylist()
            for i, j in slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                _, _, rows, places, lengths, found = _hits(model, seen, data[offsets[i] : offsets[j]], own)
                bounds = np.searchsorted(rows, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(label[i:j], pa.int32()),
                        pa.array(lengths.astype(np.int64)),
                        pa.array([places[bounds[k] : bounds[k + 1]].tolist() for k in range(j - i)], pa.list_(pa.int64())),
                        pa.array([found[bounds[k] : bounds[k + 1]].ravel().tolist() for k in range(j - i)], pa.list_(pa.int64())),
                    ],
                    names=["label", "n", "places", "found"],
                )

    rows = sample.mapInArrow(in_task(gather), "label int, n long, places array<long>, found array<long>").toPandas()
    if len(rows):
        _train(model, rows)
    return model


def _train(model: Model, rows) -> None:
    """Gradient ascent on the conditional likelihood of the labelled words, then the calibration."""
    label, lengths = rows["label"].to_numpy(), rows["n"].to_numpy()
    model.prior = float(label.mean())
    docs = np.repeat(np.arange(len(rows)), [len(x) for x in rows["places"]])
    if not len(docs):
        return
    places = np.concatenate([np.asarray(x, np.int64) for x in rows["places"]])
    found = np.concatenate([np.asarray(x, np.int64) for x in rows["found"]]).reshape(len(docs), -1)
    tags = label[docs].astype(float)  # labelled words: a lexicon word of a toxic document
    has = np.unique(docs)
    bare = np.setdiff1d(np.arange(len(rows)), has)
    hist, how_many = np.unique(lengths[bare], return_counts=True)
    theta, w = np.array([model.bias, model.trans[0, 1], model.trans[1, 0], model.trans[1, 1]]), np.zeros(len(model.keys))

    def pair_counts():
        """How often labels follow each other among the gold labels; all words without features are 0."""
        prev = np.where((np.arange(len(docs)) > 0) & (np.roll(docs, 1) == docs) & (np.roll(places, 1) == places - 1), np.roll(tags, 1), 0)
        follow = np.where((np.roll(docs, -1) == docs) & (np.roll(places, -1) == places + 1) & (np.arange(len(docs)) < len(docs) - 1), np.roll(tags, -1), 0)
        begins, ends = places > 0, places < lengths[docs] - 1
        return np.array([tags.sum(), (tags * (1 - prev) * begins).sum(), (tags * (1 - follow) * ends).sum(), (tags * prev * begins).sum()])

    gold = pair_counts()

    def total(th, w):
        trans = np.array([[0.0, th[1]], [th[2], th[3]]])
        post, z = forward_backward(docs, places, lengths, _emit(w, th[0], found), th[0], trans)
        free = (background_logz(hist, th[0], trans) * how_many).sum()
        return post, z.sum() + free

    slow_w, slow_t = np.full(len(w), 1e-8), np.full(4, 1e-8)
    for _ in range(60):
        post, z = total(theta, w)
        g = np.zeros(len(w))
        for c in range(found.shape[1]):
            ok = found[:, c] >= 0
            np.add.at(g, found[ok, c], (tags - post)[ok])
        g -= 0.1 * w
        gt = np.array([gold[i] - (total(theta + d, w)[1] - z) / 1e-4 for i, d in enumerate(np.eye(4) * 1e-4)]) - 0.1 * theta
        slow_w, slow_t = slow_w + g * g, slow_t + gt * gt
        w, theta = w + 0.5 * g / np.sqrt(slow_w), np.clip(theta + 0.3 * gt / np.sqrt(slow_t), -12, 6)
    model.weights, model.bias, model.trans = w, float(theta[0]), np.array([[0.0, theta[1]], [theta[2], theta[3]]])
    post, _ = forward_backward(docs, places, lengths, _emit(w, model.bias, found), model.bias, model.trans)
    x = _evidence(docs, post, lengths)
    a = np.zeros(3)
    design = np.stack([np.ones(len(rows)), *x], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(3)
        a = a + np.linalg.solve(h, design.T @ (label - p) - 0.05 * a)
    model.calibration = tuple(map(float, a))


def _evidence(docs: np.ndarray, post: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    clean = np.bincount(docs, np.log1p(-np.minimum(post, 1 - 1e-6)), len(lengths))
    return 1 - np.exp(clean), np.log1p(np.bincount(docs, post, len(lengths)))


def _scores(model: Model, seen: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Score of each row; rows, starts, ends and marginals of the words with features."""
    n = len(offsets) - 1
    starts, ends, rows, places, lengths, found = _hits(model, seen, data, offsets)
    post = np.zeros(0)
    if len(rows):
        post, _ = forward_backward(rows, places, lengths, _emit(model.weights, model.bias, found), model.bias, model.trans)
    x = np.stack([np.ones(n), *_evidence(rows, post, lengths)], 1)
    score = 1 / (1 + np.exp(-(x @ np.array(model.calibration)))) if model.prior > 0 else np.zeros(n)
    return score, rows, starts, ends, post


def tag(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_spans, spans): spans as byte offsets [start, end) with marginals, in the order of the text."""
    seen = model.filters()
    schema = "doc_id long, score double, n_spans long, spans array<struct<start:long,end:long,p:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def score(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                p, rows, starts, ends, post = _scores(model, seen, data[offsets[i] : offsets[j]], own)
                bad = post >= 0.5
                rows, starts, ends, post = rows[bad], starts[bad] - own[rows[bad]], ends[bad] - own[rows[bad]], post[bad]
                bounds = np.searchsorted(rows, np.arange(j - i + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends), pa.array(post)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(p), pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), spans)], names=["doc_id", "score", "n_spans", "spans"])

    return documents.select("doc_id", "text").mapInArrow(in_task(score), schema)


def keep_clean(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    seen = model.filters()
    place = documents.columns.index("text")

    def clean(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            for i, j in slices(offsets):
                p = _scores(model, seen, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]
                yield batch.slice(i, j - i).filter(pa.array(p < threshold))

    return documents.mapInArrow(in_task(clean), documents.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(spark, documents, table(spark, sf_dir, "labels"))
    scored = tag(documents, model)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_spans")
