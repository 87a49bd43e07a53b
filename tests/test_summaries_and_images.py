"""Extractive summaries and picture kernels against plain versions."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from lectern.functions import images as I
from lectern.operators import summaries as S
from lectern.operators.sequence import _bag

WORDS = "alpha beta gamma delta river stone water bridge market price trade money".split()


@pytest.fixture(scope="module")
def sentences(spark):
    r = random.Random(8)
    rows = [(d, i, " ".join(r.choices(WORDS[: 4 + 4 * d], k=r.randint(1, 9)))) for d, n in ((1, 9), (2, 5)) for i in range(n)] + [(3, 0, "the"), (4, 0, "alpha")]
    return rows, spark.createDataFrame(rows, "doc_id long, i long, text string").persist()


def plain_rank(n, weight):
    """Twelve rounds over all pairs of n sentences; those without an edge stay outside."""
    has = [i for i in range(n) if any(weight(i, j) > 0 for j in range(n) if j != i)]
    out = {i: sum(weight(i, j) for j in has if j != i) for i in has}
    rank = {i: 1 / len(has) for i in has}
    for _ in range(12):
        rank = {j: 0.15 / len(has) + 0.85 * sum(rank[i] * weight(i, j) / out[i] for i in has if i != j) for j in has}
    return [rank.get(i, 0.0) for i in range(n)]


def test_ranks(sentences):
    rows, df = sentences
    text, lex, topics = ({(x.doc_id, x.i): x.score for x in f(df).collect()} for f in (S.text_rank, S.lex_rank, S.latent))
    for d in (1, 2, 3, 4):
        bags = [_bag(t) for doc, _, t in rows if doc == d]
        share = lambda i, j: len(set(bags[i]) & set(bags[j])) / max(1, len(bags[i]) + len(bags[j]))  # noqa: E731, B023
        df_ = Counter(w for b in bags for w in b)
        weighted = [{w: c * (math.log(len(bags) / df_[w]) + 1) for w, c in b.items()} for b in bags]
        norm = [math.sqrt(sum(v * v for v in b.values())) for b in weighted]
        like = lambda i, j: float(sum(v * weighted[j].get(w, 0) for w, v in weighted[i].items()) > 0.1 * norm[i] * norm[j] and norm[i] * norm[j] > 0)  # noqa: E731, B023
        for got, weight in ((text, share), (lex, like)):
            assert [got[d, i] for i in range(len(bags))] == pytest.approx(plain_rank(len(bags), weight), abs=2e-6)
        terms = sorted({w for b in bags for w in b})
        m = np.array([[b[w] for b in bags] for w in terms], float).reshape(len(terms), len(bags))
        value, vector = np.linalg.eigh(m.T @ m)
        strength = np.sqrt((np.maximum(value[-3:], 0) * vector[:, -3:] ** 2).sum(1))
        assert [topics[d, i] for i in range(len(bags))] == pytest.approx(strength.tolist(), abs=2e-6)


def test_better_half(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.5), (2, 0, 0.0)], "doc_id long, i long, score double")
    assert sorted((x.doc_id, x.i, x.place) for x in S.better_half(df).collect()) == [(1, 0, 2), (1, 1, 1), (2, 0, 1)]


@pytest.mark.parametrize("seed", range(20))
def test_common_length(seed):
    r = random.Random(seed)
    a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
    best = max(k for k in range(len(a) + 1) if any(all(x in it for x in c) for c in itertools.combinations(a, k) for it in [iter(b)])) if b else 0
    assert S.common_length(a, b) == best


def test_rouge_l(spark):
    df = spark.createDataFrame([(1, "x", "y", ["a", "b", "c"], ["a", "c"]), (2, "x", "y", [], ["a"])], "doc_id long, target string, prediction string, a array<string>, b array<string>")
    assert sorted((x.doc_id, x.precision, x.recall, x.f) for x in S.rouge_l(df).collect()) == [(1, 1.0, 0.666667, 0.8), (2, 0.0, 0.0, 0.0)]


# --- pictures ------------------------------------------------------------------------


@pytest.fixture
def picture():
    r = np.random.default_rng(3)
    x = r.integers(0, 256, (40, 48)).astype(np.uint8)
    x[10:20, 5:30] = 20
    return x


def test_sharpness_and_gradients(picture):
    x = np.pad(picture.astype(float), 1, mode="reflect")
    laplace, edges = np.zeros(picture.shape), np.zeros(picture.shape)
    for i in range(picture.shape[0]):
        for j in range(picture.shape[1]):
            w = x[i : i + 3, j : j + 3]
            laplace[i, j] = w[0, 1] + w[2, 1] + w[1, 0] + w[1, 2] - 4 * w[1, 1]
            gx, gy = (w[:, 2] - w[:, 0]) @ [1, 2, 1], (w[2] - w[0]) @ [1, 2, 1]
            edges[i, j] = abs(gx) + abs(gy) > 140
    assert math.isclose(I.sharpness(picture), laplace.var()) and math.isclose(I.edge_density(picture), edges.mean())


def test_entropy_threshold_and_text(picture):
    n = Counter(picture.ravel().tolist())
    assert math.isclose(I.entropy(picture), -sum(c / picture.size * math.log2(c / picture.size) for c in n.values()))
    two = np.array([[10] * 5 + [200] * 5])
    assert 10 <= I.best_threshold(two) < 200
    stripes = np.tile(np.array([0, 0, 255, 255], np.uint8), (20, 10))
    assert I.textness(stripes) > I.textness(stripes.T)
    assert I.textness(np.zeros((8, 8))) == 0


def test_running_windows(picture):
    for size in (1, 2, 3, 5, 15, 60):
        for axis in (0, 1):
            got = I.running(picture, size, axis, np.maximum)
            x = np.moveaxis(picture.astype(float), axis, -1)
            want = np.stack([x[..., max(0, i - size // 2) : i - size // 2 + size].max(-1) for i in range(x.shape[-1])], -1)
            assert (np.moveaxis(got, axis, -1) == want).all()
    assert (I.eroded(picture, 3, 5) == -I.dilated(-picture.astype(float), 3, 5)).all()


def test_regions(picture):
    for share in (0.2, 0.4, 0.6):
        mask = picture < 255 * share
        got, seen = I.regions(mask), -np.ones(mask.shape, int)
        for y, x in zip(*np.nonzero(mask)):
            if seen[y, x] >= 0:
                continue
            number, todo = y * mask.shape[1] + x, [(y, x)]
            seen[y, x] = number
            while todo:
                a, b = todo.pop()
                for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[c, d] and seen[c, d] < 0:
                            seen[c, d] = number
                            todo.append((c, d))
        assert (got == seen).all()
    assert (I.regions(np.zeros((3, 4), bool)) == -1).all()


def test_thin_edges(picture):
    gx, gy = I.gradients(picture)
    force, kept = np.abs(gx) + np.abs(gy), I.thin(gx, gy)
    h, w = force.shape
    value = lambda y, x: force[y, x] if 0 <= y < h and 0 <= x < w else 0.0
    for y in range(h):
        for x in range(w):
            angle = np.degrees(np.arctan2(gy[y, x], gx[y, x])) % 180
            dy, dx = (0, 1) if angle < 22.5 or angle > 157.5 else (1, 1) if angle < 67.5 else (1, 0) if angle < 112.5 else (1, -1)
            top = force[y, x] > value(y - dy, x - dx) and force[y, x] >= value(y + dy, x + dx)
            assert kept[y, x] == (force[y, x] if top else 0)
    step = np.zeros((9, 20), np.uint8)
    step[:, 10:] = 30 + 2 * np.arange(9)[:, None]
    force = I.thin(*I.gradients(step))
    assert 60 < force[0].max() < 160 < force[8].max()  # weak at one end of the edge, strong at the other
    found = I.edges(step)
    assert found.sum(1).max() == 1 and found.any(1).all()
    assert not I.edges(np.where(step > 0, 30, 0)).any()


def test_likeness(picture):
    assert math.isclose(I.likeness(picture, picture), 1.0)
    other = picture[::-1]
    a, b, total, n = picture.astype(float), other.astype(float), 0.0, 0
    for i in range(a.shape[0] - 6):
        for j in range(a.shape[1] - 6):
            p, q = a[i : i + 7, j : j + 7].ravel(), b[i : i + 7, j : j + 7].ravel()
            c = np.cov(p, q)
            total += ((2 * p.mean() * q.mean() + 6.5025) * (2 * c[0, 1] + 58.5225)) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225))
            n += 1
    assert math.isclose(I.likeness(picture, other), total / n, rel_tol=1e-9)


def test_hash_shift_and_overlap(picture):
    big = np.kron(picture, np.ones((4, 4)))
    bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert bits(I.perceptual_hash(picture), I.perceptual_hash(big)) <= 4 < bits(I.perceptual_hash(picture), I.perceptual_hash(255 - picture))
    moved = np.roll(picture, (3, -5), (0, 1))
    dx, dy, response = I.shift_between(picture, moved)
    assert (dx, dy) == (-5, 3) and response > 0.9
    a, b = I.overlap(picture, moved, dx, dy)
    assert a.shape == b.shape == (37, 43) and (a == b).all()


def test_ink_crop_and_straighten(picture):
    page = np.full((20, 20), 255, np.uint8)
    page[5:8, 5:15] = 0
    page[15, 15] = 0  # a speck
    mask = I.ink(page)
    assert mask[4:9, 4:16].all() and not mask[14:17, 14:17].any() and mask.sum() == 5 * 12
    assert I.cropped(picture, 5, 10, 30, 20).shape == (10, 25) and I.cropped(picture, 5, 10, 9, 12).shape == picture.shape
    corners = np.array([[5, 10], [29, 10], [29, 19], [5, 19]])
    assert (I.straightened(picture, corners, 10, 25) == picture[10:20, 5:30]).all()


def test_picture_metrics(spark, picture):
    rows = [(1, 48, picture.tobytes()), (2, 64, b"short")]
    got = {x.k: x for x in I.picture_metrics(spark.createDataFrame(rows, "k long, width int, pixels binary"), "k").collect()}
    assert math.isclose(got[1].sharp, I.sharpness(I.blurred(picture))) and got[1].phash == I.perceptual_hash(I.blurred(picture))
    assert len(got[2].phash) == 16
