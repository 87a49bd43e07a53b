"""Line dedup, suffix dedup, Jaccard join and embedding links against brute force, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import embedding_dedup, jaccard_join, line_dedup, suffix_dedup

WORDS = [f"w{k}x{k % 7}" for k in range(60)]


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(threshold):
    r = random.Random(threshold)
    pairs = []
    for _ in range(400):
        a = bytearray(r.choice(b"abc") for _ in range(r.randint(6, 30)))
        b = bytearray(a)
        for _ in range(r.randint(0, threshold + 2)):
            k = r.randrange(len(b))
            if r.random() < 0.4:
                b[k] = r.choice(b"abc")
            elif r.random() < 0.5:
                b.insert(k, r.choice(b"abc"))
            elif len(b) > 1:
                del b[k]
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if len(a) - len(b) <= threshold:
            pairs.append((bytes(a), bytes(b)))
    la, lb = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    x, y = (np.frombuffer(b"".join(p[k] for p in pairs), np.uint8) for k in (0, 1))
    got = line_dedup.banded_distance(x, np.cumsum(la) - la, la, y, np.cumsum(lb) - lb, lb, threshold)
    assert got.tolist() == [min(distance(*p), threshold + 1) for p in pairs]


def test_line_dedup_against_all_pairs(docs):
    r = random.Random(1)
    lines = [" ".join(r.choices(WORDS, k=9)) for _ in range(12)]
    for line in lines[:6]:
        b = list(line)
        for _ in range(r.randint(1, 4)):
            b[r.randrange(len(b))] = "q"
        lines.append("".join(b))
    texts = ["\n".join(r.choices([*lines, "short"], k=5)) for _ in range(14)]
    # brute force: classes of lines over all pairs, the first of each class stays
    kinds = sorted({x for t in texts for x in t.split("\n") if len(x.encode()) >= 30})
    root = components(len(kinds), [(i, j) for i in range(len(kinds)) for j in range(i) if distance(kinds[i].encode(), kinds[j].encode()) <= 2])
    name, seen, want = {k: root[i] for i, k in enumerate(kinds)}, set(), []
    for t in texts:
        kept = []
        for x in t.split("\n"):
            if x in name and name[x] in seen:
                continue
            seen.add(name.get(x, x)) if x in name else None
            kept.append(x)
        want.append("\n".join(kept))
    got = line_dedup.dedup_lines(docs(texts)).orderBy("doc_id").collect()
    assert [x.text for x in got] == want


def test_suffix_dedup_against_all_substrings(docs, spark):
    r = random.Random(2)
    shared = ["".join(r.choices("abcdefgh ", k=k)) for k in (420, 500, 399)]
    texts = ["".join(r.choices("abcdefgh ", k=r.randint(0, 300))) + r.choice(shared) + "".join(r.choices("abcdefgh ", k=r.randint(0, 300))) for _ in range(8)]
    texts += [texts[0], shared[0] + shared[0], "z" * 900, "é" * 150, None, ""]
    body = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in body:
        for p in range(len(b) - 399):
            seen[b[p : p + 400]] = seen.get(b[p : p + 400], 0) + 1
    want = {}
    for i, b in enumerate(body):
        gone = [False] * len(b)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = [True] * 400
        want[i] = (len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    rows = docs(texts).select("doc_id", "text").withColumn("row_id", suffix_dedup.row_id())
    for large in (4096, 1):  # suffix buckets sorted in tasks, and dealt by fingerprints
        found = suffix_dedup.repeats(rows, large=large)
        assert found.count() > 0
    got = suffix_dedup.remove_repeats(rows).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {x[0]: tuple(x[1:]) for x in got} == want


def test_suffix_dedup_of_edited_near_copies(docs):
    r = random.Random(5)
    letters = "abcdefgh "
    core = "".join(r.choices(letters, k=430))
    versions = []
    for _ in range(25):  # each differs from the others in its middle, and stands in two documents
        v = list(core)
        for _ in range(r.randint(1, 2)):
            v[r.randrange(90, 340)] = r.choice("QXYZ")
        versions.append("".join(v))
    texts = ["".join(r.choices(letters, k=r.randint(0, 90))) + v + "".join(r.choices(letters, k=r.randint(0, 90))) for v in versions for _ in range(2)]
    seen: dict[str, int] = {}
    for t in texts:
        for p in range(len(t) - 399):
            seen[t[p : p + 400]] = seen.get(t[p : p + 400], 0) + 1
    want = {}
    for i, t in enumerate(texts):
        gone = {q for p in range(len(t) - 399) if seen[t[p : p + 400]] > 1 for q in range(p, p + 400)}
        want[i] = "".join(c for k, c in enumerate(t) if k not in gone)
    rows = docs(texts).select("doc_id", "text").withColumn("row_id", suffix_dedup.row_id())
    got = {x.doc_id: bytes(x.kept).decode() for x in suffix_dedup.remove_repeats(rows).collect()}
    assert got == want


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components_against_all_pairs(docs, size, percent):
    r = random.Random(size)
    base = [r.choices(WORDS, k=r.randint(3, 60)) for _ in range(10)]
    texts = [" ".join(b) for b in base]
    for _ in range(40):  # near copies, many of one base
        b = list(base[r.choice((0, 0, 0, *range(10)))])
        for _ in range(r.randint(0, 3)):
            b[r.randrange(len(b))] = r.choice(WORDS)
        texts.append(" ".join(b).upper() if r.random() < 0.1 else " ".join(b))
    texts += ["", None, "one two", "One Two", " \t "]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    got = jaccard_join.components(docs(texts), size, percent).orderBy("doc_id").collect()
    assert [x.n_shingles for x in got] == [len(s) for s in sets]
    assert [x.component_id for x in got] == components(len(sets), links)


def test_jaccard_links_between_groups(docs):
    """Sets of unequal sizes that share their middle; the larger has rare words of its own, the smaller a frequent passage."""
    r = random.Random(6)
    bags = []
    for batch in range(30):
        passage = [f"p{batch}x{k}" for k in range(5)]
        for pair in range(8):
            common = [f"c{batch}x{pair}x{k}" for k in range(90)]
            bags += [common + passage, common + [f"r{batch}x{pair}x{k}" for k in range(10)]]
    for _ in range(40):  # and pairs of any sizes, some over and some under the threshold
        common = r.sample([f"m{k}" for k in range(3000)], r.randint(20, 90))
        bags += [common + r.sample([f"m{k}" for k in range(3000)], r.randint(0, 10)) for _ in range(2)]
    r.shuffle(bags)
    sets = [set(b) for b in bags]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got = jaccard_join.components(docs([" ".join(b) for b in bags]), 1, 85).orderBy("doc_id").collect()
    assert [x.component_id for x in got] == components(len(sets), links)


def vectors(n, seed=4):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 16))
    x[n // 2 :] = x[: n - n // 2] + 0.12 * r.standard_normal((n - n // 2, 16))
    x[-6:] = x[0]
    return x.astype(np.float32)


@pytest.mark.parametrize("block", [1024, 3])
def test_embedding_links_against_all_pairs(spark, block):
    x = vectors(120)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(120, None), (121, [0.0] * 16), (122, [float("nan")] * 16), (123, [1.0, 2.0])]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block, recall=0.999999).orderBy("vec_id").collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = components(120, list(zip(*np.nonzero(near))))
    assert [r.n_links for r in got] == [*near.sum(1).tolist(), 0, 0, 0, 0]
    assert [r.component_id for r in got] == [*root, 120, 121, 122, 123]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_and_empty_inputs(spark, docs, odd):
    n = odd.count()
    assert line_dedup.dedup_lines(odd).count() == n
    assert jaccard_join.components(odd, 5, 80).count() == n
    assert jaccard_join.keep_first(odd).count() < n
    rows = odd.withColumn("row_id", suffix_dedup.row_id())
    assert suffix_dedup.remove_repeats(rows).count() == n
    none = docs([])
    assert line_dedup.dedup_lines(none).count() == 0
    assert jaccard_join.components(none, 5, 80).count() == 0
    assert suffix_dedup.remove_repeats(none.withColumn("row_id", suffix_dedup.row_id())).count() == 0
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
