"""Spelling variants, hard negatives and source mixes against plain versions, and on odd inputs."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import hard_negatives, source_mix, spelling_groups

# --- spelling variants -------------------------------------------------------------


def runs(text):
    out = [""]
    for c in text or "":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
            out[-1] += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif out[-1]:
            out.append("")
    return [x for x in out if x]


def plain_words(rows, shortest, least):
    n = Counter()
    for key, text in rows:
        for w in runs(text):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def end(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), end(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


@pytest.fixture(scope="module")
def words():
    r = random.Random(5)
    stems = ["".join(r.choices(("th", "er", "on", "an", "é", "ion", "s", "ß"), k=r.randint(3, 6))) for _ in range(60)]
    made = set(stems)
    for _ in range(500):
        w = r.choice(sorted(made))
        i = r.randrange(len(w) + 1)
        made.add(r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice("anté") + w[i:], w[:i] + r.choice("orsé") + w[i + 1 :])))
    made |= {"a" * 5, "a" * 6, "b" * 300, "b" * 301, "b" * 299 + "c", "ab" * 40, "ab" * 39 + "aa"}
    return {w: 3 + r.choice((0, 0, 1, 5, 20, 100)) for w in made if len(w) >= 5}


@pytest.mark.parametrize(("most", "longest"), [(500_000, 8), (40, 8), (2_000, 3), (10, 2)])
def test_variants_against_all_pairs(spark, words, most, longest):
    # whatever the dictionary holds, the result is the same
    got = spelling_groups.variants(spark.createDataFrame(sorted(words.items()), "word string, n long"), most, longest)
    assert {tuple(r) for r in got.collect()} == plain_variants(words)
    assert got.count() == len(words)


def test_roots_follow_long_chains(spark):
    # each form is one edit and twice as frequent: a chain of eleven
    chain = ["x" * k + "yz" * 4 for k in range(12)]
    words = {w: 3 * 2**k for k, w in enumerate(chain)}
    got = {r.word: r.root for r in spelling_groups.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1]}


def test_words_of_texts(spark, odd, docs):
    r = random.Random(2)
    vocabulary = ["Their", "there", "École", "NAÏVE", "naïve", "x×y÷zzz", "plain", "plains"]
    texts = [" ".join(r.choices(vocabulary, k=300)) + "9words_Between;plain" for _ in range(40)]
    table = docs(texts).union(odd)
    got = {r.word: r.n for r in spelling_groups.count_words(table).collect()}
    want = plain_words([(r.doc_id, r.text) for r in table.collect()], 5, 3)
    assert got == want and any(w not in {x.lower() for x in vocabulary} for w in want)


def test_variants_of_nothing(spark, docs):
    got = spelling_groups.variants(spelling_groups.count_words(docs([None, "", "12 34", "ab cd"])))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


# --- hard negatives ----------------------------------------------------------------


def plain_negatives(rows, anchors, positives, negatives, low, high):
    """rows: (id, label, whole-numbered vector), distinct."""
    out = []
    for a in anchors:
        scored = sorted(((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r) for r in rows if r != a and len(r[2]) == len(a[2])), key=lambda s: s[:2])
        near = [s for s in scored if s[2][1] == a[1]][:positives]
        for p in near:
            fits = [s for s in scored if s[2][1] != a[1] and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            out += [(a[0], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(fits[:negatives])]
    return sorted(out)


EMBEDDING = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("block", "scale"), [(2048, 1.0), (3, 1.0), (7, 1e6)])
def test_negatives_against_plain_version(spark, block, scale):
    r = random.Random(4)
    # few values, so that scores tie often and windows overlap
    table = [(i, [r.choice((-1, 0, 0.25, 0.5)) * scale for _ in range(4)], r.randrange(3)) for i in range(300)]
    rows = hard_negatives.usable(spark.createDataFrame(table, EMBEDDING))
    got = hard_negatives.mine(rows, rows.where("id % 20 = 0"), block=block)
    plain = [(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in table]
    want = plain_negatives(plain, [x for x in plain if x[0] % 20 == 0], 5, 10, 30, 90)
    assert sorted(map(tuple, got.collect())) == want and want


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    table = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2), (3, [0.25, 0.5], 2), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (10, [1.0, 1.0, 1.0], 1), (11, [], 1), (12, [-1.0, -1.0], 1)]
    d = spark.createDataFrame(table, EMBEDDING).selectExpr("*", "'x' AS anchor_id", "1 AS key", "2 AS h")
    rows = hard_negatives.usable(d)
    got = sorted(map(tuple, hard_negatives.mine(rows, rows.where("id = 0")).collect()))
    # the repeated row counts once; the positive with a score below zero opens no window
    assert got == [(0, 1, 1, 2, 131072, 65536), (0, 1, 2, 3, 131072, 49152)]
    none = hard_negatives.mine(rows.where("id < 0"), rows.where("id < 0"))
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_rows_of_one_id_and_zero_scores(spark):
    # two rows of id 0 that differ are two anchors; a positive of score 0 takes negatives of score 0, also those with smaller ids
    table = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (7, [0.0, 0.5], 1), (3, [0.0, 3.0], 2), (9, [0.0, 2.0], 2)]
    rows = hard_negatives.usable(spark.createDataFrame(table, EMBEDDING))
    got = sorted(map(tuple, hard_negatives.mine(rows, rows.where("id = 0")).collect()))
    zero = [(0, p, k + 1, i, 0, 0) for p in (0, 7) for k, i in enumerate((3, 9))]
    assert got == sorted(zero)


def test_keys_sort_as_their_parts():
    r = np.random.default_rng(0)
    parts = [r.integers(-(2**63), 2**63 - 1, 200) for _ in range(5)]
    parts = [np.where(r.random(200) < 0.5, x % 3 - 1, x) for x in parts]
    kind = r.random(200) < 0.5
    keys = hard_negatives.pack(parts[0], parts[1], parts[2], kind, parts[3], parts[4])
    back = hard_negatives.unpack(keys)
    for x, y in zip(back, (parts[0], parts[1], parts[2], kind, parts[3], parts[4])):
        assert (x == y).all()
    rows = list(zip(*(x.tolist() for x in back), strict=True))
    raw = keys.to_pylist()
    assert sorted(range(200), key=lambda i: raw[i]) == sorted(range(200), key=lambda i: (rows[i][0], rows[i][1], -rows[i][2], *rows[i][3:]))


# --- source mixes ------------------------------------------------------------------


def plain_targets(words):
    names = sorted((s for s in words if s is not None)) + [None] * (None in words)
    weight = dict(zip(names, (5, 2, 1) * len(names)))
    target, left, total = {}, set(names), sum(words.values())
    while left:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > 3 * words[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 3 * words[s]
        left -= above
    return target


def plain_tilt(sizes, target):
    mean = sum(sizes) / len(sizes)
    lo, hi = -1e6, 1e6
    for _ in range(400):
        mid = (lo + hi) / 2
        if sum(s * min(3, math.exp(min(700, mid * s / mean))) for s in sizes) < target:
            lo = mid
        else:
            hi = mid
    return lambda s: min(3, math.exp(min(700, hi * s / mean)))


def test_mix_against_plain_version(spark):
    r = random.Random(8)
    rows = []
    for source, n in (("a", 400), ("B", 300), ("é", 30), ("", 200), (None, 100), ("tiny", 3), ("empty", 2)):
        for _ in range(n):
            k = 0 if source == "empty" else r.choice((0, 1, 2, 3, 5, 8, 8, 8, 40, r.randint(1, 200)))
            rows.append((len(rows), " ".join(["w x"] * k) + "\t" * (k % 2), source))
    rows += [(None, "one two", "a"), (None, "one two", "a"), (5, None, "B"), (5, "\x0b\x0c ", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS key", "3 AS part", "'t' AS target")
    got = source_mix.mix(d).collect()
    again = source_mix.mix(d.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    size_of = lambda t: len((t or "").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")) - (t or "").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ").count("")
    by_source = defaultdict(list)
    for _, t, s in rows:
        by_source[s].append(size_of(t))
    words = {s: sum(x) for s, x in by_source.items()}
    target = plain_targets(words)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, size_of(t), words[s]) for i, t, s in rows)
    source_of = {words[s]: s for s in words}
    assert len(source_of) == len(words)
    taken, copies = Counter(), defaultdict(list)
    for x in got:
        s = source_of[x.source_size]
        assert math.isclose(x.target, target[s], rel_tol=1e-12)
        assert x.taken <= 3 * x.size and (not x.size or x.taken % x.size == 0)
        taken[s] += x.taken
        if x.size:
            copies[s, x.size].append(x.taken // x.size)
    for s, sizes in by_source.items():
        if not words[s] or target[s] >= 3 * words[s]:
            assert taken[s] == 3 * words[s]
            continue
        rate = plain_tilt(sizes, target[s])
        # the same rates, rounded so that what a size misses goes on to the next smaller one
        over = 0.0
        for z in sorted({x for x in sizes if x}, reverse=True):
            n = sizes.count(z)
            want = over + n * z * rate(z)
            k = sum(copies[s, z])
            assert len(copies[s, z]) == n and max(copies[s, z]) - min(copies[s, z]) <= 1
            least = math.floor(rate(z) + 1e-9)
            free = min(max(want / z, least * n), min(least + 1, 3) * n)
            assert abs(k - free) <= 0.5 + 1e-3
            over = want - k * z
        assert abs(taken[s] - target[s]) <= 5


def test_mix_splits_one_large_cell(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "_PART", 1)
    rows = [(i, "one two three", "a") for i in range(500)] + [(i, "x y", "b") for i in range(500, 540)]
    got = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    words = {"a": 1500, "b": 80}
    target = plain_targets(words)
    assert target["b"] == 240 and sum(r.taken for r in got if r.size == 2) == 240
    assert abs(sum(r.taken for r in got if r.size == 3) - target["a"]) <= 2


def test_mix_of_nothing(spark, odd):
    none = source_mix.mix(odd.where("false"))
    assert none.columns == ["doc_id", "size", "source_size", "target", "taken"] and none.count() == 0
    blank = source_mix.mix(odd.where("text IS NULL OR trim(text) = ''")).collect()
    assert blank and all(r.size == r.taken == 0 and r.target == 0 for r in blank)
    assert len(source_mix.mix(odd).collect()) == odd.count()
