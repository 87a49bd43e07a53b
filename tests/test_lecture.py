"""The note builder's order-dependent operators against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import lecture as L
from lectern.operators.sequence import _bag, _cos, best_path, merge_rows, pack_windows

TOPICS = ("alpha beta gamma delta", "river stone water bridge", "market price trade money", "planet orbit star moon")
CUES = ("Next we look at ", "Now ", "")


def lecture(seed: int, n: int):
    r = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        topic = TOPICS[min(3, i * 4 // n)].split()
        text = r.choice(CUES) + " ".join(r.choices([*topic, *(w for x in TOPICS for w in x.split())], [5] * 4 + [1] * 16, k=r.randint(4, 14)))
        rows.append((seed, i, t, t + len(text) / 15, text))
        t += len(text) / 15
    return rows


@pytest.fixture(scope="module")
def lectures(spark):
    rows = [x for d, n in ((1, 60), (2, 25), (3, 4), (4, 140)) for x in lecture(d, n)]
    items = spark.createDataFrame(rows, "doc_id long, i long, a double, b double, text string").withColumn("n", F.length("text").cast("long")).persist()
    packed = pack_windows(items, with_text=True).persist()
    plan = L.fallback_plan(items).persist()
    return {d: [r for r in rows if r[0] == d] for d in (1, 2, 3, 4)}, items, packed, plan


def plain_rating(items, first, last, plan, whole):
    own = _bag(" ".join(x[4] for x in items[first : last + 1]))
    pos = min(1.0, max(0.0, ((items[first][2] + items[last][3]) / 2 - whole[0]) / max(1e-6, whole[1] - whole[0])))
    k = len(plan)
    scores = [np.floor((0.85 * _cos(own, _bag(f"{t}. {d}")) + 0.15 * (max(0.0, 1 - abs(pos - j / (k - 1))) if k > 1 else 0.0)) * 1e6 + 0.5) / 1e6 for j, (t, d) in enumerate(plan)]
    e = np.exp((np.array(scores) - max(scores)) / 0.35)
    p = np.sort(e / e.sum())[::-1]
    sure, margin = (np.floor(v * 1e6 + 0.5) / 1e6 for v in (p[0], p[0] - (p[1] if k > 1 else 0.0)))
    return int(np.argmax(scores)), sure, margin, bool(sure < 0.45 or margin < 0.15), (e / e.sum()).tolist()


def plain_split(items, first, last, plan, whole, depth=0):
    rated = plain_rating(items, first, last, plan, whole)
    if rated[3] and depth < 4 and items[last][3] - items[first][2] >= 20 and last - first + 1 > 2:
        middle = (items[first][2] + items[last][3]) / 2
        at = min(range(first, last), key=lambda i: (abs(items[i][3] - middle), i))
        if first < at < last:
            return plain_split(items, first, at, plan, whole, depth + 1) + plain_split(items, at + 1, last, plan, whole, depth + 1)
    return [(first, last, *rated)]


def test_recursive_split_and_segments(lectures):
    rows, items, packed, plan = lectures
    classified = L.classify(items, packed.select("doc_id", "first"), plan).persist()
    got, windows, plans = classified.collect(), packed.collect(), plan.collect()
    segments = L.build_segments(items, classified, plan).collect()
    split_once = 0
    for d, own in rows.items():
        p = [(x.title, x.description) for x in sorted((x for x in plans if x.doc_id == d), key=lambda x: x.section)]
        mine = sorted((w.first, w.last) for w in windows if w.doc_id == d)
        whole = (own[0][2], own[-1][3])
        want = [x for a, b in mine for x in plain_split(own, a, b, p, whole)]
        split_once += len(want) > len(mine)
        assert sorted((x.win, x.last, x.best, x.confidence, x.ambiguous) for x in got if x.doc_id == d) == [(x[0], x[1], x[2], pytest.approx(x[3]), x[5]) for x in want]
        labels = best_path([x[6] for x in want])
        cuts = [want[k][1] for k in range(len(want) - 1) if labels[k] != labels[k + 1]]
        ranges = [{"first": a, "last": b, "start": own[a][2], "fin": own[b][3], "text": " ".join(x[4] for x in own[a : b + 1])} for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(own) - 1])]
        merged = merge_rows(ranges, 30.0)
        expect = []
        for s in merged:
            cover: dict[int, float] = {}
            for x, label in zip(want, labels):
                both = min(s["fin"], own[x[1]][3]) - max(s["start"], own[x[0]][2])
                if both > 0:
                    cover[label] = cover.get(label, 0.0) + both
            best = max(cover, key=lambda k: round(cover[k], 6))
            expect.append((s["first"], s["last"], best, p[best][0]))
        assert sorted((x.first, x.last, x.section, x.title) for x in segments if x.doc_id == d) == expect
    assert split_once


def plain_rough(own, ends, target, least, most):
    """Every candidate against all cuts so far; then the first too long range, again and again."""
    cuts: list[int] = []
    for c in ends:
        if len(cuts) < target - 1:
            edges = sorted([*cuts, c])
            k = edges.index(c)
            begin, stop = (edges[k - 1] + 1 if k else 0), (edges[k + 1] if k + 1 < len(edges) else len(own) - 1)
            if own[c][3] - own[begin][2] >= least and own[stop][3] - own[c + 1][2] >= least:
                cuts.append(c)
    changed = True
    while changed:
        changed = False
        edges = sorted(cuts)
        for a, b in zip([0, *[c + 1 for c in edges]], [*edges, len(own) - 1]):
            if own[b][3] - own[a][2] > most:
                fit = [c for c in range(a, b) if own[c][3] - own[a][2] >= least and own[b][3] - own[c + 1][2] >= least]
                if fit:
                    cuts.append(min(fit, key=lambda c: (abs(own[c][3] - own[a][2] - most), c)))
                    changed = True
                    break
    return sorted(cuts)


@pytest.mark.parametrize("seed", range(30))
def test_choose_cuts(seed):
    r = random.Random(seed)
    own = lecture(seed, r.randint(2, 120))
    ends = r.sample(range(len(own) - 1), r.randint(0, len(own) - 1))
    target, least, most = r.randint(1, 8), r.choice((5.0, 15.0, 30.0)), r.choice((40.0, 90.0, 300.0))
    a, b = np.array([x[2] for x in own]), np.array([x[3] for x in own])
    assert L.choose_cuts(a, b, ends, target, least, most) == plain_rough(own, ends, target, least, most)


def test_rough_and_refined_segments(lectures):
    rows, items, packed, _ = lectures
    scores = L.boundary_scores(packed, items).collect()
    rough = L.rough_segments(items, packed, least=30.0, most=120.0).persist()
    got = rough.collect()
    refined = L.refine_boundaries(items, rough, packed, lambda b: b.select("doc_id", "seg", (F.col("time") + 12).alias("chosen"))).collect()
    wins = packed.collect()
    span = lambda own, a, b: {"first": a, "last": b, "start": own[a][2], "fin": own[b][3], "text": " ".join(x[4] for x in own[a : b + 1])}
    cut_up = lambda own, cuts: merge_rows([span(own, a, b) for a, b in zip([0, *[c + 1 for c in sorted(set(cuts))]], [*sorted(set(cuts)), len(own) - 1])], 30.0)
    for d, own in rows.items():
        mine = sorted((-x.score, x.win, x.last) for x in scores if x.doc_id == d)
        target = max(1, min(12, round((own[-1][3] - own[0][2]) / 180.0) + 1))
        want = cut_up(own, plain_rough(own, [x[2] for x in mine], target, 30.0, 120.0))
        assert sorted((x.first, x.last) for x in got if x.doc_id == d) == [(x["first"], x["last"]) for x in want]
        cuts, ends = [x["last"] for x in want[:-1]], [w.fin for w in sorted((w for w in wins if w.doc_id == d), key=lambda w: w.win)]
        for k, old in enumerate(list(cuts)):
            near = [min(range(len(own) - 1), key=lambda i: (abs(own[i][3] - e), i)) for e in ends if abs(e - own[old][3]) <= 70]
            if near:
                trial = [*cuts[:k], min(near, key=lambda i: abs(own[i][3] - (own[old][3] + 12))), *cuts[k + 1 :]]
                edges = sorted(set(trial))
                if all(own[q][3] - own[p][2] >= 30 for p, q in zip([0, *[c + 1 for c in edges]], [*edges, len(own) - 1])):
                    cuts = trial
        assert sorted((x.first, x.last) for x in refined if x.doc_id == d) == [(x["first"], x["last"]) for x in cut_up(own, cuts)]


def test_attached_frames(lectures):
    rows, items, packed, _ = lectures
    segs = packed.select("doc_id", F.col("win").alias("seg"), "start", "fin", "text")
    got = L.attach_frames(segs, items.select("doc_id", F.col("i").alias("frame"), F.col("a").alias("t"), "text")).collect()
    r6 = lambda v: np.floor(v * 1e6 + 0.5) / 1e6
    for s in segs.collect():
        own, found, said = rows[s.doc_id], [], _bag(s.text)
        for _, i, t, _, text in own:
            if s.start - 18 <= t <= s.fin + 18:
                half = max(12.0, (s.fin - s.start) / 2)
                time, like, info = max(0.0, 1 - abs(t - (s.start + s.fin) / 2) / (half + 12)), _cos(said, _bag(text)), min(1.0, 0.2 + sum(_bag(text).values()) / 45 + 1 / 30)
                found.append({"i": i, "t": t, "text": text, "score": r6(0.45 * time + 0.40 * like + 0.15 * info), "key": (-r6(0.45 * time + 0.40 * like + 0.15 * info), -r6(like), -r6(info), round(abs(t - (s.start + s.fin) / 2), 6), i)})
        found.sort(key=lambda x: x["key"])
        n, dur, kept = len(found), s.fin - s.start, []
        limit = 1 if dur < 90 else (1 if n <= 2 else 2) if dur < 240 else (2 if n <= 4 else 3)
        for x in found:
            if len(kept) < limit and not (kept and x["score"] < 0.22) and not any(abs(x["t"] - q["t"]) <= 25 and _cos(_bag(x["text"]), _bag(q["text"])) >= 0.92 for q in kept):
                kept.append(x)
        mine = sorted((x.place, x.frame, x.mode) for x in got if (x.doc_id, x.seg) == (s.doc_id, s.seg))
        assert mine == [(k, x["i"], "mixed" if len(kept) == 1 else "rich") for k, x in enumerate(kept)]


def test_picked_frames_are_unlike():
    row = lambda t, text, score: {"t": t, "text": text, "score": score}
    rows = [row(0, "alpha beta gamma", 0.9), row(10, "gamma beta alpha", 0.8), row(60, "gamma beta alpha", 0.7), row(70, "other words here", 0.1)]
    assert [r["t"] for r in L.pick_frames(rows, 5)] == [0, 60]
    assert [r["t"] for r in L.pick_frames(rows[3:], 5)] == [70]


def test_empty_lecture(spark):
    items = spark.createDataFrame([], "doc_id long, i long, a double, b double, text string, n long")
    packed = pack_windows(items, with_text=True)
    plan = L.fallback_plan(items)
    assert L.build_segments(items, L.classify(items, packed.select("doc_id", "first"), plan), plan).count() == 0
    assert L.rough_segments(items, packed).count() == 0
    assert L.reduce_tree(spark.createDataFrame([], "doc_id long, idx long, text string"), lambda t: F.array_join(t, " ")).count() == 0
