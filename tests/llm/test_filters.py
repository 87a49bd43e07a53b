"""Toxicity, language ID, quality, decontamination and license scans: held-out accuracy, brute force, odd inputs."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import decontamination, language_id, license_scan, perplexity, toxicity

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_all_labellings():
    r = np.random.default_rng(5)
    trans, bias = np.array([[0.0, -0.7], [0.4, 0.3]]), -0.9
    lengths = np.array([6, 4, 1])
    docs, places = np.array([0, 0, 1, 2]), np.array([1, 4, 3, 0])
    emit = r.standard_normal(4)
    post, z = toxicity.forward_backward(docs, places, lengths, emit, bias, trans)
    for d in range(3):
        e = np.full(lengths[d], bias)
        e[places[docs == d]] = emit[docs == d]
        total, on = 0.0, np.zeros(lengths[d])
        for tags in itertools.product((0, 1), repeat=int(lengths[d])):
            w = np.exp(sum(e[i] for i, t in enumerate(tags) if t) + sum(trans[a, b] for a, b in itertools.pairwise(tags)))
            total += w
            on += w * np.array(tags)
        assert np.isclose(np.log(total), z[d])
        assert np.allclose(post[docs == d], (on / total)[places[docs == d]])


def test_toxicity_held_out(spark):
    got = toxicity.op9_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in rows) / len(rows)
    assert right > 0.85
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_toxic_spans_are_the_words(spark, docs):
    words = "the of and a to in is on that by".split()
    r = random.Random(0)
    texts = [" ".join(r.choices(words, k=30) + (["wretchword"] if k % 4 == 0 else [])) for k in range(200)]
    d = docs(texts)
    labels = d.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    tagged = toxicity.tag(d, toxicity.fit(spark, d, labels)).collect()
    for row in tagged:
        found = {texts[row.doc_id].encode()[s.start : s.end].decode() for s in row.spans}
        assert found == ({"wretchword"} if row.doc_id % 4 == 0 else set())


def test_language_held_out(spark):
    got = language_id.op3_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_ngram_counts_by_hand():
    data = np.frombuffer(b"ab a1b", np.uint8)
    row, code, count = language_id.ngram_counts(data, np.array([0, 4, 6]))
    one = {(int(r), int(c) & 127): int(n) for r, c, n in zip(row, code, count) if c >> 21 == 1}
    assert one == {(0, 1): 2, (0, 2): 1, (1, 2): 1}
    assert ((code >> 21 == 3) & (row == 0)).sum() == 3  # _ab ab_ _a_


def test_kneser_ney_sums_to_one(spark, docs):
    d = docs(["the cat sat on the mat. the dog sat.", "a cat and a dog"])
    logs = perplexity.dense_log2(perplexity.kneser_ney(perplexity.count_grams(d)).toPandas())
    assert np.allclose(np.exp2(logs.astype(float)).reshape(-1, 64).sum(1), 1, atol=1e-4)


def test_quality_by_label(spark):
    got = perplexity.op5_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) < 0.3


def test_decontamination_against_all_windows(spark, docs):
    r = random.Random(9)
    words = [f"term{k}" for k in range(400)]
    items = [" ".join(r.choices(words, k=r.randint(12, 40))) for _ in range(8)] + ["too short"]
    texts = [" ".join(r.choices(words, k=80)) for _ in range(10)]
    for k in range(8):
        w = items[k].split()
        if k % 2:
            w[-1] = "other"  # one word edited at the end of a long item
        texts.append(" ".join(r.choices(words, k=20) + w + r.choices(words, k=20)).upper())
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    size = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
    want = set()
    for d, t in enumerate(texts):
        w = split(t)
        for i, item in enumerate(items):
            g, n = grams(split(item)), len(split(item))
            for s in range(len(w) - n + 1):
                c = grams(w[s : s + n])
                if g and size(c & g) >= 0.8 * size(c | g):
                    want.add((d, i))
    got = decontamination.find(docs(texts), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(want) >= 4
    clean = decontamination.decontaminate(docs(texts), bench)
    assert {x.doc_id for x in clean.select("doc_id").collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination_at_document_edges(spark, docs):
    words = [f"term{k}" for k in range(400)]
    item, other = words[:30], words[100:140]
    texts = [item[1:] + other, other + item[:-1], item[1:], item[:-1], other, other[:10] + item[1:12], other[:3]]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {x.doc_id: (x.start_word, x.n_words) for x in decontamination.find(docs([" ".join(t) for t in texts]), bench).collect()}
    assert got == {0: (0, 30), 1: (39, 30), 2: (0, 29), 3: (0, 29)}


def test_hamming_blocks_cover_all_bits():
    for radius in (3, 15):
        bounds = [64 * k // (radius + 1) for k in range(radius + 2)]
        assert bounds[0] == 0 and bounds[-1] == 64 and all(b > a for a, b in itertools.pairwise(bounds))


def test_license_base_against_plain_scan(spark):
    got = {r.doc_id: r for r in license_scan.op6_license_scan(spark, SF).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), row.text))
        places, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        g = got[row.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_license_rules(docs):
    texts = ["Licensed under the Apache License, Version 2.0.", "GNU General Public License version 3 or later", "CC BY-NC 4.0", "MIT License. All rights reserved. all rights reserved", "nothing here mit", None, ""]
    got = [r.labels for r in license_scan.scan(docs(texts)).orderBy("doc_id").collect()]
    assert got == ["apache-2.0", "gpl,gpl-3-or-later", "cc-by,cc-by-nc-4.0", "mit,reserved", "", "", ""]
    assert len(license_scan.rules()) > 300


def test_odd_and_empty_inputs(spark, docs, odd):
    n = odd.count()
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (4, None, None), (6, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(spark, odd, labels)
    assert toxicity.tag(odd, model).count() == n
    assert toxicity.tag(odd, toxicity.fit(spark, odd, labels.where("false"))).where("score <> 0").count() == 0
    assert language_id.predict(odd, language_id.fit(odd)).count() == n
    assert language_id.predict(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert perplexity.classify(odd, labels).count() >= n
    assert license_scan.scan(odd).count() == n
    bench = spark.createDataFrame([(0, None), (1, ""), (2, "one two three four five six")], "item_id long, text string")
    assert decontamination.find(odd, bench).count() == 0
    none = docs([])
    assert toxicity.tag(none, model).count() == 0
    assert language_id.predict(none, {}).count() == 0
    assert perplexity.classify(none, labels).count() == 0
    assert license_scan.scan(none).count() == 0
    assert decontamination.find(none, bench).count() == 0
