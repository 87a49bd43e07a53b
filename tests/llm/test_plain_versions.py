"""Language ID, quality, licenses, toxicity and windows against plain versions; clashing columns and repeated ids everywhere."""

from __future__ import annotations

import itertools
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontamination, embedding_dedup, jaccard_join, language_id, license_scan, line_dedup, perplexity, pieces, suffix_dedup, toxicity

# --- language ID -------------------------------------------------------------------


def plain_profile(texts, k):
    """The k most frequent n-grams of the bytes of letters (boundaries between), as the codes that ties go by."""
    symbol = [0] * 256
    for c in range(26):
        symbol[65 + c] = symbol[97 + c] = c + 1
    for c in range(128):
        symbol[128 + c] = 27 + c % 101
    n = Counter()
    for t in texts:
        body = [0]
        for x in [*(symbol[b] if unicodedata.category(c)[0] == "L" else 0 for c in t for b in c.encode()), 0]:
            if x or body[-1]:
                body.append(x)
        for a in body:
            n[1 << 21 | a] += a > 0
        for a, b in itertools.pairwise(body):
            n[2 << 21 | a << 7 | b] += a > 0 or b > 0
        for a, b, c in zip(body, body[1:], body[2:]):
            n[3 << 21 | a << 14 | b << 7 | c] += b > 0
    return [g for g, c in sorted(n.items(), key=lambda x: (-x[1], x[0])) if c][:k]


def test_language_id_against_plain_profiles(spark, docs):
    r = random.Random(1)
    words = {"en": "the of and a to in is you that it".split(), "fr": "le de un à être et en avoir que pour".split(), "xx": "zq qz zzq qqz zqz".split()}
    rows = [(i, " ".join(r.choices(words[lang], k=r.randint(1, 30))), lang) for i, lang in enumerate(r.choices(list(words), k=60))]
    rows += [(60, None, "en"), (61, "12 34", "en"), (62, "le", None), (63, "É!", None), (64, "é—le «un» 12€ x٣y", "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = d.where("lang IS NOT NULL AND text IS NOT NULL")
    for size in (20, 300):
        profiles = language_id.fit(learn, size)
        want = {lang: plain_profile([t for _, t, x in rows if x == lang and t is not None], size) for lang in words}
        assert {k: v.tolist() for k, v in profiles.items()} == want
        got = {x.doc_id: x for x in language_id.predict(d, profiles, size).collect()}
        for i, t, _ in rows:
            own = plain_profile([t or ""], size)
            far = sorted((sum(abs(want[lang].index(g) - k) if g in want[lang] else size for k, g in enumerate(own)), lang) for lang in words)
            assert got[i].lang_pred == (far[0][1] if own else "und")
            assert math.isclose(got[i].score, 1 - far[0][0] / max(far[1][0], 1) if own and far[1][0] else 0.0, abs_tol=1e-12)


def test_texts_without_a_letter_have_no_language(spark, docs):
    odd = ["———", "😀😀", "١٢٣", "«»…", "€ 20", "", None, " \n", "\u0301\u0300", "½ ² №"]
    lettered = ["É", "ß!", "日本", "ªb", "x"]
    profiles = language_id.fit(docs(["the of — and 😀", "to in €"]), 50)
    got = [r.lang_pred for r in sorted(language_id.predict(docs(odd + lettered), profiles, 50).collect(), key=lambda r: r.doc_id)]
    assert got == ["und"] * len(odd) + ["en"] * len(lettered)
    assert all(unicodedata.category(c)[0] != "L" for t in odd for c in t or "")


# --- quality -----------------------------------------------------------------------


def plain_kneser_ney(texts, symbols, base, order):
    """A function from the symbols before (order - 1 of them) and a symbol to its probability: by the book, over dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        s = [0] * (order - 1) + [symbols[b] for b in t.encode()]
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, context = {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / max(n[0] + 2 * n[1], 1)
        discount[k] = [max(0.1, min(i - 0.05, i - (i + 1) * y * n[i] / max(n[i - 1], 1))) for i in (1, 2, 3)]
        context[k] = {}
        for g, v in c.items():
            total, left = context[k].get(g[:-1], (0, 0.0))
            context[k][g[:-1]] = total + v, left + discount[k][min(v, 3) - 1]

    def p(before, x, k=order):
        if k == 0:
            return 1 / base
        h = tuple(before[len(before) - k + 1 :])
        lower = p(before, x, k - 1)
        if h not in context[k]:
            return lower
        total, left = context[k][h]
        v = counts[k].get((*h, x), 0)
        return ((v - discount[k][min(v, 3) - 1]) if v else 0) / total + left / total * lower

    return p


@pytest.mark.parametrize("name", ["BYTES", "CLASSES"])
def test_perplexity_against_the_book(spark, docs, name):
    alphabet = getattr(perplexity, name)
    learn = ["the cat sat on the mat.", "the dog sat on the log, the cat too", "a cat and a dog", "éa"]
    ask = ["the cat sat", "zebra! É", "", None, "a dog on a mat", "the cat sat"]
    p = plain_kneser_ney(learn, alphabet.symbols.tolist(), 1 << alphabet.bits, alphabet.order)
    want = []
    for t in ask:
        s = [0] * (alphabet.order - 1) + [alphabet.symbols[b] for b in (t or "").encode()]
        logs = [math.log2(p(s[i - alphabet.order + 1 : i], s[i])) for i in range(alphabet.order - 1, len(s))]
        want.append(2 ** (-sum(logs) / len(logs)) if logs else None)
    model = perplexity.interpolated(perplexity.kneser_ney(perplexity.count_grams(docs(learn), alphabet), alphabet), alphabet).persist()
    for score in (perplexity.score_by_lookup, perplexity.score_by_joins):
        got = [x.perplexity for x in score(docs(ask), model, alphabet).orderBy("doc_id").collect()]
        assert [x is None for x in got] == [x is None for x in want]
        assert all(x is None or math.isclose(x, y, rel_tol=1e-9) for x, y in zip(got, want))
    if name == "CLASSES":
        dense = perplexity.dense_log2(perplexity.kneser_ney(perplexity.count_grams(docs(learn))).toPandas())
        data = np.frombuffer(b"the cat sat", np.uint8)
        code, _ = perplexity.gram_codes(data, np.array([0, len(data)]))
        assert math.isclose(2 ** -dense[code].mean(), want[0], rel_tol=1e-4)


def test_quality_is_one_whatever_the_way(spark, docs):
    d = docs(["the cat sat on the mat"] * 3 + ["zxqj kvw qqq", None, ""])
    labels = spark.createDataFrame([(0, 1), (1, 1), (3, 0)], "doc_id long, quality int")
    few, many = (perplexity.classify(d, labels, most=most).orderBy("doc_id").collect() for most in (0, 10**6))
    assert [(x.doc_id, x.kept) for x in few] == [(x.doc_id, x.kept) for x in many] == [(0, True), (1, True), (2, True), (3, False), (4, False), (5, False)]
    assert all(x.perplexity is None or math.isclose(x.perplexity, y.perplexity) for x, y in zip(few, many))
    assert all(x.kept == (x.text not in (None, "")) for x in perplexity.classify(d, labels.where("false")).join(d, "doc_id").collect())


# --- licenses ----------------------------------------------------------------------


def sample(pattern: str) -> str:
    """The shortest text that a pattern's first branches match."""

    def walk(tree):
        out = ""
        for op, arg in tree:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "NOT_LITERAL":
                out += "x"
            elif kind == "IN":
                out += chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else "5" if str(arg[0][0]) == "RANGE" else "x"
            elif kind == "BRANCH":
                out += walk(arg[1][0])
            elif kind == "SUBPATTERN":
                out += walk(arg[3])
            else:
                out += walk(arg[2]) * arg[0]
        return out

    return walk(re._parser.parse(pattern))


def plain_labels(norm: str, rules) -> str:
    """Labels of a normalised text: every rule at all places, then priorities and containment, all against all."""
    found = []
    for label, pattern, keywords, priority, sure in rules:
        if any(f" {k[:-1]}" in norm if k.endswith("*") else f" {k} " in norm for k in keywords.split("|")):
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm):
                start = norm[: m.start()].count(" ") - 1
                found.append((label, start, start + m[0].count(" ") + 1, priority, sure))
    left = [x for x in found if not any(y[1] <= x[1] and y[2] >= x[2] and (y[3] > x[3] or y[3] == x[3] and y[2] - y[1] > x[2] - x[1]) for y in found)]
    base = {label for phrase, label in license_scan.BASE if f" {phrase} " in norm}
    return ",".join(sorted(base | {x[0] for x in left}))


def test_license_labels_against_a_plain_scan(spark, docs):
    rules = license_scan.rules()
    samples = [sample(p) for _, p, _, _, _ in rules]
    for (label, _, keywords, _, _), text in zip(rules, samples):
        assert any(f" {k[:-1]}" in f" {text} " if k.endswith("*") else f" {k} " in f" {text} " for k in keywords.split("|")), (label, text)
        assert label in {r[0] for r in rules if re.fullmatch(r[1], text)}
    r = random.Random(2)
    texts = [*samples, *(". ".join(r.choices(samples, k=12)) for _ in range(60)), "CC BY", "K İ MIT LICENSE", "mit license " * 300]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    norm = [f" {' '.join(word.findall(re.sub('[A-Z]', lambda m: m[0].lower(), t)))} " for t in texts]
    got = [x.labels for x in license_scan.scan(docs(texts)).orderBy("doc_id").collect()]
    assert got == [plain_labels(n, rules) for n in norm]


# --- toxicity ----------------------------------------------------------------------


def test_toxicity_scores_against_a_plain_chain(spark, docs):
    r = random.Random(3)
    texts = [" ".join(r.choices("ab cd ef gh badword worse fine ok".split(), k=r.randint(1, 12))) for _ in range(80)] + ["", None]
    d = docs(texts)
    labels = d.select("doc_id", F.coalesce(F.col("text").contains("badword"), F.lit(False)).cast("int").alias("toxic"))
    m = toxicity.fit(spark, d, labels)
    assert len(m.keys)
    scored = {x.doc_id: x for x in toxicity.tag(d, m).collect()}
    step = np.exp(m.trans)
    for i, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, _, _, columns = toxicity._features(data, np.array([0, len(data)]))
        place = {int(k): w for k, w in zip(m.keys, m.weights)}
        emit = [m.bias + sum(place.get(int(c[k]), 0.0) for c in columns if c[k]) for k in range(len(columns[0]))]
        has = [any(int(c[k]) in place for c in columns if c[k]) for k in range(len(emit))]
        forward, backward = [], [np.ones(2)]
        for k, e in enumerate(emit):
            forward.append((np.ones(2) if k == 0 else forward[-1] @ step) * [1, math.exp(e)])
        for e in reversed(emit[1:]):
            backward.append(step @ (np.array([1, math.exp(e)]) * backward[-1]))
        post = [float((f * b)[1] / (f * b).sum()) for f, b in zip(forward, reversed(backward))]
        # as evidence count the words that have a feature
        own = [p for p, h in zip(post, has) if h]
        x = [1, 1 - math.prod(1 - p for p in own), math.log1p(sum(own))]
        assert math.isclose(scored[i].score, 1 / (1 + math.exp(-float(np.dot(x, m.calibration)))), rel_tol=1e-4)
        assert scored[i].n_spans == sum(p >= 0.5 for p in own)


# --- decontamination ----------------------------------------------------------------


def test_windows_between_alignments(spark, docs):
    """Items with up to three edits anywhere, many near the threshold: every pair that any window of the document gives is found."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 11))) for _ in range(500)]
    items = [r.choices(words, k=r.randint(20, 59)) for _ in range(12)]
    texts = []
    for k in range(120):
        w = list(items[k % 12])
        for _ in range(r.choice((1, 1, 1, 2))):
            at, e = r.randrange(len(w)), r.random()
            w[at : at + (e < 0.7)] = [] if 0.4 < e < 0.7 else [r.choice(words)]
        texts.append(r.choices(words, k=r.randint(0, 15)) + w + r.choices(words, k=r.randint(0, 15)))
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    size = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
    want = set()
    for d, w in enumerate(texts):
        for i, item in enumerate(items):
            g, n = grams(item), min(len(item), len(w))
            both = [size(c & g) / size(c | g) for c in (grams(w[s : s + n]) for s in range(len(w) - n + 1))] if d % 12 == i else [0]
            if max(both) >= 0.8:
                want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.find(docs([" ".join(w) for w in texts]), bench).collect()}
    assert got == want and 15 < len(want) < 105


def test_unequal_weights(spark, docs):
    """One long word that differs, or many short ones beside long ones that stay, near the threshold: no pair is lost."""
    r = random.Random(21)
    word = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    size = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
    items, texts = [], []
    while len(items) < 250:
        n, long = r.randint(18, 120), r.randint(10, 120)
        item = [word(r.randint(1, 12)) for _ in range(n)]
        at = r.randrange(n)
        other = list(item)
        if len(items) % 2:
            item[at], other[at] = word(long), word(long)
        else:
            item[at] = other[at] = word(long)
            for k in r.sample(range(n), r.randint(1, 4)):
                other[k] = other[k] if k == at else word(2)
        a, b = grams(item), grams(other)
        if 0.8 <= size(a & b) / size(a | b) < 0.84:
            items.append(item)
            texts.append(other)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = decontamination.find(docs([" ".join(w) for w in texts]), bench).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(k, k) for k in range(250)}
    assert max(x.hamming for x in found) <= decontamination.RADIUS


def test_names_with_dots_go_through(spark, docs):
    wide = docs(["one two three four five six seven", "other text altogether, of some words"]).withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2))
    bench = spark.createDataFrame([(0, "one two three four five six seven")], "item_id long, text string")
    out = decontamination.decontaminate(wide, bench)
    assert out.columns == wide.columns and [x.doc_id for x in out.collect()] == [1]
    assert jaccard_join.keep_first(wide).count() == 2


# --- rows that repeat, names that clash ------------------------------------------------


def test_line_dedup_of_repeated_ids_and_short_lines(spark, docs):
    shared = "a shared line of more than thirty bytes"
    rows = [(1, f"{shared}\nbye\n\nx"), (2, f"second own line of more than thirty bytes\n{shared}\nbye"), (2, "zzz\nkeep this line it is unique in the corpus\n\n"), (2, f"second own line of more than thirty bytes\n{shared}\nbye"), (3, "bye\nx\n\nnew"), (None, shared), (4, None)]
    got = sorted((x.doc_id or -1, x.text, x.n_removed) for x in line_dedup.dedup_lines(docs(rows)).collect() if x.text is not None)
    two = (2, "second own line of more than thirty bytes\nbye", 1)
    assert got == [(-1, shared, 0), (1, f"{shared}\nbye\n\nx", 0), two, two, (2, "zzz\nkeep this line it is unique in the corpus\n\n", 0), (3, "bye\nx\n\nnew", 0)]
    got = sorted((x.doc_id or -1, x.text) for x in line_dedup.dedup_lines(docs(rows), short_lines=True).collect() if x.text is not None)
    two = (2, "second own line of more than thirty bytes")
    assert got == [(-1, shared), (1, f"{shared}\nbye\n\nx"), two, two, (2, "zzz\nkeep this line it is unique in the corpus\n\n"), (3, "\nnew")]


def test_vectors_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.01]), (5, [0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.01, 1.0]), (7, [-1.0, 0.0, 0.0])]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=0.999999).collect()
    assert sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in got) == [("1", 0, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("5", 2, "1", False), ("7", 0, "7", True), ("None", 1, "None", True), ("None", 1, "None", True)]


CLASHES = "gone n_near n_lines n_removed kept_in row doc line number score labels norm start shingles set_id component component_id perplexity threshold lang_pred hashes w n size ids round_trip"


def test_clashing_columns(spark, docs):
    """Columns with the names that the operators use inside come through, or don't matter."""
    texts = ["one two three four five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine ten eleven twelve", "another line of a text, longer than thirty bytes\nMIT License", None, ""]
    d = docs(texts)
    wide = d.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES.split()])
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, "two three four five six seven eight")], "item_id long, text string").withColumn("n", F.lit("x"))
    model = toxicity.fit(spark, wide, labels.withColumn("text", F.lit("no")))
    plain = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    for f, columns in (
        (lambda x: line_dedup.dedup_lines(x), ("doc_id", "text", "n_lines", "n_removed", "n_near", "kept_in")),
        (lambda x: suffix_dedup.remove_repeats(x.withColumn("row_id", suffix_dedup.row_id())), ("doc_id", "n_bytes", "n_removed", "kept")),
        (lambda x: language_id.predict(x, language_id.fit(x.where("text IS NOT NULL"))), ("doc_id", "lang_pred", "score")),
        (lambda x: decontamination.find(x, bench), ("doc_id", "item_id", "start_word", "n_words", "similarity")),
        (lambda x: perplexity.classify(x, labels), ("doc_id", "kept")),
        (lambda x: license_scan.scan(x), ("doc_id", "n_words", "labels", "score")),
        (lambda x: pieces.encode(x), ("doc_id", "n_ids", "round_trip")),
        (lambda x: toxicity.tag(x, model), ("doc_id", "score", "n_spans")),
        (lambda x: jaccard_join.components(x, 4, 85), ("doc_id", "n_shingles", "component_id")),
    ):
        assert plain(f(wide), *columns) == plain(f(d), *columns)
    for kept in (decontamination.decontaminate(wide, bench), jaccard_join.keep_first(wide, 4, 85), toxicity.keep_clean(wide, model)):
        assert kept.columns == wide.columns
        assert all(r[c] == f"own {c}" for r in kept.collect() for c in CLASHES.split())
    cut = line_dedup.dedup_lines(wide)
    assert all(r[c] == f"own {c}" for r in cut.collect() for c in CLASHES.split() if c not in line_dedup.ADDED)
    seen = license_scan.scan(wide)
    assert sorted(seen.columns) == sorted({*wide.columns, *license_scan.ADDED} - {"text"}) and seen.where("norm <> 'own norm'").count() == 0


def test_pipeline_of_odd_tables(spark, docs, odd):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns and no rows at all, through every stage."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    wide = odd.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES.split()])
    for docs_in, left in ((wide, {None, 0, 1, 2, 3, 4, 5, 6, 8}), (odd.where("false"), set())):
        now = docs_in
        for k, (name, stage) in enumerate(p.STAGES):
            now = p.save(spark, stage(spark, now, sf), f"odd{k}")
            if k < len(p.STAGES) - 1:
                assert now.columns == docs_in.columns, name
        assert {x.doc_id for x in now.collect()} == left
