"""From a timed transcript to a note's segments: plans, memberships, recursive splits, boundaries, refinement, frames.

Items are (doc_id, i, a, b, text): sentences of a lecture with their times. A window
or segment is a range of items. Bags of words are joined within a lecture, so no
frequent word joins one lecture with another.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import maths as M
from lectern.functions import text as T
from lectern.functions.maths import round6
from lectern.operators.cut import cut
from lectern.operators.sequence import _bag, _cos, decode_labels, merge_short

SPLITS = 4


def _joined(order: str, c: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c.alias("text")))), lambda r: r.text), " ")


def fallback_plan(items: DataFrame) -> DataFrame:
    """(doc_id, section, title, description): about a section for every three minutes, twelve at most, each named by its four most frequent words."""
    w = Window.partitionBy("doc_id")
    k = M.section_count(F.max("b").over(w) - F.min("a").over(w))
    parts = items.withColumn("section", F.floor(F.col("i") / F.ceil(F.max(F.col("i") + 1).over(w) / k)).cast("int"))
    tokens = parts.select("doc_id", "section", "i", F.posexplode(T.tokens(F.col("text"))).alias("p", "token"))
    often = tokens.groupBy("doc_id", "section", "token").agg(F.count("*").alias("tf"), F.min(F.struct("i", "p")).alias("first"))
    top = often.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy(F.desc("tf"), "first"))).where("rn <= 4")
    names = top.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "token"))), lambda r: r.token), " / ").alias("name"))
    texts = parts.groupBy("doc_id", "section").agg(T.truncate(_joined("i", F.col("text")), 250).alias("description"))
    title = F.coalesce("name", F.concat(F.lit("Раздел "), (F.col("section") + 1).cast("string")))
    return texts.join(names, ["doc_id", "section"], "left").select("doc_id", "section", title.alias("title"), "description")


def bag(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    return rows.select(*keys, F.explode(T.tokens(text)).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("c"))


def memberships(windows: DataFrame, words: DataFrame, plan: DataFrame) -> DataFrame:
    """Windows (doc_id, win, start, fin) of bags words (doc_id, win, token, c), with what the plan's sections make of them:

    scores (0.85 likeness + 0.15 nearness of the window's place to the section's), probs, best, confidence, margin, ambiguous.
    Scores count to six places, so that ties go to the first section.
    """
    sections = plan.select("doc_id", "section", F.count("*").over(Window.partitionBy("doc_id")).alias("k"))
    named = bag(plan, ["doc_id", "section"], F.concat(F.col("title"), F.lit(". "), F.col("description"))).withColumnRenamed("c", "y")
    size = lambda df, keys, c: df.groupBy(*keys).agg(F.sqrt(F.sum(F.col(c) * F.col(c)).cast("double")).alias(f"n{c}"))
    dots = words.join(named, ["doc_id", "token"]).groupBy("doc_id", "win", "section").agg(F.sum(F.col("c") * F.col("y")).cast("double").alias("dot"))
    w = Window.partitionBy("doc_id")
    begin = F.min("start").over(w)
    place = windows.withColumn("pos", M.clamp(((F.col("start") + F.col("fin")) / 2 - begin) / F.greatest(F.lit(1e-6), F.max("fin").over(w) - begin), 0.0, 1.0))
    pairs = place.select("doc_id", "win", "pos").join(sections, "doc_id").join(dots, ["doc_id", "win", "section"], "left")
    pairs = pairs.join(size(words, ["doc_id", "win"], "c"), ["doc_id", "win"], "left").join(size(named, ["doc_id", "section"], "y"), ["doc_id", "section"], "left")
    near = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), 1 - F.abs(F.col("pos") - F.col("section") / (F.col("k") - 1)))).otherwise(0.0)
    score = round6(0.85 * F.coalesce(F.col("dot") / (F.col("nc") * F.col("ny")), F.lit(0.0)) + 0.15 * near)
    scores = F.transform(F.array_sort(F.collect_list(F.struct("section", score.alias("s")))), lambda r: r.s)
    rated = pairs.groupBy("doc_id", "win").agg(scores.alias("scores")).withColumn("probs", M.softmax(F.col("scores")))
    ranked = F.sort_array("probs", asc=False)
    rated = rated.withColumns({"best": (F.array_position("scores", F.array_max("scores")) - 1).cast("int"), "confidence": round6(F.get(ranked, F.lit(0))), "margin": round6(F.get(ranked, F.lit(0)) - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0)))})
    return windows.join(rated.withColumn("ambiguous", (F.col("confidence") < 0.45) | (F.col("margin") < 0.15)), ["doc_id", "win"])


def windows_of(state: DataFrame) -> DataFrame:
    return state.groupBy("doc_id", "win").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("a").alias("start"), F.max("b").alias("fin"))


def classify(items: DataFrame, packed: DataFrame, plan: DataFrame, least: float = 10.0) -> DataFrame:
    """Windows with their memberships; ambiguous ones of more than two items are cut at the item that ends nearest their middle, four times at most.

    A window is named by its first item. State is one row an item, with its window; each round is written once.
    """
    plan = cut(plan)
    words = cut(bag(items, ["doc_id", "i"], F.col("text")))
    starts = packed.select("doc_id", F.col("first").alias("i"), F.col("first").alias("win"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    state = cut(items.select("doc_id", "i", "a", "b").join(starts, ["doc_id", "i"], "left").withColumn("win", F.last("win", True).over(w)))

    def rated(state: DataFrame) -> DataFrame:
        bags = words.join(state.select("doc_id", "i", "win"), ["doc_id", "i"]).groupBy("doc_id", "win", "token").agg(F.sum("c").alias("c"))
        return memberships(windows_of(state), bags, plan)

    for _ in range(SPLITS):
        split = rated(state).where((F.col("ambiguous")) & (F.col("fin") - F.col("start") >= 2 * least) & (F.col("last") - F.col("first") >= 2)).select("doc_id", "win", "first", "last", ((F.col("start") + F.col("fin")) / 2).alias("middle"))
        j = state.join(split, ["doc_id", "win"], "left")
        at = F.min(F.when(F.col("i") < F.col("last"), F.struct(F.abs(F.col("b") - F.col("middle")).alias("gap"), F.col("i").alias("i")))).over(Window.partitionBy("doc_id", "win"))
        j = j.withColumn("at", at["i"])
        moved = F.col("at").isNotNull() & (F.col("at") > F.col("first")) & (F.col("i") > F.col("at"))
        state = cut(j.select("doc_id", "i", "a", "b", F.when(moved, F.col("at") + 1).otherwise(F.col("win")).alias("win")))
    return rated(state)


def _ranges(items: DataFrame, bounds: DataFrame, least: float) -> DataFrame:
    """(doc_id, seg, first, last, start, fin) of items cut behind the bounds (doc_id, i), short ones merged."""
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    marked = items.join(bounds.select("doc_id", "i", F.lit(1).alias("ends")).distinct(), ["doc_id", "i"], "left")
    named = marked.withColumn("win", F.coalesce(F.sum("ends").over(w), F.lit(0)).cast("long"))
    segs = named.groupBy("doc_id", "win").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("a").alias("start"), F.max("b").alias("fin"), _joined("i", F.col("text")).alias("text"))
    merged = merge_short(segs, least)
    ends = items.select("doc_id", "i", "a", "b")
    out = merged.join(ends.select("doc_id", F.col("i").alias("first"), F.col("a").alias("start")), ["doc_id", "first"])
    return out.join(ends.select("doc_id", F.col("i").alias("last"), F.col("b").alias("fin")), ["doc_id", "last"]).select("doc_id", "seg", "first", "last", "start", "fin")


def build_segments(items: DataFrame, classified: DataFrame, plan: DataFrame, least: float = 30.0) -> DataFrame:
    """(doc_id, seg, first, last, start, fin, section, title): windows' labels in order, cut where they change, short ranges merged, each with the label that covers most of it."""
    labels = cut(decode_labels(classified.select("doc_id", "win", "probs"), 12))
    windows = classified.select("doc_id", "win", "last", F.col("start").alias("s"), F.col("fin").alias("e")).join(labels, ["doc_id", "win"])
    changed = F.lead("label").over(Window.partitionBy("doc_id").orderBy("win")) != F.col("label")
    bounds = windows.withColumn("ends", changed).where("ends").select("doc_id", F.col("last").alias("i"))
    segs = cut(_ranges(items, bounds, least))
    both = F.least("fin", "e") - F.greatest("start", "s")
    # segments and windows meet by the minutes that they lie in, each pair in the first minute of both
    minutes = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 60), F.floor(F.greatest(a, b) / 60))).alias("minute")
    spans = segs.select("*", minutes("start", "fin")).join(windows.select("doc_id", "win", "label", "s", "e", minutes("s", "e")), ["doc_id", "minute"])
    over = spans.where(F.col("minute") == F.floor(F.greatest("start", "s") / 60)).withColumn("both", both).where("both > 0")
    sums = over.groupBy("doc_id", "seg", "label").agg(F.sum("both").alias("both"), F.min("win").alias("win"))
    best = sums.groupBy("doc_id", "seg").agg(F.min_by("label", F.struct(-F.round("both", 6), F.col("win"))).alias("section"))
    out = segs.join(best, ["doc_id", "seg"], "left").withColumn("section", F.coalesce("section", F.lit(0)).cast("int"))
    return out.join(plan.select("doc_id", "section", "title"), ["doc_id", "section"], "left").select("doc_id", "seg", "first", "last", "start", "fin", "section", "title")


def boundary_scores(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, win, last, score): how good a place the end of each window but the last is to cut at: unlike words, or a cue."""
    cue = items.select("doc_id", F.col("i").alias("first"), T.transition_score(F.col("text")).alias("cue"))
    w = windows.select("doc_id", "win", "first", "last", "text").join(cue, ["doc_id", "first"])
    words = bag(w, ["doc_id", "win"], F.col("text"))
    size = words.groupBy("doc_id", "win").agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("n"))
    after = words.select("doc_id", (F.col("win") - 1).alias("win"), "token", F.col("c").alias("y"))
    dots = words.join(after, ["doc_id", "win", "token"]).groupBy("doc_id", "win").agg(F.sum(F.col("c") * F.col("y")).cast("double").alias("dot"))
    o = Window.partitionBy("doc_id").orderBy("win")
    j = w.select("doc_id", "win", "last", "cue").join(size, ["doc_id", "win"], "left").join(dots, ["doc_id", "win"], "left")
    j = j.withColumns({"next_n": F.lead("n").over(o), "next_cue": F.lead("cue").over(o)}).where("next_cue IS NOT NULL")
    like = F.coalesce(F.col("dot") / (F.col("n") * F.col("next_n")), F.lit(0.0))
    return j.select("doc_id", "win", "last", round6((1 - like) + F.greatest(0.3 * F.col("cue"), F.col("next_cue"))).alias("score"))


def choose_cuts(a: np.ndarray, b: np.ndarray, ends: list[int], target: int, least: float, most: float) -> list[int]:
    """Items to cut behind: of the ends, best first, those that leave `least` seconds to both sides, target - 1 at most; then ranges above `most` are cut nearest to it."""
    cuts: list[int] = []

    def span(c: int) -> tuple[float, float]:
        k = bisect.bisect_left(cuts, c)
        begin = a[cuts[k - 1] + 1] if k else a[0]
        stop = b[cuts[k]] if k < len(cuts) else b[-1]
        return max(0.0, b[c] - begin), max(0.0, stop - a[c + 1])

    for c in ends:
        if len(cuts) >= target - 1:
            break
        if min(span(c)) >= least:
            bisect.insort(cuts, c)
    first = 0
    while first < len(a):
        k = bisect.bisect_left(cuts, first)
        last = cuts[k] if k < len(cuts) else len(a) - 1
        inner = np.arange(first, last)
        left, right = b[inner] - a[first], b[last] - a[inner + 1]
        fit = inner[(left >= least) & (right >= least)] if b[last] - a[first] > most else inner[:0]
        if len(fit):
            bisect.insort(cuts, int(fit[np.argmin(np.abs(b[fit] - a[first] - most))]))
        else:
            first = last + 1
    return cuts


def rough_segments(items: DataFrame, windows: DataFrame, sections: int | None = None, least: float = 30.0, most: float = 300.0) -> DataFrame:
    """(doc_id, seg, first, last, start, fin): a transcript cut where neighbouring windows differ most, without too short or too long ranges."""
    marks = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "win", "last")))
    ends = boundary_scores(windows, items).groupBy("doc_id").agg(F.transform(marks, lambda r: r["last"]).alias("ends"))
    times = F.array_sort(F.collect_list(F.struct("i", "a", "b")))
    rows = items.groupBy("doc_id").agg(F.transform(times, lambda r: r.a).alias("a"), F.transform(times, lambda r: r.b).alias("b")).join(ends, "doc_id", "left")

    def run(parts):
        for pdf in parts:
            found = []
            for doc, a, b, e in zip(pdf["doc_id"], pdf["a"], pdf["b"], pdf["ends"]):
                a, b = np.asarray(a), np.asarray(b)
                target = sections or max(1, min(12, int(np.round((b[-1] - a[0]) / 180.0)) + 1))
                found += [(doc, c) for c in choose_cuts(a, b, [] if e is None else list(e), target, least, most)]
            yield pd.DataFrame(found, columns=["doc_id", "i"])

    return _ranges(items, rows.mapInPandas(run, "doc_id long, i long"), least)


def refine_cuts(a: np.ndarray, b: np.ndarray, cuts: list[int], ends: np.ndarray, chosen: list[float | None], radius: float, least: float) -> list[int]:
    """Cuts moved, one after the other, to the candidate nearest the chosen time; candidates are items nearest the window ends around; a move that makes a range short is not made."""
    cuts = list(cuts)
    inner = b[:-1]
    for k, time in enumerate(chosen):
        near = ends[np.abs(ends - b[cuts[k]]) <= radius]
        if time is None or np.isnan(time) or not len(near) or not len(inner):
            continue
        items = np.array(list(dict.fromkeys(int(np.argmin(np.abs(inner - t))) for t in near)))
        trial = [*cuts[:k], int(items[np.argmin(np.abs(b[items] - time))]), *cuts[k + 1 :]]
        edges = sorted(set(trial))
        begins, stops = [0, *[c + 1 for c in edges]], [*edges, len(a) - 1]
        if all(b[q] - a[p] >= least for p, q in zip(begins, stops)):
            cuts = trial
    return cuts


def refine_boundaries(items: DataFrame, segments: DataFrame, windows: DataFrame, choose: Callable[[DataFrame], DataFrame], radius: float = 70.0, least: float = 30.0) -> DataFrame:
    """Segments with their boundaries moved by an outside choice: choose gets (doc_id, seg, time) of every boundary and gives (doc_id, seg, chosen)."""
    last = F.max("seg").over(Window.partitionBy("doc_id"))
    bounds = segments.withColumn("n", last).where("seg < n").select("doc_id", "seg", F.col("last").alias("i"), F.col("fin").alias("time"))
    picked = bounds.join(choose(bounds.select("doc_id", "seg", "time")), ["doc_id", "seg"], "left")
    of = lambda rows, cols, key: rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(key))
    rows = of(items, ("i", "a", "b"), "items").join(of(picked, ("seg", "i", "chosen"), "bounds"), "doc_id").join(of(windows, ("win", "fin"), "ends"), "doc_id")

    def run(parts):
        for pdf in parts:
            found = []
            for doc, it, bo, en in zip(pdf["doc_id"], pdf["items"], pdf["bounds"], pdf["ends"]):
                a, b = np.array([x["a"] for x in it]), np.array([x["b"] for x in it])
                cuts = refine_cuts(a, b, [x["i"] for x in bo], np.array([x["fin"] for x in en]), [x["chosen"] for x in bo], radius, least)
                found += [(doc, c) for c in cuts]
            yield pd.DataFrame(found, columns=["doc_id", "i"])

    return _ranges(items, rows.mapInPandas(run, "doc_id long, i long"), least)


def pick_frames(rows: list[dict], limit: int, weak: float = 0.22, alike: float = 0.92, near: float = 25.0) -> list[dict]:
    """Ranked candidates, without weak ones behind the first and without those that say the same as a chosen one close by."""
    out: list[tuple[dict, object]] = []
    for r in rows:
        if len(out) >= limit:
            break
        own = r["bag"] if "bag" in r else _bag(r["text"])
        if (out and r["score"] < weak) or any(abs(r["t"] - q["t"]) <= near and _cos(own, bag_) >= alike for q, bag_ in out):
            continue
        out.append((r, own))
    return [r for r, _ in out]


def attach_frames(segments: DataFrame, frames: DataFrame, margin: float = 18.0) -> DataFrame:
    """(doc_id, seg, frame, place, score, mode) of the frames (doc_id, frame, t, text) that each segment (doc_id, seg, start, fin, text) shows.

    Frames and segments meet by minute, then by the exact margin.
    """
    minute = lambda c: F.floor(c / 60)
    s = segments.select("doc_id", "seg", "start", "fin").withColumn("minute", F.explode(F.sequence(minute(F.col("start") - margin), minute(F.col("fin") + margin))))
    c = s.join(frames.select("doc_id", "frame", "t", "text", minute(F.col("t")).alias("minute")), ["doc_id", "minute"]).where((F.col("t") >= F.col("start") - margin) & (F.col("t") <= F.col("fin") + margin)).drop("minute")
    said, shown = bag(segments, ["doc_id", "seg"], F.col("text")), bag(frames, ["doc_id", "frame"], F.col("text")).withColumnRenamed("c", "y")
    norm = lambda df, keys, c: df.groupBy(*keys).agg(F.sqrt(F.sum(F.col(c) * F.col(c)).cast("double")).alias(f"n{c}"))
    dots = c.select("doc_id", "seg", "frame").join(shown, ["doc_id", "frame"]).join(said, ["doc_id", "seg", "token"]).groupBy("doc_id", "seg", "frame").agg(F.sum(F.col("c") * F.col("y")).cast("double").alias("dot"))
    c = c.join(dots, ["doc_id", "seg", "frame"], "left").join(norm(said, ["doc_id", "seg"], "c"), ["doc_id", "seg"], "left").join(norm(shown, ["doc_id", "frame"], "y"), ["doc_id", "frame"], "left")
    lines = F.size(F.filter(F.split(T.clean_text(F.col("text")), "\n"), lambda x: F.trim(x) != ""))
    info = F.when(T.clean_text(F.col("text")) == "", 0.10).otherwise(F.least(F.lit(1.0), 0.2 + F.size(T.tokens(F.col("text"))) / 45.0 + lines / 30.0))
    like = F.coalesce(F.col("dot") / (F.col("nc") * F.col("ny")), F.lit(0.0))
    c = c.select("doc_id", "seg", "frame", "t", "text", "start", "fin", round6(0.45 * M.frame_time_score(F.col("t"), F.col("start"), F.col("fin")) + 0.40 * like + 0.15 * info).alias("score"), round6(like).alias("like"), round6(info).alias("info"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        start, fin = pdf["start"].iloc[0], pdf["fin"].iloc[0]
        pdf = pdf.assign(away=(pdf["t"] - (start + fin) / 2).abs().round(6)).sort_values(["score", "like", "info", "away", "frame"], ascending=[False, False, False, True, True])
        n, d = len(pdf), max(0.0, fin - start)
        limit = 1 if d < 90 else (1 if n <= 2 else 2) if d < 240 else (2 if n <= 4 else 3)
        kept = pick_frames(pdf.to_dict("records"), limit)
        return pd.DataFrame({"doc_id": [r["doc_id"] for r in kept], "seg": [r["seg"] for r in kept], "frame": [r["frame"] for r in kept], "place": range(len(kept)), "score": [r["score"] for r in kept], "mode": "mixed" if len(kept) == 1 else "rich"})

    return c.groupBy("doc_id", "seg").applyInPandas(pick, "doc_id long, seg long, frame long, place long, score double, mode string")


def reduce_tree(parts: DataFrame, combine: Callable[[Column], Column], group: int = 4) -> DataFrame:
    """(doc_id, text) of parts (doc_id, idx, text): every four in a row become one by combine (an array of texts to a text), until one is left."""
    most = parts.agg(F.max("idx").alias("m")).first()["m"] or 0
    while most > 0:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda r: r.text)
        parts = parts.groupBy("doc_id", F.floor(F.col("idx") / group).alias("g")).agg(texts.alias("texts")).select("doc_id", F.col("g").alias("idx"), F.when(F.size("texts") > 1, combine(F.col("texts"))).otherwise(F.get("texts", F.lit(0))).alias("text"))
        most //= group
    return parts.select("doc_id", "text")
