"""The note builder over documents as lectures: plans, memberships, segments, frames, and the reduction of partial summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.maths import round6
from lectern.operators import lecture as L
from lectern.operators import whole as W
from lectern.operators.cut import cut
from lectern.operators.sequence import pack_windows
from lectern.plans.catalog import query, spread, table
from lectern.plans.geometry_queries import r6
from lectern.plans.table_queries import _ITEMS, items
from lectern.plans.text_queries import _clean, _strip, _tokens

_TEXTS = _ITEMS.replace("SELECT doc_id, i, length(s) AS n", "SELECT doc_id, i, s, length(s) AS n")
_WALK = """walk AS (SELECT doc_id, i, 1::BIGINT AS win, a AS start, b AS fin, n AS len FROM items WHERE i = 0 UNION ALL SELECT x.doc_id, x.i, CASE WHEN done THEN w.win + 1 ELSE w.win END, CASE WHEN done THEN x.a ELSE w.start END, x.b, CASE WHEN done THEN x.n ELSE w.len + 1 + x.n END FROM (SELECT *, (fin - start >= 20 AND len >= 350) OR fin - start >= 55 OR len >= 1400 AS done FROM walk) w JOIN items x ON x.doc_id = w.doc_id AND x.i = w.i + 1),
    wins AS (SELECT doc_id, win, min(i) AS first, max(i) AS last, min(start) AS start, max(fin) AS fin FROM walk GROUP BY ALL)"""
_WORDS = f"words AS (SELECT doc_id, win, token, count(*) AS c FROM (SELECT w.doc_id, w.win, unnest({_tokens('x.s')}) AS token FROM walk w JOIN items x ON x.doc_id = w.doc_id AND x.i = w.i) GROUP BY ALL), sizes AS (SELECT doc_id, win, sqrt(sum(c * c)::DOUBLE) AS n FROM words GROUP BY ALL)"
_PLAN = f"""parts AS (SELECT doc_id, i, s, i // ceil(n / k::DOUBLE)::BIGINT AS section FROM (SELECT doc_id, i, s, max(i + 1) OVER w AS n, least(12, greatest(1, round_even((max(b) OVER w - min(a) OVER w) / 180.0::DOUBLE, 0)::INT + 1)) AS k FROM items WINDOW w AS (PARTITION BY doc_id))),
    often AS (SELECT doc_id, section, token, count(*) AS tf, min(i * 100000 + p) AS pos FROM (SELECT doc_id, section, i, u.t AS token, u.p FROM (SELECT doc_id, section, i, {_tokens('s')} AS ts FROM parts), LATERAL (SELECT unnest(ts) AS t, generate_subscripts(ts, 1) AS p) u) GROUP BY ALL),
    names AS (SELECT doc_id, section, string_agg(token, ' / ' ORDER BY rn) AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY tf DESC, pos) AS rn FROM often) WHERE rn <= 4 GROUP BY ALL),
    plan AS (SELECT doc_id, section, coalesce(name, 'Раздел ' || (section + 1)) AS title, CASE WHEN length(t) <= 250 THEN t ELSE {_strip("regexp_replace(left(t, 250), ' [^ ]*$', '')")} || ' …' END AS description FROM (SELECT doc_id, section, {_clean("string_agg(s, ' ' ORDER BY i)")} AS t FROM parts GROUP BY ALL) LEFT JOIN names USING (doc_id, section))"""
_RATED = f"""named AS (SELECT doc_id, section, token, count(*) AS y FROM (SELECT doc_id, section, unnest({_tokens("title || '. ' || description")}) AS token FROM plan) GROUP BY ALL), nsizes AS (SELECT doc_id, section, sqrt(sum(y * y)::DOUBLE) AS m FROM named GROUP BY ALL),
    dots AS (SELECT doc_id, win, section, sum(c * y)::DOUBLE AS dot FROM words JOIN named USING (doc_id, token) GROUP BY ALL),
    placed AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((start + fin) / 2 - min(start) OVER w) / greatest(1e-6::DOUBLE, max(fin) OVER w - min(start) OVER w))) AS pos FROM wins WINDOW w AS (PARTITION BY doc_id)),
    scored AS (SELECT p.doc_id, p.win, s.section, {r6('0.85::DOUBLE * coalesce(dot / (n * m), 0) + 0.15::DOUBLE * CASE WHEN k > 1 THEN greatest(0.0::DOUBLE, 1 - abs(pos - s.section / (k - 1)::DOUBLE)) ELSE 0 END')} AS score FROM placed p JOIN (SELECT doc_id, section, count(*) OVER (PARTITION BY doc_id) AS k FROM plan) s USING (doc_id) LEFT JOIN dots d ON d.doc_id = p.doc_id AND d.win = p.win AND d.section = s.section LEFT JOIN sizes z ON z.doc_id = p.doc_id AND z.win = p.win LEFT JOIN nsizes q ON q.doc_id = p.doc_id AND q.section = s.section),
    soft AS (SELECT *, exp((score - max(score) OVER w) / 0.35::DOUBLE) AS e FROM scored WINDOW w AS (PARTITION BY doc_id, win)),
    probs AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id, win) AS p, row_number() OVER (PARTITION BY doc_id, win ORDER BY score DESC, section) AS rn FROM soft)"""


def lecture_items(spark, sf) -> DataFrame:
    return items(spark, sf).select("doc_id", "i", "a", "b", "n", "text")


@query("seq_plan", f"WITH {_TEXTS}, {_PLAN} SELECT doc_id, section, title, md5(description) AS h FROM plan")
def seq_plan(spark, sf):
    """Each lecture's own plan: titles of its parts' most frequent words, and the beginnings of their texts."""
    return L.fallback_plan(lecture_items(spark, sf)).select("doc_id", F.col("section").cast("long").alias("section"), "title", F.md5("description").alias("h"))


def _windows(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = cut(lecture_items(spark, sf))
    return rows, pack_windows(rows, with_text=True)


def _by_lecture(spark, sf, run, schema: str) -> DataFrame:
    """(doc_id, schema): what run gives for each document as a lecture, on the document's own row."""
    rows = W.texts(spread(table(spark, sf, "documents").select("doc_id", "text")))
    return W.by_document(rows, lambda doc: [(doc.doc_id, *r) for r in run(doc)], f"doc_id long, {schema}")


@query(
    "seq_plan_membership",
    f"WITH RECURSIVE {_TEXTS}, {_WALK}, {_WORDS}, {_PLAN}, {_RATED} SELECT *, confidence < 0.45 OR margin < 0.15 AS ambiguous FROM (SELECT doc_id, win, max(section) FILTER (rn = 1)::INT AS best, {r6('max(p)')} AS confidence, {r6('max(p) - coalesce(max(p) FILTER (rn = 2), 0)')} AS margin FROM probs GROUP BY doc_id, win)",
)
def seq_plan_membership(spark, sf):
    """What each window of a lecture is about, by likeness to the plan's sections and by its place."""
    rows, w = _windows(spark, sf)
    words = L.bag(w, ["doc_id", "win"], F.col("text"))
    return L.memberships(w.select("doc_id", "win", "start", "fin"), words, cut(L.fallback_plan(rows))).select("doc_id", "win", "best", "confidence", "margin", "ambiguous")


@query(
    "win_window_boundaries",
    f"""WITH RECURSIVE {_TEXTS}, {_WALK}, {_WORDS}, near AS (SELECT a.doc_id, a.win, sum(a.c * b.c)::DOUBLE AS dot FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.token = b.token AND b.win = a.win + 1 GROUP BY ALL),
    cues AS (SELECT w.doc_id, w.win, w.last, CASE WHEN t = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {' + '.join(f"(CASE WHEN starts_with(t, '{c}') THEN 0.55::DOUBLE ELSE 0 END)" for c in T.CUES)} + (CASE WHEN regexp_matches(t, '{T.CUE_PATTERN}') THEN 0.35::DOUBLE ELSE 0 END)) END AS cue FROM wins w JOIN (SELECT doc_id, i, lower({_clean('s')}) AS t FROM items) x ON x.doc_id = w.doc_id AND x.i = w.first)
    SELECT c.doc_id, c.win, c.last, {r6('1 - coalesce(dot / (y.n * z.n), 0) + greatest(0.3::DOUBLE * c.cue, d.cue)')} AS score FROM cues c JOIN cues d ON d.doc_id = c.doc_id AND d.win = c.win + 1 LEFT JOIN near e ON e.doc_id = c.doc_id AND e.win = c.win LEFT JOIN sizes y ON y.doc_id = c.doc_id AND y.win = c.win LEFT JOIN sizes z ON z.doc_id = c.doc_id AND z.win = c.win + 1""",
)
def win_window_boundaries(spark, sf):
    """How good a place to cut the end of each window is: unlike words on both sides, or an opening cue."""
    return _by_lecture(spark, sf, lambda doc: W.boundaries(doc, W.packed(doc)), "win long, last long, score double")


def _ranges(ranges) -> list[tuple]:
    return [(k + 1, *r) for k, r in enumerate(ranges)]


def _rated(doc) -> tuple[W.Rating, list, list]:
    sections = W.plan(doc)
    rate = W.Rating(doc, sections)
    return rate, sections, W.classified(doc, W.packed(doc), rate)


@query("seq_recursive_split")
def seq_recursive_split(spark, sf):
    """Windows with ambiguous ones cut again and again: no SQL for cuts that depend on ratings of the cut parts, tested against a plain version."""

    def run(doc):
        rate, _, windows = _rated(doc)
        return [(first, last, *rate(first, last)[:4]) for first, last in windows]

    return _by_lecture(spark, sf, run, "win long, last long, best int, confidence double, margin double, ambiguous boolean")


@query("seq_segments")
def seq_segments(spark, sf):
    """A lecture's segments in the order of its plan: no SQL, tested against a plain version."""

    def run(doc):
        rate, sections, windows = _rated(doc)
        return _ranges(W.segments(doc, windows, rate, sections))

    return _by_lecture(spark, sf, run, "seg long, first long, last long, section int, title string")


@query("seq_rough_segments")
def seq_rough_segments(spark, sf):
    """Segments without a plan, cut where words change: no SQL for choices that depend on each other, tested against a plain version."""
    return _by_lecture(spark, sf, lambda doc: _ranges(W.rough(doc, W.packed(doc))), "seg long, first long, last long")


@query("seq_refined_segments")
def seq_refined_segments(spark, sf):
    """Rough segments with each boundary moved to the end of a window near twenty seconds later, if none gets short: no SQL, tested against a plain version."""
    return _by_lecture(spark, sf, lambda doc: _ranges(W.refined(doc, W.packed(doc), later=20)), "seg long, first long, last long")


@query("jn_frames_to_segments")
def jn_frames_to_segments(spark, sf):
    """The frames (here sentences, as if read from slides) that each window shows: no SQL for the diverse choice, tested against a plain version."""
    return _by_lecture(spark, sf, lambda doc: W.frames(doc, W.packed(doc)), "seg long, frame long, place long, score double, mode string")


_CHUNKS = f"chunks AS (SELECT doc_id, i // 60 AS idx, array_to_string(t[i + 1 : i + 60], ' ') AS txt, ((len(t) - 1) // 60)::BIGINT AS top FROM (SELECT doc_id, t, unnest(range(0, len(t), 60)) AS i FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents) WHERE len(t) > 0))"


@query(
    "seq_reduce_tree",
    f"WITH RECURSIVE {_CHUNKS}, tree AS (SELECT doc_id, idx, txt, top FROM chunks UNION ALL SELECT doc_id, idx // 4, CASE WHEN count(*) > 1 THEN left(string_agg(left(txt, 80), ' | ' ORDER BY idx), 300) ELSE min(txt) END, top // 4 FROM tree WHERE top > 0 GROUP BY doc_id, idx // 4, top // 4) SELECT doc_id, txt AS text FROM tree WHERE top = 0",
)
def seq_reduce_tree(spark, sf):
    """Partial summaries of sixty words, four and four made one by their beginnings, until one is left."""
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    parts = t.select("doc_id", "t", F.explode(F.expr("sequence(0, size(t) - 1, 60)")).alias("i")).select("doc_id", F.floor(F.col("i") / 60).alias("idx"), F.array_join(F.expr("slice(t, i + 1, 60)"), " ").alias("text"))
    shorten = lambda texts: F.left(F.array_join(F.transform(texts, lambda x: F.left(x, F.lit(80))), " | "), F.lit(300))
    return L.reduce_tree(parts, shorten)


@query("agg_lecture_duration", f"WITH {_ITEMS} SELECT doc_id, {r6('max(b)')} AS duration FROM items GROUP BY 1")
def agg_lecture_duration(spark, sf):
    return items(spark, sf).groupBy("doc_id").agg(round6(F.max("b")).alias("duration"))
