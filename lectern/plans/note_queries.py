"""Operators of the note builder: memberships, boundaries, families, diverse choices, plans and library views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import maths as M
from lectern.functions import text as T
from lectern.functions.maths import round6
from lectern.plans.catalog import query, spread, table
from lectern.plans.frame_queries import _FRAMES, _MARKED, _SEGMENTS, _STEP, _THRESHOLDS, _events, _marked, _with, frames, sample_step, scored, segments
from lectern.plans.table_queries import _ITEMS, items
from lectern.plans.text_queries import _tokens

_R6 = "floor(({0}) * 1000000 + 0.5) / 1000000"


# --- scalar functions -----------------------------------------------------------


@query("mth_frame_scores", f"""SELECT event_id, {_R6.format('0.40::DOUBLE * ln(1 + value) + 0.25::DOUBLE * (value / 100) + 0.25::DOUBLE * (value / 200) + 0.10::DOUBLE * (value / 50 / 8.0::DOUBLE)')} AS content,
    {_R6.format('CASE WHEN floor(value) = 0 THEN 0.10::DOUBLE ELSE least(1.0::DOUBLE, 0.20::DOUBLE + floor(value)::BIGINT / 45.0::DOUBLE + (event_id % 9) / 30.0::DOUBLE) END')} AS info,
    CASE WHEN event_id % 7 = 0 THEN 0 WHEN value < 90 THEN 1 WHEN value < 240 THEN CASE WHEN event_id % 7 <= 2 THEN 1 ELSE 2 END WHEN event_id % 7 <= 4 THEN 2 ELSE 3 END AS frame_limit,
    least(12, greatest(1, round_even(value * 10 / 180.0::DOUBLE, 0)::INT + 1)) AS sections, {_R6.format('1.0::DOUBLE / (1.0::DOUBLE + exp(0.5::DOUBLE * (value / 100)))')} AS weight FROM events""")  # fmt: skip
def mth_frame_scores(spark, sf):
    v, k = F.col("value"), F.col("event_id")
    return _events(spark, sf).select(
        "event_id",
        round6(M.content_score(v, v / 100, v / 200, v / 50)).alias("content"),
        round6(M.information_score(F.floor(v), k % 9)).alias("info"),
        M.frame_limit(v, k % 7).alias("frame_limit"),
        M.section_count(v * 10).alias("sections"),
        round6(M.reversed_sigmoid(v / 100)).alias("weight"),
    )


@query("mth_boxes", "SELECT l_orderkey, l_linenumber, least(40, greatest(0, l_quantity::INT)) AS x2, least(30, greatest(0, (l_tax * 1000)::INT)) AS y2, abs(l_quantity * 1.0 * (l_tax * 1000)) AS area FROM lineitem".replace("(l_tax * 1000)::INT", "floor(l_tax * 1000 + 0.5)::INT"))
def mth_boxes(spark, sf):
    h = l_tax = F.col("l_tax") * 1000
    box = M.clip_box(F.lit(0), F.lit(0), F.col("l_quantity").cast("int"), F.floor(l_tax + 0.5).cast("int"), 40, 30)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    z, w = F.lit(0.0), F.col("l_quantity")
    area = M.polygon_area(F.array(corner(z, z), corner(w, z), corner(w, h), corner(z, h)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", box["x2"].alias("x2"), box["y2"].alias("y2"), area.alias("area"))


@query("str_small", r"SELECT page_id, replace(url, '\', '/') AS posix, regexp_replace(regexp_replace(html, '\s+', ' ', 'g'), '^ | $', '', 'g') = html AS one_line, CASE WHEN contains(lower(url), 'qwen') THEN 'qwen' WHEN contains(lower(url), '1') THEN 'one' ELSE 'default' END AS model FROM pages")
def str_small(spark, sf):
    """Paths with forward slashes, white space collapsed, model aliases by what a name contains."""
    low = F.lower("url")
    model = F.when(low.contains("qwen"), "qwen").when(low.contains("1"), "one").otherwise("default")
    flat = F.regexp_replace(F.regexp_replace("html", r"\s+", " "), "^ | $", "")
    return table(spark, sf, "pages").select("page_id", F.replace("url", F.lit("\\"), F.lit("/")).alias("posix"), (flat == F.col("html")).alias("one_line"), model.alias("model"))


@query("str_compact_transcript", f"""WITH {_ITEMS}, c AS (SELECT doc_id, i // ceil(max(i + 1) OVER (PARTITION BY doc_id) / 6.0)::BIGINT AS part, a, b FROM items)
    SELECT doc_id, part, floor(min(a))::BIGINT AS first, floor(max(b))::BIGINT AS last, count(*) AS n FROM c GROUP BY ALL""")
def str_compact_transcript(spark, sf):
    """At most six even parts of each transcript, with their times."""
    n = F.max(F.col("i") + 1).over(Window.partitionBy("doc_id"))
    part = items(spark, sf).select("doc_id", F.floor(F.col("i") / F.ceil(n / 6.0)).alias("part"), "a", "b")
    return part.groupBy("doc_id", "part").agg(F.floor(F.min("a")).alias("first"), F.floor(F.max("b")).alias("last"), F.count("*").alias("n"))


# --- reports --------------------------------------------------------------------


@query("agg_video_complexity", _with(_FRAMES) + f"""SELECT video, {_R6.format("avg((value >= 50)::INT)")} AS success, median(value) AS median_confidence, {_R6.format('avg(abs(value - prev)) FILTER (value >= 50 AND prev >= 50)')} AS jitter,
    CASE WHEN avg((value >= 50)::INT) >= 0.5 THEN 'classic' ELSE 'hybrid' END AS mode FROM (SELECT *, lag(value) OVER (PARTITION BY video ORDER BY idx) AS prev FROM frames) GROUP BY 1""")
def agg_video_complexity(spark, sf):
    f = frames(_events(spark, sf)).withColumn("prev", F.lag("value").over(Window.partitionBy("video").orderBy("idx")))
    good = F.avg((F.col("value") >= 50).cast("int"))
    steady = F.when((F.col("value") >= 50) & (F.col("prev") >= 50), F.abs(F.col("value") - F.col("prev")))
    return f.groupBy("video").agg(round6(good).alias("success"), F.median("value").alias("median_confidence"), round6(F.avg(steady)).alias("jitter"), F.when(good >= 0.5, "classic").otherwise("hybrid").alias("mode"))


@query("agg_epochs", "SELECT user_id, min(value) AS best, max_by(value, {'t': ts, 'e': event_id}) AS final, count(*) AS n FROM events GROUP BY 1")
def agg_epochs(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(F.min("value").alias("best"), F.max_by("value", F.struct("ts", "event_id")).alias("final"), F.count("*").alias("n"))


@query("agg_dominant_label", _with(_FRAMES, _THRESHOLDS, _MARKED) + """, w AS (SELECT video, idx // 8 AS win, min(t) AS a, max(t) AS b FROM frames GROUP BY ALL), s AS (SELECT video, seg, min(t) AS a, max(t) AS b FROM islands GROUP BY ALL),
    o AS (SELECT video, win, seg, least(w.b, s.b) - greatest(w.a, s.a) AS ov FROM w JOIN s USING (video) WHERE least(w.b, s.b) - greatest(w.a, s.a) > 0)
    SELECT video, win, min_by(seg, {'v': -ov, 's': seg}) AS seg FROM o GROUP BY ALL""")
def agg_dominant_label(spark, sf):
    """The segment that covers most of each window of eight frames; the first on ties. Both meet by video and day, in the first day that they share."""
    m = _marked(spark, sf)
    w = m.groupBy("video", F.floor(F.col("idx") / 8).alias("win")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    s = m.groupBy("video", "seg").agg(F.min("t").alias("c"), F.max("t").alias("d"))
    both = F.least("b", "d") - F.greatest("a", "c")
    day = lambda c: F.floor(F.col(c) / 86400)
    x, y = w.withColumn("day", F.explode(F.sequence(day("a"), day("b")))), s.withColumn("day", F.explode(F.sequence(day("c"), day("d"))))
    o = x.join(y, ["video", "day"]).where(F.col("day") == F.greatest(day("a"), day("c"))).withColumn("both", both).where("both > 0")
    return o.groupBy("video", "win").agg(F.min_by("seg", F.struct(-F.col("both"), F.col("seg"))).alias("seg"))


# --- windows --------------------------------------------------------------------


@query("win_families", _with(_FRAMES, _THRESHOLDS, _MARKED, _STEP, _SEGMENTS) + """, r AS (SELECT *, t_end - t_start AS dur, CASE WHEN coalesce(t_start - lag(t_end) OVER w, 1e18::DOUBLE) > 3600 THEN 1 ELSE 0 END AS fresh FROM segments WINDOW w AS (PARTITION BY video ORDER BY seg)),
    f AS (SELECT *, sum(fresh) OVER (PARTITION BY video ORDER BY seg)::BIGINT AS family FROM r)
    SELECT video, family, seg FROM (SELECT *, row_number() OVER (PARTITION BY video, family ORDER BY CASE WHEN dur >= 86400 THEN 0 ELSE 1 END, CASE WHEN dur >= 86400 THEN t_start END, dur DESC, seg) AS rn FROM f) WHERE rn = 1""")
def win_families(spark, sf):
    """Families of segments less than an hour apart, and of each its first long segment, else its longest."""
    m = _marked(spark, sf)
    w = Window.partitionBy("video").orderBy("seg")
    s = segments(m, sample_step(m)).withColumn("dur", F.col("t_end") - F.col("t_start"))
    apart = F.coalesce(F.col("t_start") - F.lag("t_end").over(w), F.lit(1e18)) > 3600
    f = s.withColumn("fresh", apart.cast("int")).withColumn("family", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    long = F.col("dur") >= 86400
    order = Window.partitionBy("video", "family").orderBy(F.when(long, 0).otherwise(1), F.when(long, F.col("t_start")), F.desc("dur"), "seg")
    return f.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("video", "family", "seg")


_TURNS = f"turns AS (SELECT conv_id, turn, list_sort(list_distinct({_tokens('text')})) AS t FROM conversations)"


@query("win_boundary_score", f"WITH {_TURNS} SELECT conv_id, turn, {_R6.format('1 - CASE WHEN len(t) + len(nxt) > 0 THEN len(list_intersect(t, nxt)) / (len(t) + len(nxt))::DOUBLE ELSE 0 END')} AS score FROM (SELECT *, lead(t) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM turns) WHERE nxt IS NOT NULL")
def win_boundary_score(spark, sf):
    """How little each turn shares with the next, by the tokens they have in common."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    nxt = t.withColumn("nxt", F.lead("t").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt IS NOT NULL")
    return nxt.select("conv_id", "turn", round6(1 - M.overlap_similarity(F.col("t"), F.col("nxt"))).alias("score"))


@query("win_ranges", "SELECT conv_id, part, min(turn) AS first, max(turn) AS last FROM (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS part FROM conversations) GROUP BY ALL")
def win_ranges(spark, sf):
    """Ranges of turns from one boundary (a user's turn) to the next."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.sum((F.col("role") == "user").cast("int")).over(w).alias("part"))
    return c.groupBy("conv_id", "part").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))


# --- memberships and choices ------------------------------------------------------

_BAGS = f"""a AS (SELECT doc_id, token, count(*) AS x FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY ALL), na AS (SELECT doc_id, sqrt(sum(x * x)::DOUBLE) AS n FROM a GROUP BY 1),
    b AS (SELECT item_id, token, count(*) AS y FROM (SELECT item_id, unnest({_tokens('text')}) AS token FROM benchmark) GROUP BY ALL), nb AS (SELECT item_id, sqrt(sum(y * y)::DOUBLE) AS n FROM b GROUP BY 1),
    cos AS (SELECT doc_id, item_id, sum(x * y)::DOUBLE / (any_value(na.n) * any_value(nb.n)) AS cos FROM a JOIN b USING (token) JOIN na USING (doc_id) JOIN nb USING (item_id) GROUP BY ALL)"""


def section_cosines(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, item_id, cos) of texts and sections that share a token."""
    bag = lambda df, k, n: df.select(k, F.explode(T.tokens(F.col("text"))).alias("token")).groupBy(k, "token").agg(F.count("*").alias(n))
    a, b = bag(documents, "doc_id", "x"), bag(sections, "item_id", "y")
    norm = lambda df, k, n: df.groupBy(k).agg(F.sqrt(F.sum(F.col(n) * F.col(n)).cast("double")).alias(f"n{n}"))
    dots = a.join(b, "token").groupBy("doc_id", "item_id").agg(F.sum(F.col("x") * F.col("y")).cast("double").alias("dot"))
    return dots.join(norm(a, "doc_id", "x"), "doc_id").join(norm(b, "item_id", "y"), "item_id").select("doc_id", "item_id", (F.col("dot") / (F.col("nx") * F.col("ny"))).alias("cos"))


@query("seq_membership", f"""WITH {_BAGS}, r AS (SELECT doc_id, item_id, cos, row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, item_id) AS rn FROM (SELECT doc_id, item_id, floor(cos * 1000000 + 0.5) / 1000000 AS cos FROM cos))
    SELECT x.doc_id, x.item_id AS best, x.cos AS confidence, {_R6.format('x.cos - coalesce(y.cos, 0)')} AS margin, x.cos < 0.45 OR x.cos - coalesce(y.cos, 0) < 0.15 AS ambiguous FROM r x LEFT JOIN r y ON y.doc_id = x.doc_id AND y.rn = 2 WHERE x.rn = 1""")
def seq_membership(spark, sf):
    """The plan section each document is most like, how much, by what margin, and whether that is ambiguous."""
    cos = section_cosines(spread(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "benchmark")).withColumn("cos", round6("cos"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("cos"), "item_id")
    r = cos.withColumn("rn", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("cos").over(w), F.lit(0.0))).where("rn = 1")
    margin = F.col("cos") - F.col("second")
    return r.select("doc_id", F.col("item_id").alias("best"), F.col("cos").alias("confidence"), round6(margin).alias("margin"), ((F.col("cos") < 0.45) | (margin < 0.15)).alias("ambiguous"))


def diverse_top(rows: DataFrame, by: str, k: int, gap: float, weak: float) -> DataFrame:
    """Of each group's rows by score, at most k that are no nearer in time than gap to a chosen one; weak ones only as the first: a fold."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "event_id", "t")))
    near = lambda kept, r: F.exists(kept, lambda q: F.abs(q.t - r.t) <= gap)
    fold = F.aggregate(
        ranked,
        F.expr("cast(array() as array<struct<rank:double,event_id:bigint,t:double>>)"),
        lambda kept, r: F.when((F.size(kept) >= k) | ((F.size(kept) > 0) & (-r["rank"] < weak)) | near(kept, r), kept).otherwise(F.concat(kept, F.array(r))),
    )
    return rows.groupBy(by).agg(fold.alias("kept")).select(by, F.inline("kept")).select(by, "event_id")


@query("seq_diverse_top", _with(_FRAMES).replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT video, event_id, t, score, row_number() OVER (PARTITION BY video ORDER BY score DESC, event_id) AS n FROM scored),
    walk AS (SELECT video, n, event_id, TRUE AS keep, [t] AS kept FROM n WHERE n = 1 UNION ALL
    SELECT b.video, b.n, b.event_id, ok, CASE WHEN ok THEN list_append(kept, b.t) ELSE kept END FROM (SELECT b.*, w.kept, len(w.kept) < 3 AND b.score >= 0.22 AND len(list_filter(w.kept, lambda k: abs(k - b.t) <= 86400)) = 0 AS ok FROM walk w JOIN n b ON b.video = w.video AND b.n = w.n + 1) b)
    SELECT video, event_id FROM walk WHERE keep""")
def seq_diverse_top(spark, sf):
    return diverse_top(scored(_events(spark, sf)), "video", 3, 86400, 0.22)


def monotone_titles(scores: DataFrame) -> DataFrame:
    """Along each lecture's segments the title of best score that is not before the last one used; the first on ties: a fold.

    scores: (lecture, seg, titles array of doubles by title number).
    """
    rows = F.array_sort(F.collect_list(F.struct("seg", "titles")))
    pick = lambda s, r: F.array_min(F.transform(F.filter(F.sequence(s.last, F.size(r.titles) - 1), lambda j: F.get(r.titles, j) - 0.03 * F.abs(j - s.n) >= F.array_max(F.transform(F.sequence(s.last, F.size(r.titles) - 1), lambda q: F.get(r.titles, q) - 0.03 * F.abs(q - s.n)))), lambda j: j))
    fold = F.aggregate(
        rows,
        F.expr("named_struct('last', 0, 'n', 0, 'out', cast(array() as array<struct<seg:bigint,title:int>>))"),
        lambda s, r: F.struct(pick(s, r).alias("last"), (s.n + 1).alias("n"), F.concat(s.out, F.array(F.struct(r.seg.alias("seg"), pick(s, r).alias("title")))).alias("out")),
    )
    return scores.groupBy("lecture").agg(fold.alias("f")).select("lecture", F.inline("f.out"))


@query("seq_monotone_titles", """WITH RECURSIVE s AS (SELECT conv_id AS lecture, turn AS seg, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, list_transform(range(0, 5), lambda k: ((length(text) * (k + 3) + turn * 7) % 11) / 10.0::DOUBLE) AS titles FROM conversations),
    walk AS (SELECT lecture, n, seg, list_position(l, list_max(l)) - 1 AS title FROM (SELECT *, list_transform(range(0, 5), lambda j: titles[j + 1] - 0.03::DOUBLE * abs(j - n)) AS l FROM s WHERE n = 0)
    UNION ALL SELECT lecture, n, seg, title + list_position(l, list_max(l)) - 1 FROM (SELECT b.lecture, b.n, b.seg, w.title, list_transform(range(w.title, 5), lambda j: b.titles[j + 1] - 0.03::DOUBLE * abs(j - b.n)) AS l FROM walk w JOIN s b ON b.lecture = w.lecture AND b.n = w.n + 1))
    SELECT lecture, seg, title::BIGINT AS title FROM walk""")
def seq_monotone_titles(spark, sf):
    c = table(spark, sf, "conversations")
    titles = F.transform(F.expr("sequence(0, 4)"), lambda k: ((F.length("text") * (k + 3) + F.col("turn") * 7) % 11) / 10.0)
    return monotone_titles(c.select(F.col("conv_id").alias("lecture"), F.col("turn").alias("seg"), titles.alias("titles"))).withColumn("title", F.col("title").cast("long"))


@query("seq_fallback_plan", f"""WITH {_ITEMS.replace('SELECT doc_id, i, length(s) AS n', 'SELECT doc_id, i, s, length(s) AS n')}, c AS (SELECT doc_id, i, s, i // ceil(max(i + 1) OVER (PARTITION BY doc_id) / 3.0)::BIGINT AS part FROM items),
    k AS (SELECT doc_id, part, u.t AS token, i * 10000 + u.p AS pos FROM (SELECT doc_id, part, i, {_tokens('s')} AS ts FROM c), LATERAL (SELECT unnest(ts) AS t, generate_subscripts(ts, 1) AS p) u),
    r AS (SELECT doc_id, part, token, row_number() OVER (PARTITION BY doc_id, part ORDER BY tf DESC, pos) AS rn FROM (SELECT doc_id, part, token, count(*) AS tf, min(pos) AS pos FROM k GROUP BY ALL))
    SELECT doc_id, part, string_agg(token, ' / ' ORDER BY rn) AS title FROM r WHERE rn <= 4 GROUP BY ALL""")
def seq_fallback_plan(spark, sf):
    """Three even parts of each transcript, each titled by its four most frequent tokens."""
    n = F.max(F.col("i") + 1).over(Window.partitionBy("doc_id"))
    c = items(spark, sf).select("doc_id", "i", "text", F.floor(F.col("i") / F.ceil(n / 3.0)).alias("part"))
    k = c.select("doc_id", "part", "i", F.posexplode(T.tokens(F.col("text"))).alias("p", "token")).groupBy("doc_id", "part", "token").agg(F.count("*").alias("tf"), F.min(F.col("i") * 10000 + F.col("p")).alias("pos"))
    r = k.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy(F.desc("tf"), "pos"))).where("rn <= 4")
    return r.groupBy("doc_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "token"))), lambda x: x.token), " / ").alias("title"))


# --- joins ------------------------------------------------------------------------


@query("jn_band_boundaries", _with(_FRAMES, _THRESHOLDS, _MARKED) + ", x AS (SELECT video, seg, min(t) AS t FROM islands GROUP BY ALL) SELECT x.video, x.seg, count(*) AS n FROM x JOIN frames f ON f.video = x.video AND abs(f.t - x.t) <= 3600 GROUP BY ALL")
def jn_band_boundaries(spark, sf):
    """How many frames lie within an hour of each boundary: time buckets of an hour make it an equality join with a rest."""
    hour = F.floor(F.col("t") / 3600)
    x = _marked(spark, sf).groupBy("video", "seg").agg(F.min("t").alias("at")).withColumn("bucket", F.explode(F.expr("sequence(floor(at / 3600) - 1, floor(at / 3600) + 1)")))
    f = frames(_events(spark, sf)).select("video", "t", hour.alias("bucket"))
    return x.join(f, ["video", "bucket"]).where("abs(t - at) <= 3600").groupBy("video", "seg").agg(F.count("*").alias("n"))


@query("jn_sentence_pairs", f"""WITH s AS (SELECT item_id, list_distinct({_tokens('text')}) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, {_R6.format('len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t))::DOUBLE')} AS sim FROM s a JOIN s b ON a.item_id < b.item_id WHERE len(list_intersect(a.t, b.t)) > 0""")
def jn_sentence_pairs(spark, sf):
    """Similarities of all sections that share a token, through an inverted index."""
    s = table(spark, sf, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    w = s.select("item_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    x, y = w.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "token"), w.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "token")
    both = x.join(y, "token").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    return both.select("a", "b", round6(F.col("k") / (F.col("na") + F.col("nb")).cast("double")).alias("sim"))


@query("jn_first_containing", _with(_FRAMES, _THRESHOLDS, _MARKED) + ", ch AS (SELECT video, seg, min(t) AS a, coalesce(lead(min(t)) OVER (PARTITION BY video ORDER BY seg), 1e18::DOUBLE) AS b FROM islands GROUP BY video, seg) SELECT e.event_id, min(seg) AS seg FROM frames e JOIN ch USING (video) WHERE t >= a AND t < b GROUP BY 1")
def jn_first_containing(spark, sf):
    """Each frame's chapter, the first that holds its time: a running maximum, as chapters follow each other."""
    m = _marked(spark, sf)
    starts = m.groupBy("video", "seg").agg(F.min("t").alias("t")).groupBy("video", "t").agg(F.max("seg").alias("seg"))
    both = m.select("video", "t", F.lit(1).alias("kind"), "event_id", F.lit(None).cast("long").alias("seg")).unionByName(starts.select("video", "t", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event_id"), "seg"))
    w = Window.partitionBy("video").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("at", F.max("seg").over(w)).where("kind = 1").select("event_id", F.col("at").alias("seg"))


# --- library views ------------------------------------------------------------------


@query("orm_note_detail", "SELECT o_orderkey, o_orderstatus, l.quality FROM orders LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = o_orderkey".replace("l.quality", "coalesce(l.quality, -1) AS quality"))
def orm_note_detail(spark, sf):
    review = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.min("quality").alias("quality"))
    return table(spark, sf, "orders").join(review, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("orm_favourites", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus IN ('F', 'O')")
def orm_favourites(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1") & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_custkey")


@query("orm_mark_read", "SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS unread FROM events WHERE user_id IS NOT NULL")
def orm_mark_read(spark, sf):
    return _events(spark, sf).where("user_id IS NOT NULL").select("event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("unread"))


@query("orm_log_tail", "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 80")
def orm_log_tail(spark, sf):
    """The last eighty messages of each note, a limit that is the feature."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, sf).select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place")).where("place <= 80")


@query("orm_profile", "SELECT c_custkey, count(o_orderkey) AS notes, count(*) FILTER (o_orderpriority LIKE '1%') AS favourites FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def orm_profile(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("notes"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("favourites"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0, ["notes", "favourites"])


@query("flt_language_gate", f"SELECT source, lang, {_R6.format('n / total::DOUBLE')} AS share FROM (SELECT *, sum(n) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)) WHERE rn = 1 AND n / total::DOUBLE >= 0.6")
def flt_language_gate(spark, sf):
    """Sources with one clear language."""
    w = Window.partitionBy("source")
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    r = n.withColumn("share", F.col("n") / F.sum("n").over(w).cast("double")).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "lang")))
    return r.where("rn = 1 AND share >= 0.6").select("source", "lang", round6("share").alias("share"))


@query("txt_paragraphs", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT x.label, x.rn, x.vec_id, floor(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) * 1000000 + 0.5) / 1000000 AS sim FROM e x LEFT JOIN e y ON y.label = x.label AND y.rn = x.rn + 1),
    m AS (SELECT *, sim < lag(sim, 1) OVER w AND sim < lag(sim, 2) OVER w AND sim < lead(sim, 1) OVER w AND sim < lead(sim, 2) OVER w AS valley FROM p WINDOW w AS (PARTITION BY label ORDER BY rn))
    SELECT vec_id, coalesce(sum(valley::INT) OVER (PARTITION BY label ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS paragraph FROM m""")
def txt_paragraphs(spark, sf):
    """Paragraph numbers: a new one behind each valley of the similarity of neighbours."""
    w = Window.partitionBy("label").orderBy("rn")
    e = table(spark, sf, "embeddings").withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    p = e.withColumn("nxt", F.lead("embedding").over(w)).withColumn("sim", F.when(F.col("nxt").isNotNull(), round6(M.cosine(F.col("embedding"), F.col("nxt")))))
    s = F.col("sim")
    valley = (s < F.lag("sim", 1).over(w)) & (s < F.lag("sim", 2).over(w)) & (s < F.lead("sim", 1).over(w)) & (s < F.lead("sim", 2).over(w))
    m = p.withColumn("valley", F.coalesce(valley, F.lit(False)).cast("int"))
    return m.select("vec_id", F.coalesce(F.sum("valley").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("paragraph"))
