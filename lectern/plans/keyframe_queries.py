"""All thresholds, scroll families, containment chains, the whole key-frame chain and its ablation, over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import maths as M
from lectern.functions.images import picture_metrics
from lectern.functions.maths import round6
from lectern.operators.cut import cut
from lectern.operators.keyframes import PAIR, families, last_of_chains
from lectern.plans.catalog import query, table
from lectern.plans.frame_queries import _DEDUP, _FRAMES, _MARKED, _SEGMENTS, _STEP, _THRESHOLDS, _events, _marked, _with, best_rows, frames, greedy_dedup, islands, sample_step, scored, segments, thresholds
from lectern.plans.geometry_queries import r6

GUARD, LEAST, PRIMARY, GAP = 60.0, 1.0, 86400.0, 172800.0

_STABLE = """stable AS (SELECT *, least(0.98::DOUBLE, greatest(0.88::DOUBLE, 1 - greatest(0.03::DOUBLE, ssim_thr * 0.55::DOUBLE))) AS stable_ssim, least(10.0::DOUBLE, greatest(4.0::DOUBLE, hash_thr * 0.40::DOUBLE)) AS stable_hash, least(0.18::DOUBLE, greatest(0.04::DOUBLE, score_thr * 0.45::DOUBLE)) AS stable_change,
    least(0.88::DOUBLE, greatest(0.72::DOUBLE, 1 - greatest(0.18::DOUBLE, ssim_thr * 1.35::DOUBLE))) AS simple_ssim, least(20.0::DOUBLE, greatest(6.0::DOUBLE, hash_thr * 0.90::DOUBLE)) AS simple_hash, least(0.60::DOUBLE, greatest(0.18::DOUBLE, score_thr * 0.85::DOUBLE)) AS simple_score FROM base)"""
_ALL = ("ssim_thr", "hash_thr", "score_thr", "stable_ssim", "stable_hash", "stable_change", "return_ssim", "return_hash", "simple_ssim", "simple_hash", "simple_score")


@query("agg_all_thresholds", _with(_FRAMES, _THRESHOLDS, _STABLE) + f"SELECT video, {', '.join(f'{r6(c)} AS {c}' for c in _ALL)} FROM (SELECT *, least(0.99::DOUBLE, greatest(0.93::DOUBLE, stable_ssim + 0.02::DOUBLE)) AS return_ssim, least(12.0::DOUBLE, greatest(4.0::DOUBLE, stable_hash * 1.15::DOUBLE)) AS return_hash FROM stable)")
def agg_all_thresholds(spark, sf):
    """The three robust thresholds of each video, and the eight that follow from them."""
    t = thresholds(scored(_events(spark, sf)), ["video"])
    s, h, c = F.col("ssim_thr"), F.col("hash_thr"), F.col("score_thr")
    t = t.withColumns({"stable_ssim": M.clamp(1 - F.greatest(F.lit(0.03), s * 0.55), 0.88, 0.98), "stable_hash": M.clamp(h * 0.40, 4.0, 10.0), "stable_change": M.clamp(c * 0.45, 0.04, 0.18), "simple_ssim": M.clamp(1 - F.greatest(F.lit(0.18), s * 1.35), 0.72, 0.88), "simple_hash": M.clamp(h * 0.90, 6.0, 20.0), "simple_score": M.clamp(c * 0.85, 0.18, 0.60)})
    t = t.withColumns({"return_ssim": M.clamp(F.col("stable_ssim") + 0.02, 0.93, 0.99), "return_hash": M.clamp(F.col("stable_hash") * 1.15, 4.0, 12.0)})
    return t.select("video", *[round6(k).alias(k) for k in _ALL])


_PAIRED = """paired AS (SELECT s.*, f.value AS v, f.d AS dd, lag(f.value) OVER w AS pv, lag(f.d) OVER w AS pd FROM {segs} s JOIN islands f ON f.video = s.video AND f.idx = s.anchor WINDOW w AS (PARTITION BY s.video ORDER BY s.seg)),
    scrolled AS (SELECT *, greatest(abs(v - pv) / 4, abs(dd - pd) / 4) >= 10 AND 1 - least(1.0::DOUBLE, abs(v - pv) / 200) >= 0.05 AND 1 - abs(v - pv) / 400 >= 0.65 AND least(1.0::DOUBLE, raw + abs(dd - pd) / 4 / 60) >= 0.90 AND least(1.0::DOUBLE, raw + abs(dd - pd) / 4 / 60) >= raw + 0.05::DOUBLE AS related FROM (SELECT *, 1 - least(1.0::DOUBLE, abs(v - pv) / (abs(v) + abs(pv) + 1)) AS raw FROM paired)),
    famed AS (SELECT *, sum(CASE WHEN {on} AND coalesce(related, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY seg) AS family FROM scrolled),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, family ORDER BY CASE WHEN t_end - t_start >= 86400 THEN 0 ELSE 1 END, CASE WHEN t_end - t_start >= 86400 THEN t_start END, t_end - t_start DESC, t_start) AS rn FROM famed) WHERE rn = 1)"""


def _paired(segs: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Segments with what the pair metrics need of their anchors."""
    anchors = rows.select(*by, F.col("idx").alias("anchor"), F.struct(*PAIR).alias("pair"))
    return segs.join(anchors, [*by, "anchor"])


@query("win_scroll_families", _with(_FRAMES, _THRESHOLDS, _MARKED, _STEP, _SEGMENTS, _PAIRED.format(segs="segments", on="TRUE")) + "SELECT video, family::BIGINT AS family, seg FROM chosen")
def win_scroll_families(spark, sf):
    m = _marked(spark, sf)
    return families(_paired(segments(m, sample_step(m)), m, ["video"]), ["video"], PRIMARY).select("video", "family", "seg")


_CHAIN = """held AS (SELECT *, coalesce(t - pt <= 172800 AND both / (p + 1e-9::DOUBLE) >= 0.98 AND greatest(0.0::DOUBLE, p - both) / (p + 1e-9::DOUBLE) <= 0.02 AND c / (p + 1e-9::DOUBLE) >= 0.995 AND abs(c - p) / 10 <= 10, FALSE) AND {on} AS held FROM
    (SELECT *, greatest(0.0::DOUBLE, least(p, c) - abs(d - pd) / 50) AS both FROM (SELECT *, 100 + lag(value) OVER w AS p, 100 + value AS c, lag(d) OVER w AS pd, lag(t) OVER w AS pt FROM {rows} WINDOW w AS (PARTITION BY video ORDER BY t, seg)))),
    kept_last AS (SELECT * FROM (SELECT *, coalesce(lead(held) OVER (PARTITION BY video ORDER BY t, seg), FALSE) AS next_holds FROM held) WHERE NOT next_holds)""".replace("both", "joint")


@query("win_contained_last", _with(_FRAMES, _CHAIN.format(rows="(SELECT *, 0 AS seg FROM frames)", on="TRUE")) + "SELECT video, idx FROM kept_last")
def win_contained_last(spark, sf):
    """Of frames that each hold all of the one before, the last."""
    f = frames(_events(spark, sf)).withColumn("seg", F.lit(0))
    return last_of_chains(f, ["video"], GAP).select("video", "idx")


_ABSORB = """renamed AS (SELECT video, seg, sum(CASE WHEN seg > 0 AND t_end - t_start >= {least} THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY seg)::BIGINT AS new_seg FROM segments),
    absorbed AS (SELECT i.* EXCLUDE (seg), new_seg AS seg FROM islands i JOIN renamed r ON i.video = r.video AND i.seg = r.seg),
    wide AS (SELECT video, seg, min(t) AS t_start, max(t) + any_value(step) AS t_end, min_by(idx, {{'v': -value, 'i': idx}}) AS anchor FROM absorbed JOIN step USING (video) GROUP BY ALL)"""
_BEST = """inside AS (SELECT a.*, c.t_start, c.t_end, a.t >= c.t_start + 60 AND a.t <= c.t_end - 60 AS inner_row FROM absorbed a JOIN chosen c ON a.video = c.video AND a.seg = c.seg WHERE c.t_end - c.t_start >= 1),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, seg ORDER BY value DESC, score DESC, idx) AS rn FROM (SELECT *, bool_or(inner_row) OVER (PARTITION BY video, seg) AS any_inner FROM inside) WHERE inner_row OR NOT any_inner) WHERE rn = 1)"""
_WALK = _DEDUP.replace("FROM best)", "FROM kept_last)").replace("ORDER BY seg) AS n", "ORDER BY t, seg) AS n")


def absorbed_segments(marked: DataFrame, step: DataFrame, by: list[str], least) -> tuple[DataFrame, DataFrame]:
    """Rows with short segments absorbed into the one before, and these wider segments with their anchors."""
    w = Window.partitionBy(*by).orderBy("seg")
    ends = marked.groupBy(*by, "seg").agg(F.min("t").alias("a"), F.max("t").alias("b"), *([F.first("least_s").alias("least_s")] if "least_s" in marked.columns else [])).join(step, "video")
    long = (F.col("seg") > 0) & (F.col("b") + F.col("step") - F.col("a") >= least)
    renamed = ends.select(*by, "seg", F.sum(long.cast("int")).over(w).alias("new_seg"))
    rows = marked.join(renamed, [*by, "seg"]).drop("seg").withColumnRenamed("new_seg", "seg")
    anchor = F.min_by("idx", F.struct((-F.col("value")).alias("v"), F.col("idx").alias("i")))
    wide = rows.groupBy(*by, "seg").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), anchor.alias("anchor")).join(step, "video").withColumn("t_end", F.col("t_end") + F.col("step")).drop("step")
    return rows, wide


def guarded_best(rows: DataFrame, segs: DataFrame, by: list[str]) -> DataFrame:
    """The best row of each long enough segment, off its edges where rows are left there."""
    w = Window.partitionBy(*by, "seg")
    j = rows.join(segs.where(F.col("t_end") - F.col("t_start") >= LEAST).select(*by, "seg", "t_start", "t_end"), [*by, "seg"])
    inner = (F.col("t") >= F.col("t_start") + GUARD) & (F.col("t") <= F.col("t_end") - GUARD)
    fit = j.withColumn("inner", inner).withColumn("any_inner", F.max("inner").over(w)).where(F.col("inner") | ~F.col("any_inner"))
    return fit.withColumn("rn", F.row_number().over(w.orderBy(F.desc("value"), F.desc("score"), "idx"))).where("rn = 1").drop("rn", "inner", "any_inner")


@query(
    "seq_keyframe_chain",
    _with(_FRAMES, _THRESHOLDS, _MARKED, _STEP, _SEGMENTS, _ABSORB.format(least="600"), _PAIRED.format(segs="(SELECT * FROM wide WHERE t_end - t_start >= 1)", on="TRUE").replace("JOIN islands f", "JOIN absorbed f"), _BEST, _CHAIN.format(rows="best", on="TRUE"), _WALK).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT video, seg, event_id FROM walk WHERE keep",
)
def seq_keyframe_chain(spark, sf):
    """The whole chain: absorption, length, scroll families, guard band, best row, containment, near-duplicate removal."""
    m = cut(_marked(spark, sf))
    rows, wide = absorbed_segments(m, sample_step(m), ["video"], 600.0)
    kept = families(_paired(wide.where(F.col("t_end") - F.col("t_start") >= LEAST), rows, ["video"]), ["video"], PRIMARY)
    best = last_of_chains(guarded_best(rows, kept, ["video"]), ["video"], GAP)
    return in_time_order(best, ["video"], 22).select("video", "seg", "event_id")


def in_time_order(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """greedy_dedup in the order of time."""
    w = Window.partitionBy(*by).orderBy("t", "seg")
    numbered = rows.select(*by, F.row_number().over(w).cast("long").alias("n"), "seg", "event_id", "phash")
    kept = greedy_dedup(numbered.select(*by, F.col("n").alias("seg"), "event_id", "phash"), by, most)
    return kept.withColumnRenamed("seg", "n").join(numbered.select(*by, "n", "seg"), [*by, "n"])


#: name, least seconds of a segment, hashes, scroll families, containment, source of the metrics.
VARIANTS = (
    ("baseline", 600.0, True, True, True, "roi"), ("no_scroll_family_filter", 600.0, True, False, True, "roi"), ("no_contained_filter", 600.0, True, True, False, "roi"), ("no_scroll_filters", 600.0, True, False, False, "roi"),
    ("no_phash", 600.0, False, True, True, "roi"), ("no_semantic_filter", 0.0, True, True, True, "roi"), ("no_roi", 600.0, True, True, True, "full_frame"),
    ("semantic_120s", 120.0, True, True, True, "roi"), ("semantic_3600s", 3600.0, True, True, True, "roi"), ("semantic_86400s", 86400.0, True, True, True, "roi"),
)
_NAMES = ("variant", "least_s", "use_hash", "scroll", "contained", "source")
_GRID = "variants AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s}::DOUBLE, {h}, {a}, {b}, '{src}')" for n, s, h, a, b, src in VARIANTS) + f") v({', '.join(_NAMES)}))"
_ROWS = """scored AS (SELECT variant || '/' || video AS video, variant, least_s, use_hash, scroll, contained, event_id, value, idx, t, d, ssim, phash, CASE WHEN use_hash THEN hash_gap ELSE 0 END AS hash_gap,
    CASE WHEN use_hash THEN 0.60::DOUBLE * (1 - ssim) + 0.25::DOUBLE * (hash_gap / 64.0::DOUBLE) + 0.10::DOUBLE * least(1.0::DOUBLE, d / 100 / 0.08::DOUBLE) + 0.05::DOUBLE * least(1.0::DOUBLE, d / 200 / 0.08::DOUBLE) ELSE 0.75::DOUBLE * (1 - ssim) + 0.15::DOUBLE * least(1.0::DOUBLE, d / 100 / 0.08::DOUBLE) + 0.10::DOUBLE * least(1.0::DOUBLE, d / 200 / 0.08::DOUBLE) END AS score
    FROM (SELECT * EXCLUDE (d, ssim), CASE WHEN source = 'roi' THEN d ELSE d / 2 END AS d, CASE WHEN source = 'roi' THEN ssim ELSE (1 + ssim) / 2 END AS ssim FROM frames, variants))"""


@query(
    "seq_ablation_grid",
    _with(_FRAMES.replace("scored AS", "scored_h AS"), _GRID, _ROWS, _THRESHOLDS, _MARKED.replace("OR hash_gap >=", "OR use_hash AND hash_gap >="), _STEP.replace("FROM frames", "FROM scored"), _SEGMENTS, "flags AS (SELECT DISTINCT video, least_s, use_hash, scroll, contained FROM scored)",
          _ABSORB.format(least="least_s").replace("FROM segments)", "FROM segments JOIN flags USING (video))"),
          _PAIRED.format(segs="(SELECT * FROM wide JOIN flags USING (video) WHERE t_end - t_start >= 1)", on="scroll").replace("JOIN islands f", "JOIN absorbed f"), _BEST, _CHAIN.format(rows="best", on="contained"),
          "numbered AS (SELECT video, seg, event_id, use_hash, ('0x' || phash)::UBIGINT AS h, row_number() OVER (PARTITION BY video ORDER BY t, seg) AS n FROM kept_last)",
          _WALK[_WALK.index("walk AS"):].replace("<= 22)) = 0", "<= CASE WHEN b.use_hash THEN 22 ELSE -1 END)) = 0"),
          "counts AS (SELECT split_part(video, '/', 1) AS variant, count(*) AS selected FROM walk WHERE keep GROUP BY 1)").replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT variant, selected, selected - (SELECT selected FROM counts WHERE variant = 'baseline') AS delta FROM counts",
)
def seq_ablation_grid(spark, sf):
    """Seven variants and a sweep over the least length, each through the whole chain, in one job; and the difference to the baseline."""
    f = frames(_events(spark, sf))
    v = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(_NAMES, row)]) for row in VARIANTS]))
    g = f.select("*", v.alias("v")).select("*", "v.*").drop("v")
    whole = F.col("source") == "roi"
    g = g.withColumns({"d": F.when(whole, F.col("d")).otherwise(F.col("d") / 2), "ssim": F.when(whole, F.col("ssim")).otherwise((1 + F.col("ssim")) / 2)})
    drop, text, edge = 1 - F.col("ssim"), F.col("d") / 100, F.col("d") / 200
    g = g.withColumn("score", F.when(F.col("use_hash"), M.change_score(drop, F.col("hash_gap"), text, edge)).otherwise(M.change_score(drop, F.lit(0), text, edge, False)))
    g = g.withColumn("hash_gap", F.when(F.col("use_hash"), F.col("hash_gap")).otherwise(F.lit(0)))
    by = ["variant", "video"]
    marked = islands(g, thresholds(g, by), by)  # without hashes the gap is 0, which never reaches its threshold of 6 or more
    rows, wide = absorbed_segments(cut(marked), sample_step(f), by, F.col("least_s"))
    rows, wide = cut(rows), cut(wide)
    segs = _paired(wide.where(F.col("t_end") - F.col("t_start") >= LEAST), rows, by)
    off = lambda k: F.col("variant").isin(*[r[0] for r in VARIANTS if not r[k]])
    kept = families(segs.where(~off(3)), by, PRIMARY).select(*by, "seg", "t_start", "t_end").unionByName(segs.where(off(3)).select(*by, "seg", "t_start", "t_end"))
    best = cut(guarded_best(rows, kept, by))
    last = last_of_chains(best.where(~off(4)), by, GAP).unionByName(best.where(off(4)))
    picked = in_time_order(last.where(~off(2)), by, 22).select(*by, "event_id").unionByName(last.where(off(2)).select(*by, "event_id"))
    counts = picked.groupBy("variant").agg(F.count("*").alias("selected"))
    base = counts.where("variant = 'baseline'").select(F.col("selected").alias("base"))  # one row
    return counts.crossJoin(F.broadcast(base)).select("variant", "selected", (F.col("selected") - F.col("base")).alias("delta"))


@query("seq_legacy_best", _with(_FRAMES) + ", c AS (SELECT *, coalesce(ssim < 0.72 AND t - lag(t) OVER (PARTITION BY video ORDER BY idx) > 10, FALSE) AS changed FROM scored), s AS (SELECT *, sum(changed::INT) OVER (PARTITION BY video ORDER BY idx) AS seg FROM c) SELECT video, seg::BIGINT AS seg, min_by(idx, {'s': -(value * CASE WHEN changed THEN 1.15::DOUBLE ELSE 1 END), 'i': idx}) AS idx FROM s GROUP BY ALL")
def seq_legacy_best(spark, sf):
    """Segments that begin where a frame differs from one more than ten seconds before, and the best frame of each; changes count a little more."""
    w = Window.partitionBy("video").orderBy("idx")
    c = scored(_events(spark, sf)).withColumn("changed", F.coalesce((F.col("ssim") < 0.72) & (F.col("t") - F.lag("t").over(w) > 10), F.lit(False)))
    s = c.withColumn("seg", F.sum(F.col("changed").cast("int")).over(w)).withColumn("worth", F.col("value") * F.when(F.col("changed"), 1.15).otherwise(1.0))
    return s.groupBy("video", "seg").agg(F.min_by("idx", F.struct((-F.col("worth")).alias("s"), F.col("idx").alias("i"))).alias("idx"))


@query(
    "seq_video_mode",
    _with(_FRAMES) + f"""SELECT video, n, reliable, {r6('rate')} AS rate, {r6('med')} AS median_confidence, {r6('mean')} AS mean_confidence, {r6('jitter')} AS jitter, CASE WHEN rate >= 0.72 AND med >= 0.60 AND jitter <= 0.05 THEN 'classic' WHEN rate < 0.45 OR med < 0.48 OR jitter > 0.10 THEN 'neural' ELSE 'hybrid' END AS mode FROM (SELECT video, count(*) AS n, count(*) FILTER (sure >= 0.58) AS reliable, count(*) FILTER (sure >= 0.58) / count(*)::DOUBLE AS rate, median(sure) AS med, avg(sure) AS mean, coalesce(avg(abs(value - prev) / 1000) FILTER (sure >= 0.58), 0) AS jitter
    FROM (SELECT *, CASE WHEN sure >= 0.58 THEN lag(value) OVER (PARTITION BY video, sure >= 0.58 ORDER BY idx) END AS prev FROM (SELECT *, least(1.0::DOUBLE, value / 150) AS sure FROM frames)) GROUP BY 1)""",
)
def seq_video_mode(spark, sf):
    """Which detector a video needs: the share of reliable frames, their confidence, and how far corners move from one to the next."""
    f = frames(_events(spark, sf)).withColumn("sure", F.least(F.lit(1.0), F.col("value") / 150)).withColumn("good", F.col("sure") >= 0.58)
    f = f.withColumn("prev", F.when(F.col("good"), F.lag("value").over(Window.partitionBy("video", "good").orderBy("idx"))))
    a = f.groupBy("video").agg(F.count("*").alias("n"), F.count_if("good").alias("reliable"), F.median("sure").alias("med"), F.avg("sure").alias("mean"), F.coalesce(F.avg(F.when(F.col("good"), F.abs(F.col("value") - F.col("prev")) / 1000)), F.lit(0.0)).alias("jitter"))
    rate = F.col("reliable") / F.col("n").cast("double")
    mode = F.when((rate >= 0.72) & (F.col("med") >= 0.60) & (F.col("jitter") <= 0.05), "classic").when((rate < 0.45) | (F.col("med") < 0.48) | (F.col("jitter") > 0.10), "neural").otherwise("hybrid")
    return a.select("video", "n", "reliable", round6(rate).alias("rate"), round6("med").alias("median_confidence"), round6("mean").alias("mean_confidence"), round6("jitter").alias("jitter"), mode.alias("mode"))


@query("seq_chosen_detector", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.06 THEN 'classic' WHEN l_tax > 0.02 THEN 'neural' ELSE 'classic' END AS used, CASE WHEN l_discount >= 0.06 THEN l_discount WHEN l_tax > 0.02 THEN l_tax ELSE l_discount END AS confidence FROM lineitem")
def seq_chosen_detector(spark, sf):
    """The classic result where it can be relied on, else the neural one where it found anything, else the classic one after all."""
    reliable, found = F.col("l_discount") >= 0.06, F.col("l_tax") > 0.02
    neural = ~reliable & found
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(neural, "neural").otherwise("classic").alias("used"), F.when(neural, F.col("l_tax")).otherwise(F.col("l_discount")).alias("confidence"))


_BATCHES = "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 32 AS batch FROM events"


@query("seq_batches", _BATCHES)
def seq_batches(spark, sf):
    """Frames of each video in batches of 32, in order."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _events(spark, sf).select("user_id", "event_id", F.floor((place - 1) / 32).alias("batch"))


def sampled(events: DataFrame, fps: float, wanted: float, start: float = 0.0, end: float | None = None, most: int | None = None) -> DataFrame:
    """Frames at a wanted rate, in a range of seconds, at most so many of each video; idx counts all frames of it."""
    first = max(0, round(start * fps))
    step = max(1, round(fps / wanted))
    keep = events.where((F.col("idx") >= first) & ((F.col("idx") - first) % step == 0))
    if end is not None:
        keep = keep.where(F.col("idx") < round(end * fps))
    if most is not None:
        keep = keep.withColumn("n", F.row_number().over(Window.partitionBy("video").orderBy("idx"))).where(F.col("n") <= most).drop("n")
    return keep.withColumn("time_sec", F.col("idx") / fps)


@query("src_sampler", _with(_FRAMES) + "SELECT video, idx, idx / 25.0::DOUBLE AS time_sec FROM frames WHERE idx % 5 = 0 AND value >= 8")
def src_sampler(spark, sf):
    """Five frames a second of twenty-five, without black ones."""
    return sampled(frames(_events(spark, sf)), 25.0, 5.0).where("value >= 8").select("video", "idx", "time_sec")


@query("src_range_sampler", _with(_FRAMES) + "SELECT video, idx FROM (SELECT video, idx, row_number() OVER (PARTITION BY video ORDER BY idx) AS n FROM frames WHERE idx >= 5 AND (idx - 5) % 2 = 0 AND idx < 50) WHERE n <= 12")
def src_range_sampler(spark, sf):
    """Frames of a range of seconds, twelve at most of each video."""
    return sampled(frames(_events(spark, sf)), 5.0, 2.5, start=1.0, end=10.0, most=12).select("video", "idx")


@query("src_adaptive_sampler", _with(_FRAMES) + "SELECT video, idx FROM (SELECT *, greatest(1, round_even(greatest(2.0::DOUBLE, n / 5.0::DOUBLE / 8) * 5, 0)::INT) AS step FROM (SELECT *, count(*) OVER (PARTITION BY video) AS n FROM frames)) WHERE idx % step = 0")
def src_adaptive_sampler(spark, sf):
    """Every two seconds, or seldomer where a video would give more than about eight frames."""
    f = frames(_events(spark, sf)).withColumn("n", F.count("*").over(Window.partitionBy("video")))
    step = F.greatest(F.lit(1), F.bround(F.greatest(F.lit(2.0), F.col("n") / 5.0 / 8) * 5, 0).cast("int"))
    return f.where(F.col("idx") % step == 0).select("video", "idx")


@query("src_interval_sampler", _with(_FRAMES) + "SELECT video, floor(t / 3600)::BIGINT AS slot, min(idx) AS idx FROM frames GROUP BY ALL")
def src_interval_sampler(spark, sf):
    """The first frame of every hour, for labelling."""
    return frames(_events(spark, sf)).groupBy("video", F.floor(F.col("t") / 3600).alias("slot")).agg(F.min("idx").alias("idx"))


@query("src_probe_frame", _with(_FRAMES) + "SELECT video, least(n - 1, greatest(0, round_even(CASE WHEN n / 25.0::DOUBLE < 2 THEN n / 25.0::DOUBLE * 0.5 ELSE 2.0::DOUBLE END * 25, 0)::BIGINT)) AS idx FROM (SELECT video, count(*) AS n FROM frames GROUP BY 1)")
def src_probe_frame(spark, sf):
    """The frame near a time, or the middle one of a shorter video."""
    n = frames(_events(spark, sf)).groupBy("video").agg(F.count("*").alias("n"))
    seconds = F.col("n") / 25.0
    at = F.when(seconds < 2, seconds * 0.5).otherwise(2.0)
    return n.select("video", F.least(F.col("n") - 1, F.greatest(F.lit(0), F.bround(at * 25, 0).cast("long"))).alias("idx"))


_HALF = "ends AS (SELECT video, seg, min(t) AS a, lead(min(t)) OVER (PARTITION BY video ORDER BY seg) AS nxt, max(t) AS last_t FROM islands GROUP BY video, seg), cont AS (SELECT video, seg, a, coalesce(nxt, last_t) AS b, nxt IS NULL AS closed FROM ends)"


@query("jn_half_open", _with(_FRAMES, _THRESHOLDS, _MARKED, _HALF) + "SELECT event_id, seg FROM (SELECT f.event_id, c.seg, row_number() OVER (PARTITION BY f.event_id ORDER BY CASE WHEN f.t - 30 >= c.a AND (f.t - 30 < c.b OR c.closed AND f.t - 30 <= c.b) THEN 0 ELSE 1 END, least(abs(f.t - 30 - c.a), abs(f.t - 30 - c.b)), c.seg) AS rn FROM frames f JOIN cont c USING (video)) WHERE rn = 1")
def jn_half_open(spark, sf):
    """Points half a minute before each frame, in the segment that begins at or before them; before the first one, in the nearest."""
    m = _marked(spark, sf)
    starts = m.groupBy("video", "seg").agg(F.min("t").alias("t")).select("video", "t", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event_id"), "seg")
    points = m.select("video", (F.col("t") - 30).alias("t"), F.lit(1).alias("kind"), "event_id", F.lit(None).cast("long").alias("seg"))
    w = Window.partitionBy("video").orderBy("t", "kind", "seg").rowsBetween(Window.unboundedPreceding, 0)
    # segments follow each other: one holds all that comes before the next; none comes before the first
    both = points.unionByName(starts).withColumn("at", F.coalesce(F.last("seg", True).over(w), F.lit(0).cast("long")))
    return both.where("kind = 1").select("event_id", F.col("at").alias("seg"))


@query("img_metrics")
def img_metrics(spark, sf):
    """Sharpness, edges, strokes, entropy and hash of pictures; each text's bytes, 64 a row, stand for one: no SQL for kernels, tested against plain versions."""
    pictures = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.lit(64).alias("width"), F.encode("text", "utf-8").alias("pixels"))
    m = picture_metrics(pictures, "doc_id")
    return m.withColumn("score", M.content_score(F.col("sharp"), F.col("edge"), F.col("text"), F.col("entropy")))
