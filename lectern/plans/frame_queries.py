"""Change detection, segmentation and key-frame selection over event streams.

A user's events in time order stand for the sampled frames of one video; all
windows are within a user, so nothing is ordered globally.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import maths as M
from lectern.functions.maths import round6
from lectern.operators.cut import cut
from lectern.operators.quantiles import quantiles
from lectern.plans.catalog import query, table
from lectern.streaming.online import online_segments  # noqa: F401

_FRAMES = """f0 AS (SELECT user_id AS video, event_id, event_type, ts, value, row_number() OVER w - 1 AS idx, date_diff('microsecond', first_value(ts) OVER w, ts) / 1000000.0::DOUBLE AS t,
    left(md5(event_id::VARCHAR), 16) AS phash, lag(value) OVER w AS prev, lag(left(md5(event_id::VARCHAR), 16)) OVER w AS prev_hash
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    frames AS (SELECT video, event_id, event_type, ts, value, idx, t, phash, coalesce(abs(value - prev), 0) AS d,
    coalesce(1 - least(1, abs(value - prev) / (abs(value) + abs(prev) + 1)), 1) AS ssim,
    CASE WHEN prev_hash IS NULL THEN 0 ELSE bit_count(xor(('0x' || phash)::UBIGINT, ('0x' || prev_hash)::UBIGINT)) END::BIGINT AS hash_gap FROM f0),
    scored AS (SELECT *, 0.60::DOUBLE * (1 - ssim) + 0.25::DOUBLE * (hash_gap / 64.0::DOUBLE) + 0.10::DOUBLE * least(1.0::DOUBLE, d / 100 / 0.08::DOUBLE) + 0.05::DOUBLE * least(1.0::DOUBLE, d / 200 / 0.08::DOUBLE) AS score FROM frames)"""

_THRESHOLDS = f"""med AS (SELECT video, median(1 - ssim) AS m1, median(hash_gap) AS m2, median(score) AS m3 FROM scored GROUP BY 1),
    mad AS (SELECT video, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, median(abs(1 - ssim - m1)) AS a1, median(abs(hash_gap - m2)) AS a2, median(abs(score - m3)) AS a3 FROM scored JOIN med USING (video) GROUP BY 1),
    base AS (SELECT video, least(0.60::DOUBLE, greatest(0.08::DOUBLE, m1 + 3.0::DOUBLE * 1.4826::DOUBLE * (a1 + 1e-9::DOUBLE))) AS ssim_thr,
    least(30.0::DOUBLE, greatest(6.0::DOUBLE, m2 + 2.5::DOUBLE * 1.4826::DOUBLE * (a2 + 1e-9::DOUBLE))) AS hash_thr,
    least(0.95::DOUBLE, greatest(0.18::DOUBLE, m3 + 3.0::DOUBLE * 1.4826::DOUBLE * (a3 + 1e-9::DOUBLE))) AS score_thr FROM mad),
    thr AS (SELECT *, least(0.88::DOUBLE, greatest(0.72::DOUBLE, 1 - greatest(0.18::DOUBLE, ssim_thr * 1.35::DOUBLE))) AS jump_ssim,
    greatest(least(20.0::DOUBLE, greatest(6.0::DOUBLE, hash_thr * 0.90::DOUBLE)), hash_thr * 1.10::DOUBLE) AS jump_hash,
    greatest(least(0.60::DOUBLE, greatest(0.18::DOUBLE, score_thr * 0.85::DOUBLE)), score_thr * 1.05::DOUBLE) AS jump_score FROM base)"""
_MARKED = """marked AS (SELECT s.*, CASE WHEN idx = 0 OR ssim <= jump_ssim OR hash_gap >= jump_hash OR score >= jump_score THEN 1 ELSE 0 END AS is_change FROM scored s JOIN thr USING (video)),
    islands AS (SELECT *, sum(is_change) OVER (PARTITION BY video ORDER BY idx)::BIGINT - 1 AS seg FROM marked)"""
_STEP = "step AS (SELECT video, coalesce(median(gap), 1.0::DOUBLE) AS step FROM (SELECT video, t - lag(t) OVER (PARTITION BY video ORDER BY idx) AS gap FROM frames) WHERE gap > 0 OR gap IS NULL GROUP BY 1)"
_SEGMENTS = """segments AS (SELECT video, seg, min(idx) AS first, max(idx) AS last, min(t) AS t_start, max(t) + any_value(step) AS t_end, min_by(idx, {'v': -value, 'i': idx}) AS anchor FROM islands JOIN step USING (video) GROUP BY ALL)"""
_MERGED = """renamed AS (SELECT video, seg, sum(CASE WHEN seg > 0 AND t_end - t_start >= 600 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY seg)::BIGINT AS new_seg FROM segments),
    absorbed AS (SELECT i.* EXCLUDE (seg), new_seg AS seg FROM islands i JOIN renamed r ON i.video = r.video AND i.seg = r.seg)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def frames(events: DataFrame) -> DataFrame:
    """Frames with their place, time in seconds, hash, and gaps to the frame before (none for the first)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value, prev = F.col("value"), F.lag("value").over(w)
    phash = F.left(F.md5(F.col("event_id").cast("string")), F.lit(16))
    first = F.first("ts").over(w)
    f = events.select(
        F.col("user_id").alias("video"), "event_id", "event_type", "ts", "value",
        (F.row_number().over(w) - 1).cast("long").alias("idx"),
        (F.timestamp_diff("MICROSECOND", first, F.col("ts")) / 1000000.0).alias("t"),
        phash.alias("phash"), prev.alias("prev"), F.lag(phash).over(w).alias("prev_hash"),
    )
    gap = F.abs(value - F.col("prev"))
    return f.select(
        "video", "event_id", "event_type", "ts", "value", "idx", "t", "phash",
        F.coalesce(gap, F.lit(0.0)).alias("d"),
        F.coalesce(1 - F.least(F.lit(1.0), gap / (F.abs(value) + F.abs("prev") + 1)), F.lit(1.0)).alias("ssim"),
        F.coalesce(M.hamming64(F.col("phash"), F.col("prev_hash")), F.lit(0)).cast("long").alias("hash_gap"),
    )


def scored(events: DataFrame, use_phash: bool = True) -> DataFrame:
    f = frames(events)
    return f.withColumn("score", M.change_score(1 - F.col("ssim"), F.col("hash_gap"), F.col("d") / 100, F.col("d") / 200, use_phash))


def medians(rows: DataFrame, by: list[str], values: dict[str, Column], in_passes: bool) -> DataFrame:
    """Exact medians by group: in one aggregation, which holds a group's distinct values in one task, or in passes that never do."""
    if not in_passes:
        return rows.groupBy(*by).agg(*[F.median(c).alias(name) for name, c in values.items()])
    return quantiles(rows, by, values).select(*by, *[F.get(name, F.lit(0)).alias(name) for name in values])


def thresholds(rows: DataFrame, by: list[str], in_passes: bool = False) -> DataFrame:
    """Robust thresholds of each group (median and median absolute deviation), and the jumps that count as changes.

    in_passes: for few groups, or ones that hold most rows.
    """
    x = rows.select(*by, (1 - F.col("ssim")).alias("drop"), F.col("hash_gap").cast("double").alias("hash_gap"), "score")
    k = {"drop": 3.0, "hash_gap": 2.5, "score": 3.0}
    med = medians(x, by, {f"m_{c}": F.col(c) for c in k}, in_passes)
    mad = med.join(medians(x.join(med, by), by, {f"a_{c}": F.abs(F.col(c) - F.col(f"m_{c}")) for c in k}, in_passes), by)
    at = {c: F.col(f"m_{c}") + v * 1.4826 * (F.col(f"a_{c}") + 1e-9) for c, v in k.items()}
    base = mad.select(
        *by,
        M.clamp(at["drop"], 0.08, 0.60).alias("ssim_thr"),
        M.clamp(at["hash_gap"], 6.0, 30.0).alias("hash_thr"),
        M.clamp(at["score"], 0.18, 0.95).alias("score_thr"),
    )
    s, h, c = F.col("ssim_thr"), F.col("hash_thr"), F.col("score_thr")
    return base.select(
        "*",
        M.clamp(1 - F.greatest(F.lit(0.18), s * 1.35), 0.72, 0.88).alias("jump_ssim"),
        F.greatest(M.clamp(h * 0.90, 6.0, 20.0), h * 1.10).alias("jump_hash"),
        F.greatest(M.clamp(c * 0.85, 0.18, 0.60), c * 1.05).alias("jump_score"),
    )


def islands(rows: DataFrame, thr: DataFrame, by: list[str], use_phash: bool = True) -> DataFrame:
    """Change flags and running segment numbers."""
    change = (F.col("idx") == 0) | (F.col("ssim") <= F.col("jump_ssim")) | (F.lit(use_phash) & (F.col("hash_gap") >= F.col("jump_hash"))) | (F.col("score") >= F.col("jump_score"))
    w = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.join(thr, by).withColumn("is_change", change.cast("int")).drop("ssim_thr", "hash_thr", "score_thr", "jump_ssim", "jump_hash", "jump_score")
    return marked.withColumn("seg", F.sum("is_change").over(w) - 1)


def sample_step(rows: DataFrame) -> DataFrame:
    """Median of the positive gaps between frames; a second without any."""
    gaps = rows.select("video", (F.col("t") - F.lag("t").over(Window.partitionBy("video").orderBy("idx"))).alias("gap"))
    return gaps.groupBy("video").agg(F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(1.0)).alias("step"))


def segments(marked: DataFrame, step: DataFrame) -> DataFrame:
    best = F.min_by("idx", F.struct((-F.col("value")).alias("v"), F.col("idx").alias("i")))
    return (
        marked.groupBy("video", "seg")
        .agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), best.alias("anchor"))
        .join(step, "video")
        .withColumn("t_end", F.col("t_end") + F.col("step"))
        .drop("step")
    )


def absorb(marked: DataFrame, segs: DataFrame, least: float) -> DataFrame:
    """Segments shorter than `least` seconds join the one before; the first one stays."""
    long = (F.col("seg") > 0) & (F.col("t_end") - F.col("t_start") >= least)
    renamed = segs.select("video", "seg", F.sum(long.cast("int")).over(Window.partitionBy("video").orderBy("seg")).alias("new_seg"))
    return marked.join(renamed, ["video", "seg"]).drop("seg").withColumnRenamed("new_seg", "seg")


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events")


def _marked(spark, sf) -> DataFrame:
    rows = scored(_events(spark, sf))
    return islands(rows, thresholds(rows, ["video"]), ["video"])


@query("win_lag_deltas", _with(_FRAMES) + "SELECT event_id, idx, floor(t * 1000000 + 0.5) / 1000000 AS t, floor(d * 1000000 + 0.5) / 1000000 AS d, floor(ssim * 1000000 + 0.5) / 1000000 AS ssim, hash_gap, floor(score * 1000000 + 0.5) / 1000000 AS score FROM scored")
def win_lag_deltas(spark, sf):
    r = lambda c: round6(c).alias(c)
    return scored(_events(spark, sf)).select("event_id", "idx", r("t"), r("d"), r("ssim"), "hash_gap", r("score"))


@query("agg_thresholds", _with(_FRAMES, _THRESHOLDS) + "SELECT video, " + ", ".join(f"floor({c} * 1000000 + 0.5) / 1000000 AS {c}" for c in ("ssim_thr", "hash_thr", "score_thr", "jump_ssim", "jump_hash", "jump_score")) + " FROM thr")
def agg_thresholds(spark, sf):
    t = thresholds(scored(_events(spark, sf)), ["video"])
    return t.select("video", *[round6(c).alias(c) for c in t.columns if c != "video"])


_KINDS = _THRESHOLDS.replace("video", "event_type")


@query("agg_skewed_thresholds", _with(_FRAMES, _KINDS) + "SELECT event_type, " + ", ".join(f"floor({c} * 1000000 + 0.5) / 1000000 AS {c}" for c in ("ssim_thr", "hash_thr", "score_thr", "jump_ssim", "jump_hash", "jump_score")) + " FROM thr")
def agg_skewed_thresholds(spark, sf):
    """Thresholds of a handful of groups, each of which may hold most frames: medians by selection in passes."""
    t = thresholds(cut(scored(_events(spark, sf)).select("event_type", "ssim", "hash_gap", "score")), ["event_type"], in_passes=True)
    return t.select("event_type", *[round6(c).alias(c) for c in t.columns if c != "event_type"])


@query("agg_sample_step", _with(_FRAMES, _STEP) + "SELECT video, floor(step * 1000000 + 0.5) / 1000000 AS step FROM step")
def agg_sample_step(spark, sf):
    return sample_step(frames(_events(spark, sf))).select("video", round6("step").alias("step"))


@query("win_gaps_islands", _with(_FRAMES, _THRESHOLDS, _MARKED) + "SELECT event_id, is_change, seg FROM islands")
def win_gaps_islands(spark, sf):
    return _marked(spark, sf).select("event_id", "is_change", "seg")


@query("win_segment_envelope", _with(_FRAMES, _THRESHOLDS, _MARKED, _STEP, _SEGMENTS) + "SELECT video, seg, first, last, floor(t_start * 1000000 + 0.5) / 1000000 AS t_start, floor(t_end * 1000000 + 0.5) / 1000000 AS t_end, anchor FROM segments")
def win_segment_envelope(spark, sf):
    m = _marked(spark, sf)
    return segments(m, sample_step(m)).select("video", "seg", "first", "last", round6("t_start").alias("t_start"), round6("t_end").alias("t_end"), "anchor")


@query("win_absorb_short", _with(_FRAMES, _THRESHOLDS, _MARKED, _STEP, _SEGMENTS, _MERGED) + "SELECT event_id, seg FROM absorbed")
def win_absorb_short(spark, sf):
    m = _marked(spark, sf)
    return absorb(m, segments(m, sample_step(m)), 600).select("event_id", "seg")


_GUARD = """guarded AS (SELECT a.*, t_lo, t_hi, t >= t_lo + 60 AND t <= t_hi - 60 AS inner_row FROM absorbed a JOIN (SELECT video, seg, min(t) AS t_lo, max(t) AS t_hi FROM absorbed GROUP BY ALL) USING (video, seg)),
    kept AS (SELECT *, row_number() OVER (PARTITION BY video, seg ORDER BY value DESC, score DESC, idx) AS rn FROM (SELECT *, bool_or(inner_row) OVER (PARTITION BY video, seg) AS any_inner FROM guarded) WHERE t_hi - t_lo >= 1 AND (inner_row OR NOT any_inner)),
    best AS (SELECT * FROM kept WHERE rn = 1)"""


def best_rows(rows: DataFrame, by: list[str], guard: float, least: float) -> DataFrame:
    """The best row of each long enough segment, off its edges where rows are left there."""
    w = Window.partitionBy(*by, "seg")
    edges = rows.withColumn("t_lo", F.min("t").over(w)).withColumn("t_hi", F.max("t").over(w))
    inner = (F.col("t") >= F.col("t_lo") + guard) & (F.col("t") <= F.col("t_hi") - guard)
    marked = edges.withColumn("inner", inner).withColumn("any_inner", F.max("inner").over(w))
    fit = marked.where((F.col("t_hi") - F.col("t_lo") >= least) & (F.col("inner") | ~F.col("any_inner")))
    return fit.withColumn("rn", F.row_number().over(w.orderBy(F.desc("value"), F.desc("score"), "idx"))).where("rn = 1").drop("rn", "inner", "any_inner")


def _absorbed(spark, sf) -> DataFrame:
    m = _marked(spark, sf)
    return absorb(m, segments(m, sample_step(m)), 600)


@query("win_best_row", _with(_FRAMES, _THRESHOLDS, _MARKED, _STEP, _SEGMENTS, _MERGED, _GUARD) + "SELECT video, seg, event_id, idx FROM best")
def win_best_row(spark, sf):
    return best_rows(_absorbed(spark, sf), ["video"], 60, 1).select("video", "seg", "event_id", "idx")


def greedy_dedup(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """In order of segments, a row stays if its hash differs from every kept one in more than `most` bits.

    Groups come sorted and stream through a task; its state is the hashes kept of one group, held against each row at once.
    """

    def kept(batches):
        group, hashes, n = None, np.zeros(64, np.uint64), 0
        for batch in batches:
            stays = []
            for row, (*own, phash) in enumerate(zip(*(c.to_pylist() for c in batch.select([*by, "phash"]).columns))):
                if own != group:
                    group, n = own, 0
                h = np.uint64(int(phash, 16))
                if n and (np.bitwise_count(hashes[:n] ^ h) <= most).any():
                    continue
                if n == len(hashes):
                    hashes = np.concatenate([hashes, np.zeros(n, np.uint64)])
                hashes[n] = h
                n += 1
                stays.append(row)
            yield batch.take(pa.array(stays, pa.int64()))

    ordered = rows.select(*by, "seg", "event_id", "phash").repartition(*by).sortWithinPartitions(*by, "seg", "event_id")
    return ordered.mapInArrow(kept, ordered.schema)


_DEDUP = """numbered AS (SELECT video, seg, event_id, ('0x' || phash)::UBIGINT AS h, row_number() OVER (PARTITION BY video ORDER BY seg) AS n FROM best),
    walk AS (SELECT video, n, seg, event_id, TRUE AS keep, [h] AS kept FROM numbered WHERE n = 1
    UNION ALL SELECT b.video, b.n, b.seg, b.event_id, len(list_filter(w.kept, lambda k: bit_count(xor(k, b.h)) <= 22)) = 0, CASE WHEN len(list_filter(w.kept, lambda k: bit_count(xor(k, b.h)) <= 22)) = 0 THEN list_append(w.kept, b.h) ELSE w.kept END
    FROM walk w JOIN numbered b ON b.video = w.video AND b.n = w.n + 1)"""


@query("seq_keyframes", _with(_FRAMES, _THRESHOLDS, _MARKED, _STEP, _SEGMENTS, _MERGED, _GUARD, _DEDUP).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT video, seg, event_id FROM walk WHERE keep")
def seq_keyframes(spark, sf):
    """Flagship: thresholds, islands, absorption, best rows, greedy near-duplicate removal (hashes within 22 bits, as random ones are far apart)."""
    return greedy_dedup(best_rows(_absorbed(spark, sf), ["video"], 60, 1), ["video"], 22).select("video", "seg", "event_id")


@query(
    "win_longest_run",
    _with(_FRAMES)
    + """SELECT video, first, n FROM (SELECT video, first, n, row_number() OVER (PARTITION BY video ORDER BY n DESC, first) AS rn FROM (SELECT video, min(idx) AS first, count(*) AS n FROM
    (SELECT video, idx, value > 50 AS up, idx - row_number() OVER (PARTITION BY video, value > 50 ORDER BY idx) AS g FROM frames) WHERE up GROUP BY video, g)) WHERE rn = 1""",
)
def win_longest_run(spark, sf):
    f = frames(_events(spark, sf)).select("video", "idx", (F.col("value") > 50).alias("up"))
    g = f.withColumn("g", F.col("idx") - F.row_number().over(Window.partitionBy("video", "up").orderBy("idx"))).where("up")
    runs = g.groupBy("video", "g").agg(F.min("idx").alias("first"), F.count("*").alias("n"))
    return runs.withColumn("rn", F.row_number().over(Window.partitionBy("video").orderBy(F.desc("n"), "first"))).where("rn = 1").select("video", "first", "n")


@query("win_label_change", "SELECT conv_id, turn FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt <> role")
def win_label_change(spark, sf):
    c = table(spark, sf, "conversations")
    return c.withColumn("nxt", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt <> role").select("conv_id", "turn")


@query("win_equal_chunks", "SELECT conv_id, turn, (rn - 1) // ceil(n / 3.0)::BIGINT AS chunk FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def win_equal_chunks(spark, sf):
    w = Window.partitionBy("conv_id")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("rn"), F.count("*").over(w).alias("n"))
    return c.select("conv_id", "turn", F.floor((F.col("rn") - 1) / F.ceil(F.col("n") / 3.0)).alias("chunk"))


@query(
    "win_containment_chain",
    _with(_FRAMES)
    + """SELECT video, idx FROM (SELECT video, idx, lead(chained) OVER (PARTITION BY video ORDER BY idx) AS nxt FROM (SELECT video, idx, coalesce(value >= lag(value) OVER w AND t - lag(t) OVER w <= 7200, FALSE) AS chained FROM frames WINDOW w AS (PARTITION BY video ORDER BY idx))) WHERE NOT coalesce(nxt, FALSE)""",
)
def win_containment_chain(spark, sf):
    """Of each chain of rows that each hold the one before, within two hours, the last stays."""
    w = Window.partitionBy("video").orderBy("idx")
    f = frames(_events(spark, sf)).withColumn("chained", F.coalesce((F.col("value") >= F.lag("value").over(w)) & (F.col("t") - F.lag("t").over(w) <= 7200), F.lit(False)))
    return f.withColumn("nxt", F.coalesce(F.lead("chained").over(w), F.lit(False))).where("NOT nxt").select("video", "idx")


def smooth(rows: DataFrame, keep: float = 0.75) -> DataFrame:
    """Exponential smoothing along each video's rows (video, idx, value): they stream in order, and the last smoothed value is all a task remembers."""

    def run(batches):
        video, last = None, None
        for batch in batches:
            out = []
            for v, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if v != video:
                    video, last = v, None
                last = x if last is None or x is None else keep * last + (1 - keep) * x
                out.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["video", "idx", "s"])

    ordered = rows.select("video", "idx", F.col("value").cast("double").alias("value")).repartition("video").sortWithinPartitions("video", "idx")
    return ordered.mapInArrow(run, ordered.withColumnRenamed("value", "s").schema)


@query("win_smooth", _with(_FRAMES).replace("WITH ", "WITH RECURSIVE ") + ", r AS (SELECT video, idx, value AS s FROM frames WHERE idx = 0 UNION ALL SELECT f.video, f.idx, 0.75::DOUBLE * r.s + 0.25::DOUBLE * f.value FROM r JOIN frames f ON f.video = r.video AND f.idx = r.idx + 1) SELECT video, idx, floor(s * 1000000 + 0.5) / 1000000 AS s FROM r")
def win_smooth(spark, sf):
    return smooth(frames(_events(spark, sf))).select("video", "idx", round6("s").alias("s"))


_VARIANTS = (("baseline", 600.0, True), ("no_hash", 600.0, False), ("short_120", 120.0, True), ("long_3600", 3600.0, True))


@query(
    "seq_ablation",
    _with(_FRAMES.replace("scored AS", "scored_h AS"), "variants AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s}::DOUBLE, {str(h).upper()})" for n, s, h in _VARIANTS) + ") v(variant, least_s, use_hash))",
          "scored AS (SELECT variant || '/' || video AS video, variant, least_s, use_hash, event_id, value, idx, t, ssim, CASE WHEN use_hash THEN hash_gap ELSE 0 END AS hash_gap, CASE WHEN use_hash THEN score ELSE 0.75::DOUBLE * (1 - ssim) + 0.15::DOUBLE * least(1.0::DOUBLE, d / 100 / 0.08::DOUBLE) + 0.10::DOUBLE * least(1.0::DOUBLE, d / 200 / 0.08::DOUBLE) END AS score FROM scored_h, variants)",
          _THRESHOLDS, _MARKED.replace("OR hash_gap >=", "OR use_hash AND hash_gap >="), _STEP.replace("FROM frames", "FROM scored"), _SEGMENTS,
          "renamed AS (SELECT video, seg, sum(CASE WHEN seg > 0 AND t_end - t_start >= least_s THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY seg) AS new_seg FROM segments JOIN (SELECT DISTINCT video, least_s FROM scored) USING (video))",
          "counts AS (SELECT split_part(video, '/', 1) AS variant, count(*) AS n_visual, count(DISTINCT (video, new_seg)) AS n_segments FROM renamed GROUP BY 1)")
    + "SELECT variant, n_visual, n_segments, n_segments - (SELECT n_segments FROM counts WHERE variant = 'baseline') AS delta FROM counts",
)
def seq_ablation(spark, sf):
    """All variants in one job: frames once, thresholds and islands by variant and video, and the difference to the baseline."""
    f = frames(_events(spark, sf))
    variants = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(s).alias("least_s"), F.lit(h).alias("use_hash")) for n, s, h in _VARIANTS]))
    g = f.select("*", variants.alias("v")).select("*", "v.*").drop("v")
    drop, text, edge = 1 - F.col("ssim"), F.col("d") / 100, F.col("d") / 200
    rows = g.withColumn("score", F.when(F.col("use_hash"), M.change_score(drop, F.col("hash_gap"), text, edge)).otherwise(M.change_score(drop, F.lit(0), text, edge, False)))
    rows = rows.withColumn("hash_gap", F.when(F.col("use_hash"), F.col("hash_gap")).otherwise(F.lit(0)))
    by = ["variant", "video"]
    # without hashes the gap is 0, which never reaches its threshold of 6 or more
    marked = islands(rows, thresholds(rows, by), by)
    segs = marked.groupBy("variant", "least_s", "video", "seg").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end")).join(sample_step(f), "video")
    long = (F.col("seg") > 0) & (F.col("t_end") + F.col("step") - F.col("t_start") >= F.col("least_s"))
    renamed = segs.select("variant", "video", F.sum(long.cast("int")).over(Window.partitionBy("variant", "video").orderBy("seg")).alias("new_seg"))
    per = renamed.groupBy("variant", "video").agg(F.count("*").alias("a"), (F.max("new_seg") + 1).alias("b"))
    counts = per.groupBy("variant").agg(F.sum("a").alias("n_visual"), F.sum("b").alias("n_segments"))
    base = counts.where("variant = 'baseline'").select(F.col("n_segments").alias("base"))
    return counts.crossJoin(F.broadcast(base)).select("variant", "n_visual", "n_segments", (F.col("n_segments") - F.col("base")).alias("delta"))


@query("mth_hamming", "SELECT event_id, bit_count(xor(('0x' || left(md5(event_id::VARCHAR), 16))::UBIGINT, ('0x' || left(md5(user_id::VARCHAR), 16))::UBIGINT))::BIGINT AS bits FROM events")
def mth_hamming(spark, sf):
    h = lambda c: F.left(F.md5(F.col(c).cast("string")), F.lit(16))
    return _events(spark, sf).select("event_id", M.hamming64(h("event_id"), h("user_id")).cast("long").alias("bits"))

