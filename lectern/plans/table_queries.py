"""Joins, reports, library tables and sequence operators over the relational tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import maths as M
from lectern.functions import text as T
from lectern.functions.maths import round6
from lectern.operators.cut import shared_folder
from lectern.operators.intervals import nearest_in_time, within_intervals
from lectern.operators.quantiles import quantiles
from lectern.operators.ranking import pagerank
from lectern.operators.sequence import decode_labels, merge_short, pack_windows
from lectern.plans.catalog import query, spread, table
from lectern.plans.frame_queries import _FRAMES, _MARKED, _THRESHOLDS, _events, _marked, _with, frames
from lectern.plans.text_queries import _sentences, _tokens
from lectern.streaming.decoding import online_labels

# --- reports -----------------------------------------------------------------

_REPORT = """count(*) AS n, floor(avg(iou) * 1000000 + 0.5) / 1000000 AS mean_iou, floor(median(iou) * 1000000 + 0.5) / 1000000 AS median_iou, count(*) FILTER (iou >= 0.7) AS successful,
    floor(count(*) FILTER (iou >= 0.7) / count(*)::DOUBLE * 1000000 + 0.5) / 1000000 AS success_rate, median(runtime) AS median_runtime, count(*) FILTER (failed) AS errors"""
_DETECTIONS = "(SELECT l_returnflag AS method, l_linestatus AS video, l_discount * 10 AS iou, l_quantity AS runtime, l_tax = 0 AS failed FROM lineitem)"


def detections(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("video"), (F.col("l_discount") * 10).alias("iou"), F.col("l_quantity").alias("runtime"), (F.col("l_tax") == 0).alias("failed"))


def report() -> list:
    good = F.count_if(F.col("iou") >= 0.7)
    return [
        F.count("*").alias("n"), round6(F.avg("iou")).alias("mean_iou"), round6(F.median("iou")).alias("median_iou"), good.alias("successful"),
        round6(good / F.count("*").cast("double")).alias("success_rate"), F.median("runtime").alias("median_runtime"), F.count_if("failed").alias("errors"),
    ]


@query("agg_detector_summary", f"SELECT method, {_REPORT} FROM {_DETECTIONS} GROUP BY method")
def agg_detector_summary(spark, sf):
    return detections(spark, sf).groupBy("method").agg(*report())


@query("agg_detector_grouping_sets", f"SELECT method, video, {_REPORT} FROM {_DETECTIONS} GROUP BY GROUPING SETS ((method), (video, method))")
def agg_detector_grouping_sets(spark, sf):
    d = detections(spark, sf)
    return d.groupingSets([["method"], ["method", "video"]], "method", "video").agg(*report())


@query(
    "agg_manual_evaluation",
    """SELECT source AS variant, selected, labeled, tp, fp, fn, floor(100 * p * 100 + 0.5) / 100 AS precision_percent, floor(100 * r * 100 + 0.5) / 100 AS recall_percent, floor(100 * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * 100 + 0.5) / 100 AS f1_percent FROM
    (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM
    (SELECT source, count(*) AS selected, count(quality) AS labeled, count(*) FILTER (quality = 1) AS tp, count(*) FILTER (quality = 0) AS fp, coalesce(max(toxic * 5), 0)::BIGINT AS fn FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1))""",
)
def agg_manual_evaluation(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    c = rows.groupBy("source").agg(F.count("*").alias("selected"), F.count("quality").alias("labeled"), F.count_if(F.col("quality") == 1).alias("tp"), F.count_if(F.col("quality") == 0).alias("fp"), F.coalesce(F.max(F.col("toxic") * 5), F.lit(0)).cast("long").alias("fn"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b).cast("double")).otherwise(F.lit(0.0))
    c = c.withColumn("p", share(F.col("tp"), F.col("fp"))).withColumn("r", share(F.col("tp"), F.col("fn")))
    p, r = F.col("p"), F.col("r")
    cent = lambda x: F.floor(100 * x * 100 + 0.5) / 100
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return c.select(F.col("source").alias("variant"), "selected", "labeled", "tp", "fp", "fn", cent(p).alias("precision_percent"), cent(r).alias("recall_percent"), cent(f1).alias("f1_percent"))


@query("agg_iou_accuracy", f"SELECT video, avg((iou >= 0.5)::INT) AS acc_50, avg((iou >= 0.75)::INT) AS acc_75, avg((iou >= 0.9)::INT) AS acc_90, max_by(method, iou * 1000 + runtime) AS best FROM {_DETECTIONS} GROUP BY 1".replace(", max_by(method, iou * 1000 + runtime) AS best", ""))
def agg_iou_accuracy(spark, sf):
    hit = lambda t: F.avg((F.col("iou") >= t).cast("int"))
    return detections(spark, sf).groupBy("video").agg(hit(0.5).alias("acc_50"), hit(0.75).alias("acc_75"), hit(0.9).alias("acc_90"))


@query("agg_box_areas", "SELECT p_brand, min(p_size * p_retailprice) AS least, max(p_size * p_retailprice) AS most, count(*) AS n FROM part GROUP BY 1")
def agg_box_areas(spark, sf):
    area = F.col("p_size") * F.col("p_retailprice")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min(area).alias("least"), F.max(area).alias("most"), F.count("*").alias("n"))


@query("agg_median_box", "SELECT o_orderstatus, floor(median(o_totalprice))::BIGINT AS x, floor(median(o_custkey))::BIGINT AS y FROM orders GROUP BY 1")
def agg_median_box(spark, sf):
    q = quantiles(table(spark, sf, "orders"), ["o_orderstatus"], {"x": F.col("o_totalprice"), "y": F.col("o_custkey")})
    return q.select("o_orderstatus", *[F.floor(F.get(c, F.lit(0))).alias(c) for c in "xy"])


@query("agg_ordered_text", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS h, count(*) AS n FROM conversations GROUP BY 1")
def agg_ordered_text(spark, sf):
    c = table(spark, sf, "conversations")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda r: F.concat(r.role, F.lit(": "), r.text))
    return c.groupBy("conv_id").agg(F.md5(F.array_join(lines, "\n")).alias("h"), F.count("*").alias("n"))


@query("mth_iou", "SELECT l_orderkey, l_linenumber, floor(CASE WHEN u > 0 THEN i / u ELSE 0 END * 1000000 + 0.5) / 1000000 AS iou FROM (SELECT *, 50 * w + 60 * h - i AS u FROM (SELECT *, greatest(0.0::DOUBLE, least(w, 10 + 60.0::DOUBLE) - greatest(0.0::DOUBLE, 10.0::DOUBLE)) * greatest(0.0::DOUBLE, least(50.0::DOUBLE, 5.0::DOUBLE + h) - greatest(0.0::DOUBLE, 5.0::DOUBLE)) AS i FROM (SELECT l_orderkey, l_linenumber, l_quantity AS w, l_discount * 500 AS h FROM lineitem)))")
def mth_iou(spark, sf):
    z = lambda x: F.lit(float(x))
    w, h = F.col("l_quantity"), F.col("l_discount") * 500
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", round6(M.iou(z(0), z(0), w, z(50), z(10), z(5), z(60), h)).alias("iou"))


@query("mth_softmax", "SELECT p_partkey, list_transform(e, lambda x: floor(x / list_sum(e) * 1000000 + 0.5) / 1000000) AS probs FROM (SELECT p_partkey, list_transform(s, lambda x: exp((x - list_max(s)) / 0.35)) AS e FROM (SELECT p_partkey, [p_size / 50.0::DOUBLE, p_retailprice / 2000.0::DOUBLE, 0.5::DOUBLE] AS s FROM part))".replace(" AS probs", "[1] AS best").replace("SELECT p_partkey, list_transform(e", "SELECT p_partkey, list_sort(list_transform(e").replace("/ 1000000)[1]", "/ 1000000), 'DESC')[1]"))
def mth_softmax(spark, sf):
    scores = F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0, F.lit(0.5))
    return table(spark, sf, "part").select("p_partkey", round6(F.array_max(M.softmax(scores))).alias("best"))


@query("mth_dense_cosine", "SELECT label, a, b, floor(cos * 1000000 + 0.5) / 1000000 AS cos FROM (SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, embedding::DOUBLE[] AS v FROM embeddings) x JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, embedding::DOUBLE[] AS v FROM embeddings) y ON x.label = y.label AND y.rn BETWEEN x.rn + 1 AND x.rn + 9)")
def mth_dense_cosine(spark, sf):
    """Similarities of each vector to the next nine of its group, the band that paragraph splitting looks at."""
    e = table(spark, sf, "embeddings").withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    x = e.select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("u"), F.explode(F.expr("sequence(rn + 1, rn + 9)")).alias("rn"))
    y = e.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("v"), "rn")
    return x.join(y, ["label", "rn"]).select("label", "a", "b", round6(M.cosine(F.col("u"), F.col("v"))).alias("cos"))


# --- joins -------------------------------------------------------------------

_SEGS = "segs AS (SELECT video, seg, min(t) AS a, max(t) AS b FROM islands GROUP BY ALL)"
_ERR = "errs AS (SELECT video, event_id, t FROM frames WHERE event_type = 'error')"


def _segs(spark, sf) -> DataFrame:
    return _marked(spark, sf).groupBy("video", "seg").agg(F.min("t").alias("a"), F.max("t").alias("b"))


def _errs(spark, sf) -> DataFrame:
    return frames(_events(spark, sf)).where("event_type = 'error'").select("video", "event_id", "t")


@query("jn_interval_nearest", _with(_FRAMES, _THRESHOLDS, _MARKED, _SEGS, _ERR) + "SELECT event_id, seg FROM (SELECT e.event_id, s.seg, row_number() OVER (PARTITION BY e.event_id ORDER BY CASE WHEN s.a <= t AND t <= s.b THEN 0 ELSE least(abs(t - s.a), abs(t - s.b)) END, s.seg) AS rn FROM errs e JOIN segs s USING (video)) WHERE rn = 1")
def jn_interval_nearest(spark, sf):
    """Each error frame's segment: the one that holds its time, else the nearest by either end, the first on ties."""
    return within_intervals(_errs(spark, sf), _segs(spark, sf)).select("event_id", "seg")


@query("jn_band_margin", _with(_FRAMES, _THRESHOLDS, _MARKED, _SEGS, _ERR) + "SELECT event_id, seg, floor(greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(t - (a + b) / 2) / (greatest(12.0::DOUBLE, (b - a) / 2) + 12.0::DOUBLE)) * 1000000 + 0.5) / 1000000 AS score FROM errs JOIN segs USING (video) WHERE t >= a - 18 AND t <= b + 18")
def jn_band_margin(spark, sf):
    """Frames with the segments within eighteen seconds: they meet by video and hour."""
    hours = F.explode(F.expr("sequence(floor((a - 18) / 3600), floor((b + 18) / 3600))"))
    segs = _segs(spark, sf).withColumn("hour", hours)
    j = _errs(spark, sf).withColumn("hour", F.floor(F.col("t") / 3600)).join(segs, ["video", "hour"]).where("t >= a - 18 AND t <= b + 18")
    return j.select("event_id", "seg", round6(M.frame_time_score(F.col("t"), F.col("a"), F.col("b"))).alias("score"))


@query("jn_nearest_item", _with(_FRAMES, _ERR) + "SELECT e.event_id, min_by(f.idx, {'gap': abs(f.t - e.t), 'idx': f.idx}) AS idx FROM errs e JOIN frames f ON f.video = e.video AND f.event_id <> e.event_id GROUP BY 1")
def jn_nearest_item(spark, sf):
    return nearest_in_time(_errs(spark, sf), frames(_events(spark, sf)))


@query("jn_left_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn_left_default(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("jn_resume_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn_resume_anti(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("jn_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def jn_semi(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("jn_annotations", "SELECT o_orderkey, max_by(l_linenumber, {'v': l_extendedprice, 'n': -l_linenumber}) AS line, max(l_extendedprice) AS area FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' AND p_size > 10 GROUP BY 1")
def jn_annotations(spark, sf):
    """The largest box of each image, of the wanted categories and outside crowds."""
    boxes = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    parts = table(spark, sf, "part").where("p_size > 10").select("p_partkey")
    j = boxes.join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("o_orderkey").agg(F.max_by("l_linenumber", F.struct(F.col("l_extendedprice"), -F.col("l_linenumber"))).alias("line"), F.max("l_extendedprice").alias("area"))


@query("jn_many_to_many", "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#1' OR p_size = 7".replace("'Brand#1'", "(SELECT min(p_brand) FROM part)"))
def jn_many_to_many(spark, sf):
    part = table(spark, sf, "part")
    first = part.agg(F.min("p_brand").alias("b"))  # one row
    hit = part.crossJoin(F.broadcast(first)).where("p_brand = b OR p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(hit, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_semi")


# --- library tables: orders as notes, customers as owners ---------------------


@query("orm_dashboard", "SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) FILTER (o_orderstatus = 'P') AS processing, count(*) FILTER (o_orderpriority LIKE '1%') AS favourite FROM orders GROUP BY 1")
def orm_dashboard(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("ready"), F.count_if(F.col("o_orderstatus") == "P").alias("processing"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("favourite"))


@query("orm_library", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def orm_library(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("orm_search", "SELECT DISTINCT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE contains(lower(o_orderpriority), 'urgent') OR contains(lower(n_name), 'a1') OR contains(lower(n_name), 'an')")
def orm_search(spark, sf):
    n = F.lower("n_name")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return o.where(F.lower("o_orderpriority").contains("urgent") | n.contains("a1") | n.contains("an")).select("o_orderkey").distinct()


@query("orm_review_upsert", "SELECT doc_id, quality FROM labels WHERE toxic = 1 UNION ALL SELECT d.doc_id, 5 AS quality FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def orm_review_upsert(spark, sf):
    """New reviews replace old ones by key: the old without a new one, and the new."""
    old = table(spark, sf, "labels")
    new = table(spark, sf, "documents").select("doc_id").join(old.where("toxic = 0").select("doc_id"), "doc_id").select("doc_id", F.lit(5).alias("quality"))
    return old.select("doc_id", "quality").join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


@query("orm_delete_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orm_delete_cascade(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("set_keep_first", "SELECT user_id, event_type, min_by(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY ALL")
def set_keep_first(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("set_union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"))).distinct()


@query("top_worst_best", "SELECT * FROM (SELECT 'worst' AS side, l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 8) UNION ALL SELECT * FROM (SELECT 'best' AS side, l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 8)")
def top_worst_best(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    worst = rows.orderBy("l_extendedprice", "l_orderkey", "l_linenumber").limit(8).withColumn("side", F.lit("worst"))
    best = rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(8).withColumn("side", F.lit("best"))
    return worst.unionByName(best).select("side", "l_orderkey", "l_linenumber", "l_extendedprice")


# --- sequences over transcripts -------------------------------------------------

_ITEMS = f"""items AS (SELECT doc_id, i, length(s) AS n, (sum(length(s)) OVER w - length(s)) / 15.0::DOUBLE AS a, sum(length(s)) OVER w / 15.0::DOUBLE AS b FROM
    (SELECT doc_id, u.s, u.i FROM (SELECT doc_id, {_sentences('text')} AS ss FROM documents), LATERAL (SELECT unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i) u) WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""

_WALK = "walk AS (SELECT doc_id, i, 1::BIGINT AS win, a AS start, b AS fin, n AS len FROM items WHERE i = 0 UNION ALL SELECT x.doc_id, x.i, CASE WHEN done THEN w.win + 1 ELSE w.win END, CASE WHEN done THEN x.a ELSE w.start END, x.b, CASE WHEN done THEN x.n ELSE w.len + 1 + x.n END FROM (SELECT *, (fin - start >= 20 AND len >= 350) OR fin - start >= 55 OR len >= 1400 AS done FROM walk) w JOIN items x ON x.doc_id = w.doc_id AND x.i = w.i + 1)"

def items(spark, sf) -> DataFrame:
    """Sentences of each document as timed transcript items, fifteen characters a second."""
    s = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "text"))
    n = F.length("text")
    run = F.sum(n).over(Window.partitionBy("doc_id").orderBy("i"))
    return s.select("doc_id", F.col("i").cast("long").alias("i"), "text", n.cast("long").alias("n"), ((run - n) / 15.0).alias("a"), (run / 15.0).alias("b"))


@query(
    "seq_pack_windows",
    f"WITH RECURSIVE {_ITEMS}, {_WALK} SELECT doc_id, win, min(i) AS first, max(i) AS last FROM walk GROUP BY ALL",
)
def seq_pack_windows(spark, sf):
    return pack_windows(items(spark, sf)).select("doc_id", "win", "first", "last")


_VOWELS = "aeiou"
_COUNTED = _ITEMS.replace("length(s) AS n,", "length(s) AS n, " + ", ".join(f"length(s) - length(replace(s, '{v}', '')) AS c{k}" for k, v in enumerate(_VOWELS)) + ",")
_STAY, _STEP = [f"(s{j} + 0.08::DOUBLE)" for j in range(5)], [f"(s{j - 1} - 0.02::DOUBLE)" for j in range(5)]
#: Forward scores by window, and whether each label was stepped up to; then the way back from the last window's label.
_DECODED = f"""WITH RECURSIVE {_COUNTED}, {_WALK},
    counts AS MATERIALIZED (SELECT doc_id, win, {", ".join(f"sum(c{k}) AS c{k}" for k in range(5))} FROM walk JOIN items USING (doc_id, i) GROUP BY ALL),
    e AS MATERIALIZED (SELECT doc_id, win, count(*) OVER (PARTITION BY doc_id) AS n, {", ".join(f"ln(greatest((1 + c{k}) / (5 + c0 + c1 + c2 + c3 + c4)::DOUBLE, 1e-9::DOUBLE)) AS e{k}" for k in range(5))} FROM counts),
    f AS (SELECT doc_id, win, n, {", ".join(f"CASE WHEN n >= 5 THEN {'e0' if k == 0 else '-1e18::DOUBLE'} ELSE e{k} - 0.4::DOUBLE * {k} END AS s{k}" for k in range(5))}, {", ".join(f"FALSE AS u{k}" for k in range(5))} FROM e WHERE win = 1
    UNION ALL SELECT e.doc_id, e.win, e.n, {", ".join(_STAY[k] + f" + e{k}" if k == 0 else f"CASE WHEN {_STEP[k]} > {_STAY[k]} THEN {_STEP[k]} ELSE {_STAY[k]} END + e{k}" for k in range(5))}, FALSE, {", ".join(f"{_STEP[k]} > {_STAY[k]}" for k in range(1, 5))} FROM f JOIN e ON e.doc_id = f.doc_id AND e.win = f.win + 1),
    back AS (SELECT doc_id, win, CASE WHEN n >= 5 THEN 4 ELSE list_position([s0, s1, s2, s3, s4], greatest(s0, s1, s2, s3, s4)) - 1 END::BIGINT AS label FROM f WHERE win = n
    UNION ALL SELECT f.doc_id, f.win - 1, back.label - [u0, u1, u2, u3, u4][back.label + 1]::BIGINT FROM back JOIN f ON f.doc_id = back.doc_id AND f.win = back.win WHERE f.win > 1)
    SELECT doc_id, win, label FROM back"""


def labelled_windows(spark, sf) -> DataFrame:
    """Windows (doc_id, win, fin, probs) of the documents, with a probability for each of five sections: its vowel's share of the window."""
    w = pack_windows(items(spark, sf).select("doc_id", "i", "n", "a", "b", "text"), with_text=True)
    c = [F.length("text") - F.length(F.replace("text", F.lit(v))) for v in _VOWELS]
    return w.select("doc_id", "win", "fin", F.array(*[(1 + x) / (5 + sum(c)).cast("double") for x in c]).alias("probs"))


@query("seq_decode_labels", _DECODED)
def seq_decode_labels(spark, sf):
    """Ordered section labels of the windows of each document."""
    return decode_labels(labelled_windows(spark, sf), 5)


@query("seq_stream_labels", _DECODED)
def seq_stream_labels(spark, sf):
    """The same labels from a stream: windows come as files, four a batch, and a lag over the whole lecture settles them when event time has passed it."""
    folder = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    ts = F.timestamp_seconds(F.col("fin"))
    rows = labelled_windows(spark, sf).select("doc_id", "win", ts.alias("ts"), "probs")
    rows.repartition(16, "doc_id", "win").write.parquet(f"{folder}/in/lectures")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in/*")
    # files come in any order, so no window counts as late
    labels = online_labels(stream, 5, lag=1_000_000, late="100 years").where("doc_id IS NOT NULL").select("doc_id", "win", "label")
    write = labels.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    write.start().awaitTermination()
    # a row from far ahead lets event time pass all lectures
    spark.range(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "id AS win", "TIMESTAMP '2200-01-01 00:00:00' AS ts", "array(0.5D) AS probs").write.parquet(f"{folder}/in/end")
    write.start().awaitTermination()
    return spark.read.schema(labels.schema).parquet(f"{folder}/out")


@query("seq_merge_short")
def seq_merge_short(spark, sf):
    """Segments shorter than thirty seconds merged into neighbours: no SQL, tested against a plain version."""
    w = pack_windows(items(spark, sf).select("doc_id", "i", "n", "a", "b", "text"), with_text=True)
    return merge_short(w, 30.0)


@query(
    "txt_pagerank",
    f"""WITH RECURSIVE tk AS (SELECT DISTINCT item_id, unnest({_tokens('text')}) AS token FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM tk GROUP BY 1),
    e AS MATERIALIZED (SELECT src, dst, both_ / (x.n + y.n)::DOUBLE AS weight FROM (SELECT a.item_id AS src, b.item_id AS dst, count(*) AS both_ FROM tk a JOIN tk b ON a.token = b.token AND a.item_id <> b.item_id GROUP BY ALL) JOIN n x ON x.item_id = src JOIN n y ON y.item_id = dst),
    step AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e), nodes AS (SELECT src AS node, count(*) OVER () AS n FROM (SELECT DISTINCT src FROM step)),
    ranks AS (SELECT node, n, 1.0::DOUBLE / n AS rank, 0 AS k FROM nodes UNION ALL SELECT s.dst, any_value(r.n), (1 - 0.85::DOUBLE) / any_value(r.n) + 0.85::DOUBLE * sum(r.rank * s.share), r.k + 1 FROM ranks r JOIN step s ON s.src = r.node WHERE r.k < 12 GROUP BY s.dst, r.k)
    SELECT node, floor(rank * 1000000 + 0.5) / 1000000 AS rank FROM ranks WHERE k = 12""",
)
def txt_pagerank(spark, sf):
    """Centrality of plan sections that share words."""
    words = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    sizes = words.groupBy("item_id").agg(F.count("*").alias("n"))
    x, y = words.withColumnRenamed("item_id", "src"), words.withColumnRenamed("item_id", "dst")
    shared = x.join(y, "token").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("both"))
    edges = shared.join(sizes.select(F.col("item_id").alias("src"), F.col("n").alias("n1")), "src").join(sizes.select(F.col("item_id").alias("dst"), F.col("n").alias("n2")), "dst")
    ranks = pagerank(edges.select("src", "dst", (F.col("both") / (F.col("n1") + F.col("n2"))).alias("weight")))
    return ranks.select("node", round6("rank").alias("rank"))


_ROUGE = f"SELECT doc_id, array_to_string(t[i:i + 1], ' ') AS g, count(*) AS c FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM (SELECT doc_id, {_tokens('{0}')} AS t FROM documents)) GROUP BY ALL"


@query("txt_rouge2", f"SELECT doc_id, sum(least(a.c, b.c))::BIGINT AS overlap FROM ({_ROUGE.replace('{0}', 'left(text, length(text) // 2)')}) a JOIN ({_ROUGE.replace('{0}', 'substr(text, length(text) // 2 + 1)')}) b USING (doc_id, g) GROUP BY 1")
def txt_rouge2(spark, sf):
    """Shared bigrams, as a multiset, of the two halves of each document."""
    d = table(spark, sf, "documents")

    def grams(c, name):
        t = d.select("doc_id", T.tokens(c).alias("t")).where(F.size("t") > 1)
        g = t.select("doc_id", F.explode(F.expr("transform(sequence(0, size(t) - 2), i -> concat(t[i], ' ', t[i + 1]))")).alias("g"))
        return g.groupBy("doc_id", "g").agg(F.count("*").alias(name))

    half = F.floor(F.length("text") / 2).cast("int")
    j = grams(F.left("text", half), "x").join(grams(F.substr("text", half + 1), "y"), ["doc_id", "g"])
    return j.groupBy("doc_id").agg(F.sum(F.least("x", "y")).alias("overlap"))
