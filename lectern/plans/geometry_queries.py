"""Quads, lines, boxes, detector results and picture pairs, over line items as detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import maths as M
from lectern.functions.maths import round6
from lectern.operators.lines import sides
from lectern.plans.catalog import query, table

WIDTH, HEIGHT = 120, 90
_R6 = "floor(({0}) * 1000000 + 0.5) / 1000000"


def r6(x: str) -> str:
    return _R6.format(x)


def steady(c):
    """To six places, with ties of exact decimals well on one side: sums in another order round alike."""
    return F.floor(c * 1000000 + 0.500001) / 1000000


def steady_sql(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.500001::DOUBLE) / 1000000"


# a rectangle with its corners pulled about, in no order
_QUADS = """base AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_tax * 100 AS y1, 20 + l_discount * 300 AS w, 15 + l_linenumber * 5.0::DOUBLE AS h, l_discount, l_tax, l_quantity, l_extendedprice FROM lineitem),
    quads AS (SELECT *, [{'x': x1 + w - l_tax * 40, 'y': y1 + h}, {'x': x1, 'y': y1}, {'x': x1 + l_discount * 30, 'y': y1 + h + l_tax * 60}, {'x': x1 + w, 'y': y1 + l_discount * 50}] AS q FROM base)"""
_RING = """ring AS (SELECT *, list_sort(list_transform(q, lambda p: {'a': atan2(p.y - cy, p.x - cx), 'x': p.x, 'y': p.y})) AS r FROM (SELECT *, list_sum(list_transform(q, lambda p: p.x)) / 4 AS cx, list_sum(list_transform(q, lambda p: p.y)) / 4 AS cy FROM quads)),
    ordered AS (SELECT * EXCLUDE (r), list_concat(r[i:], r[:i - 1]) AS o FROM (SELECT *, list_position(list_transform(r, lambda p: p.x + p.y), list_min(list_transform(r, lambda p: p.x + p.y))) AS i FROM ring))"""
_CORNERS = """corners AS (SELECT *, list_sort(list_transform(q, lambda p, i: {'k': p.x + p.y, 'i': i, 'x': p.x, 'y': p.y}))[1] AS tl, list_sort(list_transform(q, lambda p, i: {'k': p.y - p.x, 'i': i, 'x': p.x, 'y': p.y}))[1] AS tr,
    list_sort(list_transform(q, lambda p, i: {'k': -(p.x + p.y), 'i': i, 'x': p.x, 'y': p.y}))[1] AS br, list_sort(list_transform(q, lambda p, i: {'k': -(p.y - p.x), 'i': i, 'x': p.x, 'y': p.y}))[1] AS bl FROM quads)"""


def quads(spark, sf) -> DataFrame:
    t = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity", "l_extendedprice", F.col("l_quantity").alias("x1"), (F.col("l_tax") * 100).alias("y1"),
        (20 + F.col("l_discount") * 300).alias("w"), (15 + F.col("l_linenumber") * 5.0).alias("h"),
    )
    x1, y1, w, h, d, tax = (F.col(c) for c in ("x1", "y1", "w", "h", "l_discount", "l_tax"))
    return t.withColumn("q", F.array(G.point(x1 + w - tax * 40, y1 + h), G.point(x1, y1), G.point(x1 + d * 30, y1 + h + tax * 60), G.point(x1 + w, y1 + d * 50)))


@query("mth_quad_order", f"WITH {_QUADS}, {_RING} SELECT l_orderkey, l_linenumber, " + ", ".join(f"{r6(f'o[{k + 1}].{c}')} AS {c}{k}" for k in range(4) for c in "xy") + ", floor(list_min(list_transform(q, lambda p: p.x)))::BIGINT AS left_edge, ceil(list_max(list_transform(q, lambda p: p.y)))::BIGINT AS bottom FROM ordered")
def mth_quad_order(spark, sf):
    """Corners in order, and the box around them."""
    o = quads(spark, sf).withColumn("o", G.order_quad(F.col("q"))).withColumn("b", G.quad_box(F.col("q")))
    return o.select("l_orderkey", "l_linenumber", *[round6(F.get("o", F.lit(k))[c]).alias(f"{c}{k}") for k in range(4) for c in "xy"], F.col("b.x1").alias("left_edge"), F.col("b.y2").alias("bottom"))


@query("mth_quad_clip", f"WITH {_QUADS}, {_RING} SELECT l_orderkey, l_linenumber, {r6('list_sum(list_transform(o, lambda p: least(49, greatest(0, p.x + 3))))')} AS sum_x, {r6('list_sum(list_transform(o, lambda p: least(39, greatest(0, p.y - 5))))')} AS sum_y FROM ordered")
def mth_quad_clip(spark, sf):
    moved = G.clip_quad(G.shift_quad(G.order_quad(F.col("q")), F.lit(3.0), F.lit(-5.0)), 50, 40)
    o = quads(spark, sf).withColumn("o", moved)
    total = lambda c: round6(F.aggregate(F.transform("o", lambda p: p[c]), F.lit(0.0), lambda s, v: s + v))
    return o.select("l_orderkey", "l_linenumber", total("x").alias("sum_x"), total("y").alias("sum_y"))


def _angle(a: str, b: str, c: str) -> str:
    dot = f"(({a}.x - {b}.x) * ({c}.x - {b}.x) + ({a}.y - {b}.y) * ({c}.y - {b}.y))"
    size = lambda p: f"(sqrt(({p}.x - {b}.x) * ({p}.x - {b}.x) + ({p}.y - {b}.y) * ({p}.y - {b}.y)) + 1e-6::DOUBLE)"
    return f"degrees(acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {dot} / ({size(a)} * {size(c)})))))"


def _cross(a: str, b: str, c: str) -> str:
    return f"(({b}.x - {a}.x) * ({c}.y - {b}.y) - ({b}.y - {a}.y) * ({c}.x - {b}.x))"


_TURN = [("tl", "tr", "br"), ("tr", "br", "bl"), ("br", "bl", "tl"), ("bl", "tl", "tr")]
_DIST = lambda a, b: f"sqrt(({a}.x - {b}.x) ** 2 + ({a}.y - {b}.y) ** 2)"
_SCORED = f"""sized AS (SELECT *, {' + '.join(f'abs({_angle(*t)} - 90)' for t in _TURN)} AS bend, ({' AND '.join(f'{_cross(*t)} > 0' for t in _TURN)}) OR ({' AND '.join(f'{_cross(*t)} < 0' for t in _TURN)}) AS convex,
    greatest(round_even(greatest({_DIST('br', 'bl')}, {_DIST('tr', 'tl')}), 0)::INT, 1) AS wide, greatest(round_even(greatest({_DIST('tr', 'br')}, {_DIST('tl', 'bl')}), 0)::INT, 1) AS high,
    abs(tl.x * tr.y - tr.x * tl.y + tr.x * br.y - br.x * tr.y + br.x * bl.y - bl.x * br.y + bl.x * tl.y - tl.x * bl.y) / 2 AS area,
    sqrt(((tl.x + tr.x + br.x + bl.x) / 4 - 60) ** 2 + ((tl.y + tr.y + br.y + bl.y) / 4 - 45) ** 2) AS away,
    len(list_filter([tl, tr, br, bl], lambda p: p.x <= 2.4 OR p.x >= 116.6 OR p.y <= 2 OR p.y >= 87)) AS near FROM corners),
    scored AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - bend / 4 / 35)) AS angles,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, greatest({', '.join(f'exp(-abs(ln((wide / high::DOUBLE + 1e-6::DOUBLE) / ({t}::DOUBLE))) / 0.35::DOUBLE)' for t in ('4.0::DOUBLE / 3', '1.6', '16.0::DOUBLE / 9'))}))) AS aspect,
    CASE WHEN r <= 0.03 THEN 0 WHEN r < 0.10 THEN least(1, greatest(0, (r - 0.03::DOUBLE) / 0.07::DOUBLE)) WHEN r <= 0.85 THEN 1 ELSE least(1, greatest(0, 1 - (r - 0.85::DOUBLE) / 0.15::DOUBLE)) END::DOUBLE AS area_score,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - away / (0.6::DOUBLE * (150 + 1e-6::DOUBLE)))) AS center, [1.0, 0.75, 0.45, 0.15, 0.0][near + 1]::DOUBLE AS border,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_quantity * 60 / greatest(area, 1.0::DOUBLE))) AS fill, l_discount * 10 AS edge, l_tax * 10 AS contrast, (l_linenumber % 5) / 4.0::DOUBLE AS blur FROM (SELECT *, area / 10800 AS r FROM sized)),
    sure AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, c2 * CASE WHEN border < 0.30 AND edge < 0.60 THEN 0.75::DOUBLE ELSE 1 END)) AS confidence FROM (SELECT *, c1 * CASE WHEN edge < 0.40 THEN 0.85::DOUBLE ELSE 1 END AS c2 FROM (SELECT *,
    (0.17::DOUBLE * area_score + 0.10::DOUBLE * aspect + 0.14::DOUBLE * angles + 0.18::DOUBLE * fill + 0.22::DOUBLE * edge + 0.08::DOUBLE * contrast + 0.04::DOUBLE * center + 0.03::DOUBLE * border + 0.04::DOUBLE * blur) * CASE WHEN fill < 0.72 THEN 0.80::DOUBLE ELSE 1 END AS c1 FROM scored)))"""


@query(
    "mth_quad_scores",
    f"WITH {_QUADS}, {_CORNERS}, {_SCORED} SELECT l_orderkey, l_linenumber, convex, wide, high, {r6('angles')} AS angles, {r6('aspect')} AS aspect, {r6('area_score')} AS area, {r6('center')} AS center, border AS border_margin, {r6('fill')} AS rectangularity, {r6('confidence')} AS confidence, "
    "confidence >= 0.30 AND fill >= 0.72 AND edge >= 0.58 AND angles >= 0.70 AND area_score >= 0.45 AND border >= 0.45 AS reliable FROM sure",
)
def mth_quad_scores(spark, sf):
    """Every quality of a quad, its confidence, and whether it can be relied on (at a low bar, as these quads are poor)."""
    q = quads(spark, sf).withColumn("c", G.corners(F.col("q")))
    c = F.col("c")
    size = G.rectified_size(c)
    m = q.select(
        "l_orderkey", "l_linenumber", G.is_convex(c).alias("convex"), size["width"].alias("wide"), size["height"].alias("high"),
        G.angle_score(c).alias("angles"), G.aspect_score(c).alias("aspect"), G.area_score(c, WIDTH, HEIGHT).alias("area"), G.center_score(c, WIDTH, HEIGHT).alias("center"),
        G.border_score(c, WIDTH, HEIGHT).alias("border_margin"), G.rectangularity(F.col("l_quantity") * 60, c).alias("rectangularity"),
        (F.col("l_discount") * 10).alias("edge_support"), (F.col("l_tax") * 10).alias("contrast"), ((F.col("l_linenumber") % 5) / 4.0).alias("blur"),
    )
    metrics = {k: F.col(k) for k in G.WEIGHTS}
    m = m.withColumn("confidence", G.confidence(metrics))
    r = lambda k: round6(k).alias(k)
    return m.select("l_orderkey", "l_linenumber", "convex", "wide", "high", r("angles"), r("aspect"), r("area"), r("center"), "border_margin", r("rectangularity"), r("confidence"), G.is_reliable(F.col("confidence"), metrics, 0.30).alias("reliable"))


@query(
    "mth_polygon_iou",
    f"WITH {_QUADS} SELECT l_orderkey, l_linenumber, {steady_sql('CASE WHEN w * h + 1200 - i > 0 THEN i / (w * h + 1200 - i) ELSE 0 END')} AS iou FROM (SELECT *, greatest(0.0::DOUBLE, least(x1 + w, 50) - greatest(x1, 10)) * greatest(0.0::DOUBLE, least(y1 + h, 35) - greatest(y1, 5)) AS i FROM base)",
)
def mth_polygon_iou(spark, sf):
    """Overlap of two slanted quads. A slant takes areas to areas, so rectangles in the SQL have the same share."""
    q = quads(spark, sf)
    slant = lambda c: F.transform(c, lambda p: F.struct((p.x + 0.3 * p.y).alias("x"), (p.y + 0.1 * p.x).alias("y")))
    own = G.rect_quad(F.col("x1"), F.col("y1"), F.col("x1") + F.col("w"), F.col("y1") + F.col("h"))
    return q.select("l_orderkey", "l_linenumber", steady(G.polygon_iou(slant(own), slant(G.rect_quad(*[F.lit(v) for v in (10.0, 5.0, 50.0, 35.0)])))).alias("iou"))


_LINES = """ends AS (SELECT l_orderkey, l_linenumber, l_quantity AS px, l_tax * 100 AS py, l_quantity + l_discount * 100 - 3 AS qx, l_tax * 100 + l_linenumber - 2 AS qy, l_discount * 100 AS rise FROM lineitem),
    formed AS (SELECT *, qx - px AS dx, qy - py AS dy, sqrt((qx - px) ** 2 + (qy - py) ** 2) AS n, 100.0::DOUBLE AS ex, rise AS ey, sqrt(10000 + rise ** 2) AS m FROM ends),
    lines AS (SELECT *, CASE WHEN c0 < 0 THEN -1 ELSE 1 END * (dy / n) AS nx, CASE WHEN c0 < 0 THEN -1 ELSE 1 END * (-dx / n) AS ny, abs(c0) AS c,
    CASE WHEN k0 < 0 THEN -1 ELSE 1 END * (ey / m) AS ux, CASE WHEN k0 < 0 THEN -1 ELSE 1 END * (-ex / m) AS uy, abs(k0) AS k FROM (SELECT *, CASE WHEN n >= 1e-9 THEN -(dy / n * px - dx / n * py) END AS c0, -(ey / m * 0 - ex / m * 50) AS k0 FROM formed)),
    crossed AS (SELECT *, CASE WHEN abs(nx * uy - ny * ux) >= 1e-4 THEN (ny * k - uy * c) / (nx * uy - ny * ux) END AS x, CASE WHEN abs(nx * uy - ny * ux) >= 1e-4 THEN (ux * c - nx * k) / (nx * uy - ny * ux) END AS y FROM lines)"""


@query(
    "mth_lines",
    f"WITH {_LINES} SELECT l_orderkey, l_linenumber, {r6('CASE WHEN n >= 1e-9 THEN nx * 60 + ny * 45 + c END')} AS off, {r6('x')} AS x, {r6('y')} AS y, coalesce(abs(x) <= 360 AND abs(y) <= 270, FALSE) AS reasonable, {r6('(px * 5 + qx * 5) / 2')} AS sampled FROM crossed",
)
def mth_lines(spark, sf):
    """Normal forms of two lines, where they meet, how far the centre is off, and points along a side."""
    t = table(spark, sf, "lineitem")
    p = G.point(F.col("l_quantity"), F.col("l_tax") * 100)
    q = G.point(F.col("l_quantity") + F.col("l_discount") * 100 - 3, F.col("l_tax") * 100 + F.col("l_linenumber") - 2)
    e = G.point(F.lit(100.0), 50 + F.col("l_discount") * 100)
    rows = t.select("l_orderkey", "l_linenumber", p.alias("p"), q.alias("q"), G.normal_form(p, q).alias("a"), G.normal_form(G.point(F.lit(0.0), F.lit(50.0)), e).alias("b"))
    rows = rows.withColumn("m", G.intersection(F.col("a"), F.col("b")))
    xs = F.aggregate(F.transform(G.sample_side(F.col("p"), F.col("q"), 5), lambda s: s.x), F.lit(0.0), lambda s, v: s + v)
    return rows.select("l_orderkey", "l_linenumber", round6(G.signed_offset(F.col("a"), G.point(F.lit(60.0), F.lit(45.0)))).alias("off"), round6("m.x").alias("x"), round6("m.y").alias("y"), G.is_reasonable(F.col("m"), WIDTH, HEIGHT).alias("reasonable"), round6(xs).alias("sampled"))


_CLAMP = lambda v, top: f"round_even(least({top - 1}.0::DOUBLE, greatest(0.0::DOUBLE, ({v})::DOUBLE)), 0)::INT"


@query(
    "mth_roi_pad",
    f"""SELECT l_orderkey, l_linenumber, least({_CLAMP('x - 12', 120)}, {_CLAMP('x + w + 12', 120)}) AS px1, greatest({_CLAMP('y - 9', 90)}, {_CLAMP('y + h + 9', 90)}) AS py2, greatest(0, x - round_even(0.06::DOUBLE * w, 0)::INT) AS bx1, least(89, y + h + round_even(0.06::DOUBLE * h, 0)::INT) AS by2,
    CASE WHEN least(120, greatest(1, x + w)) > least(119, greatest(0, x)) + 5 AND least(90, greatest(1, y + h)) > least(89, greatest(0, y)) + 5 THEN least(120, greatest(1, x + w)) END AS vx2,
    {r6('CASE WHEN w <= 0 OR h <= 0 THEN 0 ELSE least(w, h) / greatest(w, h)::DOUBLE END')} AS ratio, (w + 1) * (h + 1) AS pixels, 9 AS quad_x, 83 AS quad_y FROM (SELECT *, l_quantity::INT AS x, l_linenumber * 10 AS y, floor(l_discount * 500)::INT AS w, floor(l_tax * 400)::INT AS h FROM lineitem)""",
)
def mth_roi_pad(spark, sf):
    """Regions grown by the picture's size and by their own, valid boxes, ratios, pixels, and the quad to fall back on."""
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("x"), (F.col("l_linenumber") * 10).alias("y"), F.floor(F.col("l_discount") * 500).cast("int").alias("w"), F.floor(F.col("l_tax") * 400).cast("int").alias("h"))
    x, y, w, h = (F.col(c) for c in "xywh")
    by_picture, by_box, valid = G.pad_by_picture(x, y, w, h, WIDTH, HEIGHT), G.pad_by_box(x, y, x + w, y + h, WIDTH, HEIGHT), G.valid_box(x, y, x + w, y + h, WIDTH, HEIGHT)
    q = G.default_quad(WIDTH, HEIGHT)
    return t.select(
        "l_orderkey", "l_linenumber", by_picture["x1"].alias("px1"), by_picture["y2"].alias("py2"), by_box["x1"].alias("bx1"), by_box["y2"].alias("by2"), valid["x2"].alias("vx2"),
        round6(G.aspect_ratio(w, h)).alias("ratio"), G.box_pixels(x, y, x + w, y + h).alias("pixels"), F.get(q, F.lit(0))["x"].cast("int").alias("quad_x"), F.get(q, F.lit(2))["y"].cast("int").alias("quad_y"),
    )


_BOXED = """boxed AS (SELECT * EXCLUDE (q), CASE WHEN l_linenumber % 3 = 0 THEN [{'x': ax, 'y': ay}, {'x': bx, 'y': ay}, {'x': bx, 'y': cy}, {'x': ax, 'y': cy}] ELSE q END AS q FROM (SELECT *, round_even(x1, 0) AS ax, round_even(y1, 0) AS ay, round_even(x1 + w, 0) AS bx, round_even(y1 + h, 0) AS cy FROM quads))"""
_DETECTED = f"WITH {_QUADS}, {_BOXED}, {_RING.replace('FROM quads)', 'FROM (SELECT * EXCLUDE (ax, ay, bx, cy) FROM boxed))')}"


@query("mth_detector_result", f"{_DETECTED} SELECT l_orderkey, l_linenumber, {r6('list_sum(list_transform(o, lambda p: least(119, greatest(0, p.x))))')} AS sum_x, {r6('list_sum(list_transform(o, lambda p: least(89, greatest(0, p.y))))')} AS sum_y FROM ordered")
def mth_detector_result(spark, sf):
    """Detector results as points, as boxes and as plain numbers, brought to one quad."""
    q = quads(spark, sf)
    kind = F.col("l_linenumber") % 3
    points = F.when(kind == 1, F.col("q"))
    numbers = F.array(F.col("x1"), F.col("y1"), F.col("x1") + F.col("w"), F.col("y1") + F.col("h"))
    flat = F.flatten(F.transform("q", lambda p: F.array(p.x, p.y)))
    o = q.withColumn("o", G.detector_quad(points, F.when((kind == 0) & (F.col("l_orderkey") % 2 == 0), numbers), F.when(kind == 2, flat).when(kind == 0, numbers), WIDTH, HEIGHT))
    total = lambda c: round6(F.aggregate(F.transform("o", lambda p: p[c]), F.lit(0.0), lambda s, v: s + v))
    return o.select("l_orderkey", "l_linenumber", total("x").alias("sum_x"), total("y").alias("sum_y"))


@query("str_quad_json", f"WITH {_QUADS} SELECT l_orderkey, l_linenumber, {r6('list_sum(list_transform(q, lambda p: round_even(p.x, 2)))')} AS sum_x, 4 AS n FROM quads")
def str_quad_json(spark, sf):
    """Quads written as JSON and read again: two places are left."""
    from lectern.functions.markup import quad_json

    back = F.from_json(quad_json(F.col("q")), "array<array<double>>")
    rows = quads(spark, sf).withColumn("back", back)
    return rows.select("l_orderkey", "l_linenumber", round6(F.aggregate(F.transform("back", lambda p: F.get(p, F.lit(0))), F.lit(0.0), lambda s, v: s + v)).alias("sum_x"), F.size("back").alias("n"))


# --- pairs of pictures ---------------------------------------------------------------

_PAIR = """pair AS (SELECT *, CASE WHEN prev < 1 OR cur < 1 THEN 0 ELSE joint / (prev + 1e-9::DOUBLE) END AS recall, CASE WHEN prev < 1 OR cur < 1 THEN 0 ELSE cur / (prev + 1e-9::DOUBLE) END AS area_ratio, CASE WHEN prev < 1 OR cur < 1 THEN 0 ELSE greatest(0.0::DOUBLE, cur - joint) / (prev + 1e-9::DOUBLE) END AS added,
    CASE WHEN prev < 1 OR cur < 1 THEN 1 ELSE greatest(0.0::DOUBLE, prev - joint) / (prev + 1e-9::DOUBLE) END AS removed FROM (SELECT *, greatest(0.0::DOUBLE, least(prev, cur) - l_tax * 50) AS joint FROM (SELECT l_orderkey, l_linenumber, l_tax, l_discount * 150 AS shift, (l_quantity - 1) * 10 AS prev, (l_quantity - 1) * 10 + (l_linenumber - 3) * 2 AS cur FROM lineitem)))"""


@query("flt_contained", f"WITH {_PAIR} SELECT l_orderkey, l_linenumber, {r6('recall')} AS recall, {r6('area_ratio')} AS area_ratio, {r6('added')} AS added, {r6('removed')} AS removed, recall >= 0.98 AND removed <= 0.02 AND area_ratio >= 0.995 AND shift <= 10 AS contained FROM pair")
def flt_contained(spark, sf):
    """How much ink of an earlier picture the later one holds, and whether it holds it all."""
    t = table(spark, sf, "lineitem").withColumn("prev", (F.col("l_quantity") - 1) * 10).withColumn("cur", F.col("prev") + (F.col("l_linenumber") - 3) * 2)
    both = F.greatest(F.lit(0.0), F.least("prev", "cur") - F.col("l_tax") * 50)
    m = t.withColumn("m", G.containment(F.col("prev"), F.col("cur"), both))
    r = lambda k: round6(f"m.{k}").alias(k)
    return m.select("l_orderkey", "l_linenumber", r("recall"), r("area_ratio"), r("added"), r("removed"), G.contains_previous(F.col("m"), F.col("l_discount") * 150).alias("contained"))


@query("flt_scrolled", "SELECT l_orderkey, l_linenumber, greatest(l_discount * 200, l_tax * 100) >= 10 AND l_discount >= 0.05 AND 1 - l_tax * 4 >= 0.65 AND aligned >= 0.90 AND aligned >= aligned - l_tax + 0.05::DOUBLE AS related FROM (SELECT *, 0.8::DOUBLE + l_quantity / 250 AS aligned FROM lineitem)")
def flt_scrolled(spark, sf):
    aligned = 0.8 + F.col("l_quantity") / 250
    related = G.scroll_related(F.col("l_discount") * 200, -F.col("l_tax") * 100, F.col("l_discount"), 1 - F.col("l_tax") * 4, aligned, aligned - F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", related.alias("related"))


# --- lines to quads --------------------------------------------------------------------

_TOP = "top AS (SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem)"


def longest(rows: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The k longest lines of each picture and direction."""
    w = Window.partitionBy(*by).orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


@query("top_longest_lines", f"WITH {_TOP} SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, place FROM top WHERE place <= 10")
def top_longest_lines(spark, sf):
    return longest(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"]).select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "place")


@query(
    "top_quad_candidates",
    f"""WITH {_TOP}, l AS (SELECT *, (l_extendedprice % 1000) / 10 AS off FROM top WHERE place <= 10), p AS (SELECT a.l_suppkey, a.l_returnflag, a.place AS a, b.place AS b, least(a.off, b.off) AS lo, greatest(a.off, b.off) AS hi FROM l a JOIN l b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag AND a.place < b.place WHERE abs(a.off - b.off) >= 7.2),
    q AS (SELECT x.l_suppkey, x.a, x.b, y.a AS c, y.b AS d, x.lo AS x1, x.hi AS x2, y.lo AS y1, y.hi AS y2 FROM p x JOIN p y ON x.l_suppkey = y.l_suppkey WHERE x.l_returnflag = 'A' AND y.l_returnflag = 'N' AND (x.hi - x.lo) * (y.hi - y.lo) >= 540)
    SELECT l_suppkey, a, b, c, d FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, round_even((x1 + x2) / 2 / 20, 0), round_even((y1 + y2) / 2 / 20, 0), round_even((x2 - x1) * (y2 - y1) / 5000, 0) ORDER BY a, b, c, d) AS rn FROM q) WHERE rn = 1""",
)
def top_quad_candidates(spark, sf):
    """Two lines of one direction with two of the other, far enough apart and large enough, one for each rounded place and area: at most 45 x 45 a picture."""
    lines = longest(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"]).select("l_suppkey", "l_returnflag", "place", ((F.col("l_extendedprice") % 1000) / 10).alias("off"))
    a, b = lines.select("l_suppkey", "l_returnflag", F.col("place").alias("a"), F.col("off").alias("u")), lines.select("l_suppkey", "l_returnflag", F.col("place").alias("b"), F.col("off").alias("v"))
    pairs = a.join(b, ["l_suppkey", "l_returnflag"]).where("a < b AND abs(u - v) >= 7.2").select("l_suppkey", "l_returnflag", "a", "b", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    x = pairs.where("l_returnflag = 'A'").select("l_suppkey", "a", "b", F.col("lo").alias("x1"), F.col("hi").alias("x2"))
    y = pairs.where("l_returnflag = 'N'").select("l_suppkey", F.col("a").alias("c"), F.col("b").alias("d"), F.col("lo").alias("y1"), F.col("hi").alias("y2"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    key = [F.bround((F.col("x1") + F.col("x2")) / 2 / 20, 0), F.bround((F.col("y1") + F.col("y2")) / 2 / 20, 0), F.bround(area / 5000, 0)]
    w = Window.partitionBy("l_suppkey", *key).orderBy("a", "b", "c", "d")
    return x.join(y, "l_suppkey").where(area >= 0.05 * WIDTH * HEIGHT).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_suppkey", "a", "b", "c", "d")


@query("seq_sides")
def seq_sides(spark, sf):
    """Lines of each note's picture merged into sides of two directions: no SQL for clusters that grow, tested against known pictures."""
    t = table(spark, sf, "lineitem")
    x, y = F.col("l_quantity") * 2, F.col("l_discount") * 900
    long = F.col("l_linenumber") * 10.0
    flat = F.col("l_tax") < 0.04
    lines = t.select("l_orderkey", F.xxhash64("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("line"), x.alias("x1"), y.alias("y1"), F.when(flat, x + long).otherwise(x).alias("x2"), F.when(flat, y).otherwise(y + long).alias("y2"))
    return sides(lines, "l_orderkey")


# --- reports ------------------------------------------------------------------------------

_THREE = "three AS (SELECT l_orderkey, l_linenumber, m.method, CASE m.method WHEN 'classic' THEN l_discount * 8 WHEN 'neural' THEN l_tax * 11 ELSE (l_discount + l_tax) * 5 END AS iou, CASE m.method WHEN 'classic' THEN l_quantity ELSE l_quantity * 2 END AS runtime, l_linestatus AS video, m.method = 'classic' AND l_tax = 0 AS failed FROM lineitem, (VALUES ('classic'), ('neural'), ('hybrid')) m(method))"
_MEANS = ", ".join(f"{r6(x)} AS {n}" for x, n in (("avg(iou)", "mean_iou"), ("median(iou)", "median_iou"), ("avg(runtime)", "mean_runtime"), ("median(runtime)", "median_runtime"), ("count(*) FILTER (iou >= 0.7) / count(*)::DOUBLE", "success_rate")))


@query("ml_experiment", f"WITH {_THREE} SELECT method, video, count(*) AS n, count(*) FILTER (iou >= 0.7) AS successful, {_MEANS}, count(*) FILTER (failed) AS errors FROM three GROUP BY GROUPING SETS ((method), (method, video))")
def ml_experiment(spark, sf):
    """Three detectors on every frame, their failures, and the report by method and by video, in one pass."""
    m = F.col("method")
    rows = table(spark, sf, "lineitem").select("*", F.explode(F.array(*[F.lit(x) for x in ("classic", "neural", "hybrid")])).alias("method"))
    iou = F.when(m == "classic", F.col("l_discount") * 8).when(m == "neural", F.col("l_tax") * 11).otherwise((F.col("l_discount") + F.col("l_tax")) * 5)
    rows = rows.select("method", F.col("l_linestatus").alias("video"), iou.alias("iou"), F.when(m == "classic", F.col("l_quantity")).otherwise(F.col("l_quantity") * 2).alias("runtime"), ((m == "classic") & (F.col("l_tax") == 0)).alias("failed"))
    good = F.count_if(F.col("iou") >= 0.7)
    return rows.groupingSets([["method"], ["method", "video"]], "method", "video").agg(
        F.count("*").alias("n"), good.alias("successful"), round6(F.avg("iou")).alias("mean_iou"), round6(F.median("iou")).alias("median_iou"), round6(F.avg("runtime")).alias("mean_runtime"),
        round6(F.median("runtime")).alias("median_runtime"), round6(good / F.count("*").cast("double")).alias("success_rate"), F.count_if("failed").alias("errors"),
    )


@query("agg_iou_report", f"SELECT l_linestatus AS video, {r6('avg(l_discount * 10)')} AS mean_iou, {r6('median(l_discount * 10)')} AS median_iou, {r6('avg(abs(l_discount - l_tax))')} AS mae, {r6('avg((l_discount * 10 >= 0.5)::INT)')} AS acc_50, {r6('avg((l_discount * 10 >= 0.75)::INT)')} AS acc_75, {r6('avg((l_discount * 10 >= 0.9)::INT)')} AS acc_90 FROM lineitem GROUP BY 1")
def agg_iou_report(spark, sf):
    iou = F.col("l_discount") * 10
    hit = lambda t: round6(F.avg((iou >= t).cast("int")))
    return table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("video")).agg(round6(F.avg(iou)).alias("mean_iou"), round6(F.median(iou)).alias("median_iou"), round6(F.avg(F.abs(F.col("l_discount") - F.col("l_tax")))).alias("mae"), hit(0.5).alias("acc_50"), hit(0.75).alias("acc_75"), hit(0.9).alias("acc_90"))


@query("agg_area_by_split", f"SELECT p_type AS split, min(p_size * p_retailprice) AS least, {r6('avg(p_size * p_retailprice)')} AS mean, max(p_size * p_retailprice) AS most FROM part GROUP BY 1")
def agg_area_by_split(spark, sf):
    area = F.col("p_size") * F.col("p_retailprice")
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("split")).agg(F.min(area).alias("least"), round6(F.avg(area)).alias("mean"), F.max(area).alias("most"))


@query("agg_running_mean", f"SELECT l_suppkey, l_orderkey, l_linenumber, {steady_sql('avg(l_discount) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)')} AS mean FROM lineitem")
def agg_running_mean(spark, sf):
    """A metric's mean as its rows come in: totals and counts so far."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", steady(F.sum("l_discount").over(w) / F.count("l_discount").over(w)).alias("mean"))


@query("mth_renormalise", f"SELECT l_orderkey, l_linenumber, {r6('CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE / 3 ELSE greatest(1e-9::DOUBLE, l_discount) / (greatest(1e-9::DOUBLE, l_discount) + greatest(1e-9::DOUBLE, l_tax) + 0.05::DOUBLE) END')} AS first FROM lineitem")
def mth_renormalise(spark, sf):
    """Probabilities with a floor, adding up to one; even ones where their number is wrong."""
    probs = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.col("l_discount"), F.col("l_tax"), F.lit(0.05)))
    even = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda _: F.lit(1.0 / 3))
    p = F.when(F.size(probs) == 3, M.renormalise(probs)).otherwise(even)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", round6(F.get(p, F.lit(0))).alias("first"))


@query("mth_softmax_vector", f"SELECT p_partkey, {r6('e[1] / list_sum(e)')} AS a, {r6('e[2] / list_sum(e)')} AS b, {r6('e[3] / list_sum(e)')} AS c FROM (SELECT p_partkey, list_transform(s, lambda x: exp((x - list_max(s)) / 0.35::DOUBLE)) AS e FROM (SELECT p_partkey, [p_size / 50.0::DOUBLE, p_retailprice / 2000.0::DOUBLE, 0.5::DOUBLE] AS s FROM part))")
def mth_softmax_vector(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", M.softmax(F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0, F.lit(0.5))).alias("s"))
    return rows.select("p_partkey", *[round6(F.get("s", F.lit(k))).alias(n) for k, n in enumerate("abc")])

