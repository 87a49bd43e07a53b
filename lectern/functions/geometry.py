"""Lines, quads and boxes: Column to Column, all inside the JVM.

A quad or polygon is an array of structs (x, y) of doubles; a box is a struct (x1, y1, x2, y2).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.maths import clamp, polygon_area
from lectern.functions.text import bound

#: Aspect ratios of slides, and what each quality counts in the confidence of a quad.
ASPECTS = (4 / 3, 16 / 10, 16 / 9)
WEIGHTS = {"area": 0.17, "aspect": 0.10, "angles": 0.14, "rectangularity": 0.18, "edge_support": 0.22, "contrast": 0.08, "center": 0.04, "border_margin": 0.03, "blur": 0.04}
#: Score by how many corners lie at the frame's border.
AT_BORDER = (1.0, 0.75, 0.45, 0.15, 0.0)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def rect_quad(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _mean(values: Column) -> Column:
    return _total(values) / F.size(values)


def center(q: Column) -> Column:
    return F.struct(_mean(F.transform(q, lambda p: p.x)).alias("x"), _mean(F.transform(q, lambda p: p.y)).alias("y"))


def order_quad(q: Column) -> Column:
    """The points by their angle about the centre, from the one with the least x + y on."""

    def turned(ring: Column) -> Column:
        sums = F.transform(ring, lambda p: p.x + p.y)
        first = F.array_position(sums, F.array_min(sums)).cast("int")
        return F.concat(F.slice(ring, first, F.size(ring)), F.slice(ring, 1, first - 1))

    def ring(c: Column) -> Column:
        by_angle = F.array_sort(F.transform(q, lambda p: F.struct(F.atan2(p.y - c.y, p.x - c.x).alias("a"), p.x.alias("x"), p.y.alias("y"))))
        return F.transform(by_angle, lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))

    return bound(bound(center(q), ring), turned)


def corners(q: Column) -> Column:
    """Top left, top right, bottom right, bottom left: the extremes of x + y and y - x, the first on ties."""
    extreme = lambda key, sign: F.array_min(F.transform(q, lambda p, i: F.struct((sign * key(p)).alias("k"), i.alias("i"), p.x.alias("x"), p.y.alias("y"))))
    total, slope = (lambda p: p.x + p.y), (lambda p: p.y - p.x)
    return F.transform(F.array(extreme(total, 1), extreme(slope, 1), extreme(total, -1), extreme(slope, -1)), lambda e: F.struct(e.x.alias("x"), e.y.alias("y")))


def shift_quad(q: Column, dx: Column, dy: Column) -> Column:
    return F.transform(q, lambda p: F.struct((p.x + dx).alias("x"), (p.y + dy).alias("y")))


def clip_quad(q: Column, width: int, height: int) -> Column:
    """Every point moved into the picture."""
    return F.transform(q, lambda p: F.struct(clamp(p.x, 0.0, width - 1.0).alias("x"), clamp(p.y, 0.0, height - 1.0).alias("y")))


def quad_box(q: Column) -> Column:
    """The box of whole pixels around a quad."""
    xs, ys = F.transform(q, lambda p: p.x), F.transform(q, lambda p: p.y)
    return box(F.floor(F.array_min(xs)), F.floor(F.array_min(ys)), F.ceil(F.array_max(xs)), F.ceil(F.array_max(ys)))


def _crosses(q: Column) -> Column:
    """Cross products of consecutive sides, corner by corner."""
    at = lambda i, k: F.get(q, (i + k) % 4)
    cross = lambda a, b, c: (b.x - a.x) * (c.y - b.y) - (b.y - a.y) * (c.x - b.x)
    return F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda i: cross(at(i, 0), at(i, 1), at(i, 2)))


def is_convex(q: Column) -> Column:
    return bound(_crosses(q), lambda c: F.forall(c, lambda v: v > 0) | F.forall(c, lambda v: v < 0))


def angles(q: Column) -> Column:
    """Interior angles in degrees."""
    at = lambda i, k: F.get(q, (i + k) % 4)

    def angle(a: Column, b: Column, c: Column) -> Column:
        length = lambda p: F.sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) + 1e-6
        dot = (a.x - b.x) * (c.x - b.x) + (a.y - b.y) * (c.y - b.y)
        return F.degrees(F.acos(clamp(dot / (length(a) * length(c)), -1.0, 1.0)))

    return F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda i: angle(at(i, 3), at(i, 0), at(i, 1)))


def rectified_size(c: Column) -> Column:
    """(width, height) of the rectangle that corners (see corners) straighten to."""
    side = lambda i, j: F.sqrt((F.get(c, F.lit(i)).x - F.get(c, F.lit(j)).x) ** 2 + (F.get(c, F.lit(i)).y - F.get(c, F.lit(j)).y) ** 2)
    whole = lambda a, b: F.greatest(F.bround(F.greatest(a, b), 0).cast("int"), F.lit(1))
    return F.struct(whole(side(2, 3), side(1, 0)).alias("width"), whole(side(1, 2), side(0, 3)).alias("height"))


def angle_score(c: Column) -> Column:
    """How near the corners are to right angles."""
    return clamp(1.0 - _mean(F.transform(angles(c), lambda a: F.abs(a - 90.0))) / 35.0, 0.0, 1.0)


def aspect_score(c: Column) -> Column:
    size = rectified_size(c)
    near = [F.exp(-F.abs(F.log((size["width"] / size["height"] + 1e-6) / t)) / 0.35) for t in ASPECTS]
    return clamp(F.greatest(*near), 0.0, 1.0)


def area_score(c: Column, width: int, height: int) -> Column:
    r = polygon_area(c) / max(width * height, 1)
    return F.when(r <= 0.03, 0.0).when(r < 0.10, clamp((r - 0.03) / 0.07, 0.0, 1.0)).when(r <= 0.85, 1.0).otherwise(clamp(1.0 - (r - 0.85) / 0.15, 0.0, 1.0))


def center_score(c: Column, width: int, height: int) -> Column:
    m = center(c)
    away = F.sqrt((m["x"] - width / 2) ** 2 + (m["y"] - height / 2) ** 2)
    return clamp(1.0 - away / (0.6 * (math.hypot(width, height) + 1e-6)), 0.0, 1.0)


def border_score(c: Column, width: int, height: int, margin: float = 0.02) -> Column:
    mx, my = max(2.0, width * margin), max(2.0, height * margin)
    near = F.filter(c, lambda p: (p.x <= mx) | (p.x >= width - 1 - mx) | (p.y <= my) | (p.y >= height - 1 - my))
    return F.get(F.array(*[F.lit(v) for v in AT_BORDER]), F.size(near))


def rectangularity(contour_area: Column, c: Column) -> Column:
    return clamp(contour_area / F.greatest(polygon_area(c), F.lit(1.0)), 0.0, 1.0)


def confidence(metrics: dict[str, Column]) -> Column:
    """Weighted sum of the qualities, less for quads that are no rectangles, have weak edges or hug the border."""
    total = sum((w * metrics[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    total = F.when(metrics["rectangularity"] < 0.72, total * 0.80).otherwise(total)
    total = F.when(metrics["edge_support"] < 0.40, total * 0.85).otherwise(total)
    total = F.when((metrics["border_margin"] < 0.30) & (metrics["edge_support"] < 0.60), total * 0.75).otherwise(total)
    return clamp(total, 0.0, 1.0)


def is_reliable(sure: Column, metrics: dict[str, Column], least: float = 0.58) -> Column:
    floors = {"rectangularity": 0.72, "edge_support": 0.58, "angles": 0.70, "area": 0.45, "border_margin": 0.45}
    out = sure >= least
    for k, v in floors.items():
        out = out & (metrics[k] >= v)
    return out


def _cut(poly: Column, p: Column, q: Column) -> Column:
    """The part of a polygon to the inner side of the edge from p to q."""
    side = lambda s: (q.x - p.x) * (s.y - p.y) - (q.y - p.y) * (s.x - p.x)

    def met(a: Column, b: Column) -> Column:
        t = side(a) / (side(a) - side(b))
        return F.struct((a.x + t * (b.x - a.x)).alias("x"), (a.y + t * (b.y - a.y)).alias("y"))

    def step(s: Column, i: Column) -> Column:
        before = F.element_at(poly, F.when(i == 0, F.size(poly)).otherwise(i))
        now, was = side(s) >= 0, side(before) >= 0
        here = F.struct(s.x.alias("x"), s.y.alias("y"))
        return F.when(now & was, F.array(here)).when(now, F.array(met(before, s), here)).when(was, F.array(met(before, s))).otherwise(F.slice(F.array(here), 1, 0))

    return F.flatten(F.transform(poly, step))


def polygon_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two convex quads: one is cut by the other's edges, a fold over these; 0 without area."""

    def share(x: Column, y: Column) -> Column:
        edges = F.transform(y, lambda p, i: F.struct(p.alias("p"), F.get(y, (i + 1) % F.size(y)).alias("q")))
        rest = F.aggregate(edges, x, lambda poly, e: _cut(poly, e.p, e.q))
        areas = bound(rest, lambda r: F.struct(F.when(F.size(r) > 2, polygon_area(r)).otherwise(0.0).alias("both"), polygon_area(x).alias("x"), polygon_area(y).alias("y")))
        return bound(areas, lambda a: F.when((a.x <= 0) | (a.y <= 0) | (a.x + a.y <= a.both), 0.0).otherwise(clamp(a.both / (a.x + a.y - a.both), 0.0, 1.0)))

    return bound(order_quad(a), lambda x: bound(order_quad(b), lambda y: share(x, y)))


# --- lines ------------------------------------------------------------------------


def segment_angle(p: Column, q: Column) -> Column:
    """Direction of a segment in [0, pi)."""
    return F.pmod(F.atan2(q["y"] - p["y"], q["x"] - p["x"]) + math.pi, F.lit(math.pi))


def normal_form(p: Column, q: Column) -> Column:
    """(nx, ny, c) of the line nx x + ny y + c = 0 through two points, unit normal, c not negative; null for one point."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    n = F.sqrt(dx * dx + dy * dy)
    c = -(dy / n * p["x"] - dx / n * p["y"])
    sign = F.when(c < 0, -1.0).otherwise(1.0)
    return F.when(n >= 1e-9, F.struct((sign * dy / n).alias("nx"), (-sign * dx / n).alias("ny"), (sign * c).alias("c")))


def signed_offset(line: Column, p: Column) -> Column:
    return line["nx"] * p["x"] + line["ny"] * p["y"] + line["c"]


def intersection(a: Column, b: Column) -> Column:
    """The point where two lines meet; null for parallel ones."""
    det = a["nx"] * b["ny"] - a["ny"] * b["nx"]
    return F.when(F.abs(det) >= 1e-4, F.struct(((a["ny"] * b["c"] - b["ny"] * a["c"]) / det).alias("x"), ((b["nx"] * a["c"] - a["nx"] * b["c"]) / det).alias("y")))


def is_reasonable(p: Column, width: int, height: int, most: float = 3.0) -> Column:
    """No point far outside the picture."""
    return F.coalesce((F.abs(p["x"]) <= most * width) & (F.abs(p["y"]) <= most * height), F.lit(False))


def sample_side(p: Column, q: Column, n: int) -> Column:
    """n points along a side, ends included."""
    return F.transform(F.expr(f"transform(sequence(0, {n - 1}), k -> k / {n - 1}.0D)"), lambda t: F.struct((p["x"] * (1 - t) + q["x"] * t).alias("x"), (p["y"] * (1 - t) + q["y"] * t).alias("y")))


# --- boxes ------------------------------------------------------------------------


def whole(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """Corners moved into the picture, to whole pixels, in order."""
    a, b = (whole(clamp(v.cast("double"), 0.0, width - 1.0)) for v in (x1, x2))
    c, d = (whole(clamp(v.cast("double"), 0.0, height - 1.0)) for v in (y1, y2))
    return box(F.least(a, b), F.least(c, d), F.greatest(a, b), F.greatest(c, d))


def valid_box(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """A box inside the picture, or null where less than six pixels are left of a side."""
    a, c = (F.greatest(F.lit(0), F.least(F.lit(top - 1), v.cast("int"))) for v, top in ((x1, width), (y1, height)))
    b, d = (F.greatest(F.lit(1), F.least(F.lit(top), v.cast("int"))) for v, top in ((x2, width), (y2, height)))
    return F.when((b > a + 5) & (d > c + 5), box(a, c, b, d))


def pad_by_picture(x: Column, y: Column, w: Column, h: Column, width: int, height: int, ratio: float = 0.10) -> Column:
    """A box (corner and size) grown by a share of the picture's sides."""
    dx, dy = round(ratio * width), round(ratio * height)
    return clamp_box(x - dx, y - dy, x + w + dx, y + h + dy, width, height)


def pad_by_box(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int, scale: float = 0.06) -> Column:
    """A box grown by a share of its own sides."""
    dx, dy = whole(scale * (x2 - x1)), whole(scale * (y2 - y1))
    return box(F.greatest(F.lit(0), x1 - dx), F.greatest(F.lit(0), y1 - dy), F.least(F.lit(width - 1), x2 + dx), F.least(F.lit(height - 1), y2 + dy))


def default_quad(width: int, height: int, margin: float = 0.08) -> Column:
    mx, my = int(width * margin), int(height * margin)
    return rect_quad(*[F.lit(v) for v in (mx, my, width - mx, height - my)])


def aspect_ratio(w: Column, h: Column) -> Column:
    """The shorter side over the longer, 0 without area."""
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(F.least(w, h) / F.greatest(w, h).cast("double"))


def box_pixels(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Pixels of a box whose ends belong to it."""
    return F.greatest(F.lit(0), x2 - x1 + 1) * F.greatest(F.lit(0), y2 - y1 + 1)


def detector_quad(points: Column, corners_: Column, values: Column, width: int, height: int) -> Column:
    """One quad from whatever a detector gave: four points, else a box (array of four), else eight or four plain numbers; null without any."""
    of_box = lambda v: rect_quad(*[whole(F.get(v, F.lit(k))) for k in range(4)])
    of_eight = F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda i: point(F.get(values, 2 * i), F.get(values, 2 * i + 1)))
    q = F.when(F.size(points) == 4, points).when(F.size(corners_) == 4, of_box(corners_)).when(F.size(values) == 8, of_eight).when(F.size(values) == 4, of_box(values))
    return F.when(q.isNotNull(), clip_quad(order_quad(q), width, height))


# --- pairs of pictures --------------------------------------------------------------


def containment(prev: Column, now: Column, both: Column) -> Column:
    """What of the earlier picture's ink is in the later one, from the pixels of each and of both."""
    empty = (prev < 1.0) | (now < 1.0)
    share = lambda v, z: F.when(empty, z).otherwise(v)
    return F.struct(
        share(both / (prev + 1e-9), 0.0).alias("recall"),
        share(both / (now + 1e-9), 0.0).alias("precision"),
        share(now / (prev + 1e-9), 0.0).alias("area_ratio"),
        share(F.greatest(F.lit(0.0), now - both) / (prev + 1e-9), 0.0).alias("added"),
        share(F.greatest(F.lit(0.0), prev - both) / (prev + 1e-9), 1.0).alias("removed"),
    )


def contains_previous(m: Column, shift: Column, recall: float = 0.98, removed: float = 0.02, area: float = 0.995, most_shift: float = 10.0) -> Column:
    return (m["recall"] >= recall) & (m["removed"] <= removed) & (m["area_ratio"] >= area) & (shift <= most_shift)


def scroll_related(dx: Column, dy: Column, response: Column, overlap: Column, aligned: Column, raw: Column) -> Column:
    """One picture is the other scrolled: a clear shift, and much more alike once it is taken back."""
    return (F.greatest(F.abs(dx), F.abs(dy)) >= 10.0) & (response >= 0.05) & (overlap >= 0.65) & (aligned >= 0.90) & (aligned >= raw + 0.05)
