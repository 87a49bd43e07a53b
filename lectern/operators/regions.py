"""Regions of gray pictures, their shapes, and the quad of a bright or dark surface that edges support best.

A picture is a row (key, width, pixels), see `functions.images`. One pass without a shuffle labels its pixels and gives, line by line, how far each
region reaches; hulls, smallest rectangles, quads and scores are Columns over those lines. So a picture is one row all the way, and pictures go where
Spark has dealt them.

Nulls: pictures without pixels (null or empty) have no regions. Equal rows are pictures of their own. A region's number is the smallest place in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import images as I
from lectern.functions.maths import polygon_area
from lectern.functions.text import bound

REGION = "struct<kind:string,region:long,pixels:long,x0:int,y0:int,x1:int,y1:int,variance:double,lines:array<struct<y:int,x0:int,x1:int>>>"

# Limits and weights of a region's score, the tolerance of a quad, weights of a quad's score.
LEAST_SHARE, MOST_SHARE, ASPECT_TOLERANCE = 0.08, 0.98, 0.35
AREA_WEIGHT, FILL_WEIGHT, ASPECT_WEIGHT, VARIANCE_WEIGHT, QUAD_BONUS = 2.5, 1.5, 1.0, 0.15, 0.15
SIMPLE = 0.02
SUPPORT_WEIGHT, SIZE_WEIGHT, OUTSIDE_WEIGHT, LEAST_QUAD, MOST_SIDES, SIDES_LOSS = 25.0, 2.0, 8.0, 0.05, 12.0, 1000.0

#: Pixels whose regions a task holds before it passes them on (a larger picture is held alone).
PIXELS = 1_000_000

Mark = Callable[[np.ndarray], Iterable[tuple[str, np.ndarray]]]


def brighter(level: int) -> Mark:
    return lambda gray: [("light", gray >= level)]


def light_and_dark(gray: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """What is above the gray value that parts the picture best, and what is not."""
    above = gray > I.best_threshold(gray)
    return [("light", above), ("dark", ~above)]


def _reach(gray: np.ndarray, mask: np.ndarray, least: float) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Of each region whose box has the least share of the picture: its fields, how many lines it has, and all lines' (y, x0, x1)."""
    y, start, end, region = I.runs(mask)
    if not len(y):
        return [np.zeros(0, np.int64)] * 7, np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 3
    place = y * gray.shape[1] + start
    order = np.argsort(region, kind="stable")
    region, y, start, end = region[order], y[order], start[order], end[order]
    line = np.flatnonzero(np.append(True, (region[1:] != region[:-1]) | (y[1:] != y[:-1])))
    last = np.append(line[1:], len(y)) - 1
    first = np.flatnonzero(np.append(True, region[line][1:] != region[line][:-1]))
    n_lines, n = np.diff(np.append(first, len(line))), np.add.reduceat(end - start + 1, line[first])
    x0, x1 = np.minimum.reduceat(start[line], first), np.maximum.reduceat(end[last], first)
    y0, y1 = y[line[first]], y[line[first + n_lines - 1]]
    large = (x1 - x0 + 1) * (y1 - y0 + 1) >= least * gray.size
    own = np.repeat(large, n_lines)
    fields = [c[large] for c in (place[region[line[first]]], n, x0, y0, x1, y1)]
    return [*fields, I.box_variances(gray, *fields[2:]) if large.any() else np.zeros(0)], n_lines[large], [y[line][own], start[line][own], end[last][own]]


_LINE = pa.struct([("y", pa.int32()), ("x0", pa.int32()), ("x1", pa.int32())])


def _listed(counts: Iterable[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values)


def picture_regions(pictures: DataFrame, key: str, mark: Mark = light_and_dark, least: float = 0.0) -> DataFrame:
    """(key, width, height, pixels, regions) of each picture: all regions of the pixels that `mark` gives, kind by kind, whose boxes have the least share of it."""

    def found(gray: np.ndarray) -> list[tuple]:
        return [(kind, *_reach(gray, mask, least)) for kind, mask in (mark(gray) if gray.size else [])]

    def packed(batch: pa.RecordBatch, heights: list[int], regions: list[list[tuple]]) -> pa.RecordBatch:
        parts = [part for picture in regions for part in picture]
        joined = lambda i, j, kind: pa.array(np.concatenate([np.zeros(0), *(p[i][j] for p in parts)]), kind)
        lines = pa.StructArray.from_arrays([joined(3, j, pa.int32()) for j in range(3)], fields=list(_LINE))
        n_lines = np.concatenate([np.zeros(0, np.int64), *(p[2] for p in parts)])
        kinds = pa.array([p[0] for p in parts for _ in range(len(p[2]))], pa.string())
        columns = [kinds, *(joined(1, j, t) for j, t in enumerate([pa.int64()] * 2 + [pa.int32()] * 4 + [pa.float64()])), _listed(n_lines, lines)]
        rows = pa.StructArray.from_arrays(columns, names=["kind", "region", "pixels", "x0", "y0", "x1", "y1", "variance", "lines"])
        of = _listed([sum(len(p[2]) for p in picture) for picture in regions], rows)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heights, pa.int32()), batch.column(2), of], names=[key, "width", "height", "pixels", "regions"])

    def run(batches):
        for batch in batches:
            begin, heights, regions, held = 0, [], [], 0
            for i in range(batch.num_rows):
                w, data = batch.column(1)[i].as_py(), batch.column(2)[i]
                data = b"" if not data.is_valid else data.as_buffer()
                gray = I.pixels(w, data) if len(data) else np.zeros((0, w), np.uint8)
                heights.append(gray.shape[0])
                regions.append(found(gray))
                held += gray.size
                if held >= PIXELS:
                    yield packed(batch.slice(begin, i + 1 - begin), heights, regions)
                    begin, heights, regions, held = i + 1, [], [], 0
            if heights:
                yield packed(batch.slice(begin), heights, regions)

    kind = dict(pictures.select(key).dtypes)[key]
    return pictures.select(key, F.col("width").cast("int").alias("width"), F.col("pixels").cast("binary").alias("pixels")).mapInArrow(run, f"`{key}` {kind}, width int, height int, pixels binary, regions array<{REGION}>")


# --- shapes, from a region's lines ---------------------------------------------------------


def _cross(a: Column, b: Column, c: Column) -> Column:
    return (b.x - a.x) * (c.y - b.y) - (b.y - a.y) * (c.x - b.x)


def _chain(points: Column, turn: int) -> Column:
    """Of points from top to bottom those where a tight band around one side bends: points that the next one makes needless go."""

    def add(kept: Column, p: Column) -> Column:
        bends = F.filter(F.sequence(F.lit(2), F.size(kept)), lambda k: turn * _cross(F.get(kept, k - 2), F.get(kept, k - 1), p) > 0)
        # a chain bends one way only, so all up to the last bend that p leaves stay
        upto = F.when(F.size(kept) < 2, F.size(kept)).otherwise(F.coalesce(F.array_max(bends), F.lit(1)))
        return F.concat(F.slice(kept, 1, upto), F.array(p))

    return F.aggregate(points, F.slice(points, 1, 0), add)


def hull(lines: Column) -> Column:
    """The corners of the convex hull of pixel centres, from the top right one on, around the region."""
    side = lambda x: F.transform(lines, lambda r: G.point(r[x], r.y))
    return F.array_distinct(F.concat(_chain(side("x1"), 1), F.reverse(_chain(side("x0"), -1))))


def smallest_rectangle(ring: Column) -> Column:
    """(area, a, b, corners) of the smallest rectangle around a hull, which has a side along one of the hull's; zero for one point."""
    one = lambda p, q: F.struct((q.x - p.x).alias("x"), (q.y - p.y).alias("y"))

    def along(e: Column, i: Column) -> Column:
        u, v = F.transform(ring, lambda p: p.x * e.x + p.y * e.y), F.transform(ring, lambda p: p.y * e.x - p.x * e.y)
        n = e.x * e.x + e.y * e.y

        def held(r: Column) -> Column:
            corner = lambda s, t: G.point((s * e.x - t * e.y) / n, (s * e.y + t * e.x) / n)
            a, b = (r.u1 - r.u0) / F.sqrt(n), (r.v1 - r.v0) / F.sqrt(n)
            return F.struct(((r.u1 - r.u0) * (r.v1 - r.v0) / n).alias("area"), i.alias("side"), a.alias("a"), b.alias("b"), F.array(corner(r.u0, r.v0), corner(r.u1, r.v0), corner(r.u1, r.v1), corner(r.u0, r.v1)).alias("corners"))

        return bound(F.struct(F.array_min(u).alias("u0"), F.array_max(u).alias("u1"), F.array_min(v).alias("v0"), F.array_max(v).alias("v1")), held)

    sides = F.transform(ring, lambda p, i: one(p, F.get(ring, (i + 1) % F.size(ring))))
    point = F.transform(ring, lambda p, i: F.struct(F.lit(0.0).alias("area"), i.alias("side"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.array(p, p, p, p).alias("corners")))
    return F.when(F.size(ring) < 2, F.get(point, F.lit(0))).otherwise(F.array_min(bound(sides, lambda s: F.transform(s, along))))


def _length(p: Column, q: Column) -> Column:
    return F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))


def perimeter(ring: Column) -> Column:
    return F.aggregate(F.transform(ring, lambda p, i: _length(p, F.get(ring, (i + 1) % F.size(ring)))), F.lit(0.0), lambda s, v: s + v)


def simplified(ring: Column, tolerance: Column) -> Column:
    """The ring without corners that lie within the tolerance of the line through their neighbours; the least one goes first, four stay."""

    def off(r: Column, p: Column, i: Column) -> Column:
        a, c = F.get(r, (i + F.size(r) - 1) % F.size(r)), F.get(r, (i + 1) % F.size(r))
        return F.abs(_cross(a, p, c)) / F.greatest(_length(a, c), F.lit(1e-9))

    def step(r: Column, _: Column) -> Column:
        def drop(d: Column) -> Column:
            least = F.array_min(d)
            first = F.array_position(d, least).cast("int") - 1
            return F.when((F.size(r) > 4) & (least <= tolerance), F.filter(r, lambda p, i: i != first)).otherwise(r)

        return bound(F.transform(r, lambda p, i: off(r, p, i)), drop)

    rounds = F.when(F.size(ring) > 4, F.sequence(F.lit(1), F.size(ring) - 4)).otherwise(F.slice(F.sequence(F.lit(1), F.lit(1)), 1, 0))
    return F.aggregate(rounds, ring, step)


def region_quad(ring: Column, rectangle: Column) -> Column:
    """(quad, simple): the hull's four corners if it simplifies to a convex quad, else those of its smallest rectangle; null for less than three corners."""
    few = bound(simplified(ring, SIMPLE * perimeter(ring)), lambda r: F.when((F.size(r) == 4) & G.is_convex(r), r))
    made = bound(few, lambda r: F.struct(G.order_quad(F.coalesce(r, rectangle)).alias("quad"), r.isNotNull().alias("simple")))
    return F.when(F.size(ring) >= 3, made)


def region_score(r: Column, width: Column, height: Column, fill: Column, simple: Column) -> Column:
    """How much a region's box looks like a slide; null if its size or shape rules that out."""
    w, h = (r["x1"] - r["x0"] + 1).cast("double"), (r["y1"] - r["y0"] + 1).cast("double")
    share = w * h / (width * height)
    off = F.least(*[F.abs(w / h - a) / a for a in G.ASPECTS])
    score = AREA_WEIGHT * share + FILL_WEIGHT * fill + ASPECT_WEIGHT * (1.0 - off) + VARIANCE_WEIGHT * F.least(r["variance"] / 255.0, F.lit(1.0)) + F.when(simple, QUAD_BONUS).otherwise(0.0)
    return F.when(share.between(LEAST_SHARE, MOST_SHARE) & (off <= ASPECT_TOLERANCE), score)


def surfaces(pictures: DataFrame, key: str, mark: Mark = light_and_dark) -> DataFrame:
    """(key, kind, region, quad, score, fit) of pictures: of all regions like a slide the one whose quad edges support best; nulls if none is.

    A quad's fit is its size, less the distance of its sides from edges, less what lies outside and sides too unlike; ties: the first by kind and region.
    """
    found = picture_regions(pictures, key, mark, LEAST_SHARE)
    # a region's hull, rectangle and quad are computed once each
    ringed = F.transform("regions", lambda r: F.struct(r.alias("r"), hull(r["lines"]).alias("ring")))
    framed = lambda s: F.struct(s["r"].alias("r"), s["ring"].alias("ring"), region_quad(s["ring"], smallest_rectangle(s["ring"])["corners"]).alias("q"))

    def candidate(s: Column) -> Column:
        r = s["r"]
        box = ((r["x1"] - r["x0"]) * (r["y1"] - r["y0"])).cast("double")
        fill = polygon_area(s["ring"]) / F.greatest(box, F.lit(1.0))
        return F.struct(r["kind"].alias("kind"), r["region"].alias("region"), s["q"]["quad"].alias("quad"), region_score(r, F.col("width"), F.col("height"), fill, s["q"]["simple"]).alias("score"))

    rows = found.withColumn("c", ringed).withColumn("c", F.transform("c", framed)).withColumn("c", F.filter(F.transform("c", candidate), lambda c: c["score"].isNotNull() & c["quad"].isNotNull()))
    # pictures without candidates needn't travel again
    held = _supported(rows.select(key, "width", "height", F.when(F.size("c") > 0, F.col("pixels")).alias("pixels"), "c"), key)
    fit = F.transform(F.arrays_zip("c", "off"), lambda z: F.struct((-quad_fit(z["c"]["quad"], z["off"], F.col("width"), F.col("height"))).alias("loss"), *[z["c"][n].alias(n) for n in ("kind", "region", "quad", "score")]))
    best = held.withColumn("b", F.array_min(F.filter(fit, lambda x: x["loss"].isNotNull())))
    return best.select(key, *[F.col("b")[n].alias(n) for n in ("kind", "region", "quad", "score")], (-F.col("b")["loss"]).alias("fit"))


def _supported(rows: DataFrame, key: str) -> DataFrame:
    """(key, width, height, c, off): off has the sum over the sides of each candidate's quad of their distance from edges."""
    kind = dict(rows.dtypes)

    def run(parts):
        for pdf in parts:
            off = []
            for w, data, candidates in zip(pdf["width"], pdf["pixels"], pdf["c"]):
                if candidates is None or not len(candidates):
                    off.append([])
                    continue
                far = I.away_from(I.edges(I.blurred(I.pixels(int(w), bytes(data)))))
                far = np.minimum(far, sum(far.shape))  # a picture without edges: everything is as far as can be
                off.append([sum(I.support(far, np.array([[p["x"], p["y"]] for p in c["quad"]]))) for c in candidates])
            yield pdf.drop(columns="pixels").assign(off=off)

    return rows.mapInPandas(run, ", ".join(f"`{c}` {kind[c]}" for c in (key, "width", "height", "c")) + ", off array<double>")


def quad_fit(quad: Column, off: Column, width: Column, height: Column) -> Column:
    """The score of a quad: null if it isn't convex or is too small."""
    outside = lambda p: F.greatest(-p.x, F.lit(0.0)) + F.greatest(p.x - (width - 1), F.lit(0.0)) + F.greatest(-p.y, F.lit(0.0)) + F.greatest(p.y - (height - 1), F.lit(0.0))
    out = F.aggregate(F.transform(quad, outside), F.lit(0.0), lambda s, v: s + v) / 4.0
    sides = F.transform(quad, lambda p, i: _length(p, F.get(quad, (i + 1) % 4)))
    unlike = bound(sides, lambda s: F.array_max(s) / (F.array_min(s) + 1e-6) > MOST_SIDES)
    area = polygon_area(quad)
    fit = SIZE_WEIGHT * F.sqrt(F.greatest(area, F.lit(1.0))) - SUPPORT_WEIGHT * off - OUTSIDE_WEIGHT * out - F.when(unlike, SIDES_LOSS).otherwise(0.0)
    return F.when(G.is_convex(quad) & (area >= LEAST_QUAD * width * height), fit)
