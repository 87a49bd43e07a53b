"""Regions, their shapes and surfaces, on drawn pictures and against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import images as I
from lectern.functions.maths import polygon_area
from lectern.operators import regions as R

H, W = 90, 120
QUADS = {
    1: [(20, 15), (100, 15), (100, 65), (20, 65)],  # upright
    2: [(35, 8), (105, 30), (90, 78), (20, 56)],  # turned
    3: [(25, 20), (95, 10), (105, 75), (15, 62)],  # in perspective
}


def drawn(quad, back=30, front=210):
    y, x = np.mgrid[:H, :W]
    inside = np.ones((H, W), bool)
    for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1]):
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    return np.where(inside, front, back).astype(np.uint8)


def pictures(spark, rows):
    return spark.createDataFrame([(k, W, None if g is None else bytearray(g.tobytes())) for k, g in rows], "id long, width int, pixels binary")


def test_surfaces_of_drawn_quads(spark):
    rows = [(k, drawn(q)) for k, q in QUADS.items()] + [(k + 10, drawn(q, 220, 20)) for k, q in QUADS.items()]
    got = {r["id"]: r for r in R.surfaces(pictures(spark, rows), "id").collect()}
    assert len(got) == 6
    for k, q in QUADS.items():
        for key, kind in ((k, "light"), (k + 10, "dark")):
            assert got[key]["kind"] == kind
            found = np.array([[p["x"], p["y"]] for p in got[key]["quad"]])
            for corner in q:
                assert np.hypot(*(found - corner).T).min() <= 1.5, (key, found)


def test_edges_decide_between_surfaces(spark):
    """Two bright regions alike in size and shape: the one with straight sides has the better fit than one that only its rectangle frames."""
    g = np.full((H, W), 20, np.uint8)
    g[5:40, 5:55] = 230
    y, x = np.mgrid[:H, :W]
    g[((x - 85) / 27.0) ** 2 + ((y - 60) / 20.0) ** 2 <= 1] = 230
    (r,) = R.surfaces(pictures(spark, [(1, g)]), "id").collect()
    assert {(p["x"], p["y"]) for p in r["quad"]} == {(5, 5), (54, 5), (54, 39), (5, 39)}


def test_pictures_without_regions(spark):
    flat = np.full((H, W), 77, np.uint8)
    rows = [(1, None), (2, np.zeros(0, np.uint8)), (None, flat), (4, drawn(QUADS[1])), (4, drawn(QUADS[1]))]
    got = R.surfaces(pictures(spark, rows), "id").collect()
    assert len(got) == 5
    assert [r["fit"] is not None for r in sorted(got, key=lambda r: (r["id"] is None, r["id"]))] == [False, False, True, True, False]
    assert R.surfaces(pictures(spark, []), "id").collect() == []
    assert R.picture_regions(pictures(spark, rows), "id", R.brighter(255)).where(F.size("regions") > 0).count() == 0


def _flooded(mask):
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}, []
    while left:
        todo, part = [left.pop()], []
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(sorted(part))
    return sorted(out)


def _plain_hull(points):
    points = sorted(set(points))
    if len(points) < 3:
        return points
    out = []
    for way in (points, points[::-1]):
        part = []
        for p in way:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]) <= 0:
                part.pop()
            part.append(p)
        out += part[:-1]
    return out


def _plain_rectangle(points):
    ring, best = _plain_hull(points), 0.0 if len(set(points)) < 2 else np.inf
    for a, b in zip(ring, ring[1:] + ring[:1]):
        e = np.subtract(b, a)
        if e.any():
            p = np.array(ring)
            u, v = p @ e, p @ np.array([-e[1], e[0]])
            best = min(best, np.ptp(u) * np.ptp(v) / (e @ e))
    return best


@pytest.mark.parametrize("seed,share", [(1, 0.1), (2, 0.35), (3, 0.6)])
def test_regions_against_flood_fill(spark, seed, share):
    g = (np.random.default_rng(seed).random((H, W)) < share).astype(np.uint8) * 200
    r = R.picture_regions(pictures(spark, [(1, g)]), "id", R.brighter(100)).select(F.explode("regions").alias("r"))
    r = r.withColumn("ring", R.hull(F.col("r.lines")))
    got = r.select("r.region", "r.pixels", "r.x0", "r.y0", "r.x1", "r.y1", "r.variance", polygon_area(F.col("ring")).alias("hull"), R.smallest_rectangle(F.col("ring"))["area"].alias("rect"), F.size("ring").alias("corners")).orderBy("region").collect()
    want = _flooded(g > 100)
    assert len(got) == len(want)
    for a, part in zip(got, want):
        ys, xs = [p[0] for p in part], [p[1] for p in part]
        assert tuple(a[:6]) == (part[0][0] * W + part[0][1], len(part), min(xs), min(ys), max(xs), max(ys))
        assert a["variance"] == pytest.approx(g[min(ys) : max(ys) + 1, min(xs) : max(xs) + 1].astype(float).var())
        ring = _plain_hull([(x, y) for y, x in part])
        assert a["corners"] == len(ring)
        x, y = np.array(ring).T
        assert a["hull"] == pytest.approx(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)
        assert a["rect"] == pytest.approx(_plain_rectangle([(x, y) for y, x in part]))


def test_distances_against_all_pairs():
    rng = np.random.default_rng(5)
    for share in (0.002, 0.02, 0.3):
        mask = rng.random((40, 57)) < share
        mask[3, 50] = True
        y, x = np.mgrid[:40, :57]
        at = np.argwhere(mask)
        want = np.sqrt(((y[..., None] - at[:, 0]) ** 2 + (x[..., None] - at[:, 1]) ** 2).min(-1))
        assert np.allclose(I.away_from(mask), want)
    assert np.isinf(I.away_from(np.zeros((4, 5), bool))).all()


def test_a_circle_keeps_more_than_four_corners(spark):
    y, x = np.mgrid[:H, :W]
    g = ((x - 60) ** 2 + (y - 45) ** 2 <= 40**2).astype(np.uint8) * 255
    r = R.picture_regions(pictures(spark, [(1, g)]), "id", R.brighter(100)).select(R.hull(F.element_at("regions", 1)["lines"]).alias("ring"))
    r = r.select(F.size(R.simplified(F.col("ring"), 0.02 * R.perimeter(F.col("ring")))).alias("n"), R.region_quad(F.col("ring"), R.smallest_rectangle(F.col("ring"))["corners"])["simple"].alias("simple")).first()
    assert r["n"] > 4 and not r["simple"]
