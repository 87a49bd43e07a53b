"""Regions and surfaces of pictures. Vectors of 64 numbers stand for pictures of 8 by 8 pixels, texts for pictures of 64 pixels a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.maths import polygon_area, round6
from lectern.operators import regions as R
from lectern.plans.catalog import query, table
from lectern.plans.geometry_queries import r6

_LEVEL = 160
_GRID = """px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, i, least(255, greatest(0, floor(128 + 384 * embedding[i + 1]::DOUBLE)))::INT AS g FROM embeddings, (SELECT unnest(range(0, 64)) AS i) WHERE len(embedding) = 64),
    on_ AS (SELECT * FROM px WHERE g >= 160),
    flood(vec_id, seed, i, y, x) AS (SELECT vec_id, i, i, y, x FROM on_ UNION SELECT o.vec_id, f.seed, o.i, o.y, o.x FROM flood f JOIN on_ o ON o.vec_id = f.vec_id AND abs(o.y - f.y) <= 1 AND abs(o.x - f.x) <= 1),
    labelled AS (SELECT vec_id, i, any_value(y) AS y, any_value(x) AS x, min(seed) AS region FROM flood GROUP BY vec_id, i),
    ends AS (SELECT DISTINCT vec_id, region, y, unnest([min(x), max(x)]) AS x FROM labelled GROUP BY vec_id, region, y),
    pairs AS (SELECT a.vec_id, a.region, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, (b.x - a.x) AS dx, (b.y - a.y) AS dy FROM ends a JOIN ends b ON a.vec_id = b.vec_id AND a.region = b.region AND (a.x <> b.x OR a.y <> b.y)),
    sides AS (SELECT p.vec_id, p.region, ax, ay, bx, by_, max(c.x * dx + c.y * dy) - min(c.x * dx + c.y * dy) AS u, max(c.y * dx - c.x * dy) - min(c.y * dx - c.x * dy) AS v, dx * dx + dy * dy AS n FROM pairs p JOIN ends c ON c.vec_id = p.vec_id AND c.region = p.region GROUP BY ALL
      HAVING min(dx * (c.y - ay) - dy * (c.x - ax)) >= 0 AND bool_and(dx * (c.y - ay) - dy * (c.x - ax) <> 0 OR (dx * (c.x - ax) + dy * (c.y - ay)) BETWEEN 0 AND dx * dx + dy * dy)),
    shapes AS (SELECT vec_id, region, abs(sum(ax * by_ - bx * ay)) / 2::DOUBLE AS hull_area, min(u * v / n::DOUBLE) AS rect_area FROM sides GROUP BY ALL),
    boxes AS (SELECT vec_id, region, count(*) AS pixels, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM labelled GROUP BY ALL)"""


def grids(spark, sf):
    """(vec_id, width, pixels): the gray values of all vectors of 64 numbers."""
    gray = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 384 * e.cast("double")).cast("int"))))
    hexed = F.array_join(F.transform(gray, lambda g: F.lpad(F.hex(g), 2, "0")), "")
    return table(spark, sf, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.lit(8).alias("width"), F.unhex(hexed).alias("pixels"))


@query(
    "img_regions",
    f"""WITH RECURSIVE {_GRID} SELECT b.vec_id, b.region, b.pixels, b.x0, b.y0, b.x1, b.y1, {r6('(SELECT var_pop(g) FROM px WHERE px.vec_id = b.vec_id AND px.x BETWEEN b.x0 AND b.x1 AND px.y BETWEEN b.y0 AND b.y1)')} AS variance, {r6('coalesce(hull_area, 0)')} AS hull_area, {r6('coalesce(rect_area, 0)')} AS rect_area
    FROM boxes b LEFT JOIN shapes s ON s.vec_id = b.vec_id AND s.region = b.region""",
)
def img_regions(spark, sf):
    """Every region of bright pixels: its box, the variance in it, the areas of its hull and of its smallest rectangle."""
    found = R.picture_regions(grids(spark, sf), "vec_id", R.brighter(_LEVEL)).select("vec_id", F.explode("regions").alias("r"))
    shaped = found.withColumn("ring", R.hull(F.col("r.lines")))
    fields = [F.col(f"r.{c}").cast("long").alias(c) for c in ("region", "pixels", "x0", "y0", "x1", "y1")]
    return shaped.select("vec_id", *fields, round6(F.col("r.variance")).alias("variance"), round6(polygon_area(F.col("ring"))).alias("hull_area"), round6(R.smallest_rectangle(F.col("ring"))["area"]).alias("rect_area"))


@query("img_surfaces")
def img_surfaces(spark, sf):
    """The slide-like region of each text's picture whose quad edges support best: no SQL for edges, tested on drawn pictures and against plain versions."""
    pictures = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.lit(64).alias("width"), F.encode("text", "utf-8").alias("pixels"))
    best = R.surfaces(pictures, "doc_id")
    corners = F.transform("quad", lambda p: F.struct(round6(p.x).alias("x"), round6(p.y).alias("y")))
    return best.select("doc_id", "kind", "region", F.to_json(corners).alias("quad"), round6(F.col("score")).alias("score"), round6(F.col("fit")).alias("fit"))
