"""Scores, vectors and boxes: Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), end - start)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def round6(c) -> Column:
    """To six places, halves up, by plain arithmetic: other engines give the same last digit."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1000000 + 0.5) / 1000000


def hamming64(a: Column, b: Column) -> Column:
    """Bits in which two hashes of 16 hexadecimal digits differ; in halves, as 64 unsigned bits don't fit."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def content_score(sharp: Column, edge: Column, text: Column, entropy: Column) -> Column:
    return 0.40 * F.log1p(sharp) + 0.25 * edge + 0.25 * text + 0.10 * (entropy / 8.0)


def change_score(ssim_drop: Column, phash: Column, d_text: Column, d_edge: Column, use_phash: bool = True) -> Column:
    text, edge = F.least(F.lit(1.0), d_text / 0.08), F.least(F.lit(1.0), d_edge / 0.08)
    if use_phash:
        return 0.60 * ssim_drop + 0.25 * (phash / 64.0) + 0.10 * text + 0.05 * edge
    return 0.75 * ssim_drop + 0.15 * text + 0.10 * edge


def softmax(scores: Column, temperature: float = 0.35) -> Column:
    """Probabilities of an array of scores; empty stays empty."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp((s - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def renormalise(probs: Column, floor: float = 1e-9) -> Column:
    low = F.transform(probs, lambda p: F.greatest(F.lit(floor), p))
    total = F.aggregate(low, F.lit(0.0), lambda a, x: a + x)
    return F.transform(low, lambda p: p / total)


def position_ratio(center: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0.0)).otherwise(clamp(center / total, 0.0, 1.0))


def frame_time_score(t: Column, start: Column, end: Column) -> Column:
    """Triangular around the middle of a segment, with a tail of twelve seconds."""
    half = F.greatest(F.lit(12.0), (end - start) / 2)
    return F.greatest(F.lit(0.0), 1.0 - F.abs(t - (start + end) / 2) / (half + 12.0))


def information_score(n_tokens: Column, n_lines: Column) -> Column:
    return F.when(n_tokens == 0, F.lit(0.10)).otherwise(F.least(F.lit(1.0), 0.20 + n_tokens / 45.0 + n_lines / 30.0))


def frame_limit(seconds: Column, candidates: Column) -> Column:
    """How many frames a segment shows."""
    short = F.when(candidates == 0, 0).when(seconds < 90, 1)
    middle = F.when(seconds < 240, F.when(candidates <= 2, 1).otherwise(2))
    return F.coalesce(short, middle, F.when(candidates <= 4, 2).otherwise(3)).cast("int")


def section_count(seconds: Column) -> Column:
    return clamp(F.bround(seconds / 180.0, 0).cast("int") + 1, 1, 12).cast("int")


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes given as corner and size; 0 without area."""
    zero = F.lit(0.0)
    ix = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    iy = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - ix * iy
    return F.when(union > 0, ix * iy / union).otherwise(zero)


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    bound = lambda c, top: F.least(F.lit(top), F.greatest(F.lit(0), c))
    return F.struct(bound(x1, width).alias("x1"), bound(y1, height).alias("y1"), bound(x2, width).alias("x2"), bound(y2, height).alias("y2"))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y)."""
    nxt = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    terms = F.zip_with(points, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2.0


def reversed_sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(0.5 * x))


def overlap_similarity(a: Column, b: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 1e-12, dot(a, b) / n).otherwise(F.lit(0.0))
