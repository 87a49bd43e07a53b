"""Exact quantiles of groups of any size, by selection in passes.

A group may hold most rows (a detector, a split, one dominant video), so its values are never brought to one task. Each
target, a rank of a group, has an interval of values that is known to hold it. A pass summarises the values in the
interval by Spark's mergeable quantile sketch, which gives two cuts close around the rank; a second pass counts the values
below, between and above the cuts, and the interval shrinks to the part that holds the rank. Counts are exact, so the sketch only decides how
fast it goes. When an interval has at most `most` values left, or one distinct value, the rank is read off.
Per-group numbers are all that is shuffled until then; a task ends up with `most` values of a target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.cut import cut, discard

#: Values that one target may bring to one task: some megabytes.
MOST = 1_000_000
#: The sketch's cuts are this share of the interval's ranks away from the target.
_NEAR = 0.002


def _with_right(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; the left side's keys stay."""
    named = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    fits = F.lit(True)
    for c in keys:
        fits = fits & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(named, fits, how).drop(*[f"_{c}" for c in keys])


def quantiles(rows: DataFrame, by: list[str], values: dict[str, Column], probabilities: tuple[float, ...] = (0.5,), most: int = MOST) -> DataFrame:
    """One row a group: each value's quantiles as an array column of doubles, interpolated between neighbours; null without values.

    Nulls are left out; NaN counts as the largest value. Null group keys are groups.
    """
    kinds = F.array(*[F.struct(F.lit(name).alias("what"), c.cast("double").alias("v")) for name, c in values.items()])
    flat = rows.select(*by, F.explode(kinds).alias("x")).select(*by, "x.what", "x.v").where("v IS NOT NULL")
    at = [*by, "what"]
    place = (F.col("n") - 1) * F.col("p")
    ranks = F.array(F.struct(F.floor(place).alias("rank"), (1 - (place - F.floor(place))).alias("share")), F.struct(F.ceil(place).alias("rank"), (place - F.floor(place)).alias("share")))
    sizes = flat.groupBy(*at).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = sizes.select("*", F.posexplode(F.array(*map(F.lit, probabilities))).alias("k", "p")).select(*at, "k", "n", "lo", "hi", F.posexplode(ranks).alias("side", "r"))
    # the values below the interval, and in it
    state = cut(asked.select(*at, "k", "side", F.col("r.share").alias("share"), F.col("r.rank").cast("long").alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("m")))
    target = [*at, "k", "side"]
    while not state.where((F.col("m") > most) & (F.col("lo") < F.col("hi"))).isEmpty():
        state = _narrowed(flat, state, at, target, most)
    inside = _inside(flat, state.where("lo < hi"), at).groupBy(*target).agg(F.array_sort(F.collect_list("v")).alias("left"))
    value = F.coalesce(F.get("left", (F.col("rank") - F.col("below")).cast("int")), F.col("lo"))
    read = _with_right(state, inside, target, "left").select(*by, "what", "k", (F.col("share") * value).alias("part"), "share")
    # a neighbour of no weight doesn't count, whatever its value
    part = F.when(F.col("share") > 0, F.col("part")).otherwise(0.0)
    found = read.groupBy(*by, "what", "k").agg(F.sum(part).alias("q"))
    listed = found.groupBy(*by, "what").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x.q).alias("q"))
    columns = [F.max(F.when(F.col("what") == name, F.col("q"))).alias(name) for name in values]
    return listed.groupBy(*by).agg(*columns) if by else listed.agg(*columns)


def _inside(flat: DataFrame, state: DataFrame, at: list[str], *more: str) -> DataFrame:
    """Values with the targets whose intervals hold them. Targets are few a group; Spark broadcasts them where they are small."""
    own = state.select(*at, "k", "side", "lo", "hi", *more)
    return _with_right(flat, own, at).where("v >= lo AND v <= hi").select(*at, "k", "side", "v", *more)


def _narrowed(flat: DataFrame, state: DataFrame, at: list[str], target: list[str], most: int) -> DataFrame:
    open_ = state.where((F.col("m") > most) & (F.col("lo") < F.col("hi")))
    near = (F.col("rank") - F.col("below") + 0.5) / F.col("m")
    # the sketch's percentages must be constants, so the cuts come from its whole grid and each target picks its two
    grid = F.percentile_approx("v", [i / 256 for i in range(257)], 4096)
    sketch = _inside(flat, open_, at).groupBy(*target).agg(grid.alias("grid"))
    low, high = F.greatest(F.floor((near - _NEAR) * 256), F.lit(0)), F.least(F.ceil((near + _NEAR) * 256), F.lit(256))
    cuts = cut(_with_right(open_, sketch, target).select(*target, "share", "rank", "lo", "hi", "below", "m", F.get("grid", low.cast("int")).alias("c1"), F.get("grid", high.cast("int")).alias("c2")))
    v = F.col("v")
    counts = (
        _inside(flat, cuts, at, "c1", "c2")
        .groupBy(*target)
        .agg(
            F.count_if(v < F.col("c1")).alias("under"), F.count_if((v >= F.col("c1")) & (v <= F.col("c2"))).alias("between"),
            F.max(F.when(v < F.col("c1"), v)).alias("under_hi"), F.min(F.when(v > F.col("c2"), v)).alias("over_lo"),
            F.min(F.when((v >= F.col("c1")) & (v <= F.col("c2")), v)).alias("mid_lo"), F.max(F.when((v >= F.col("c1")) & (v <= F.col("c2")), v)).alias("mid_hi"),
        )
    )
    both = _with_right(cuts, counts, target)
    left = F.col("rank") - F.col("below")
    low_part, mid_part = left < F.col("under"), left < F.col("under") + F.col("between")
    pick = lambda a, b, c: F.when(low_part, a).when(mid_part, b).otherwise(c)
    moved = both.select(
        *target, "share", "rank",
        pick(F.col("lo"), F.col("mid_lo"), F.col("over_lo")).alias("lo"), pick(F.col("under_hi"), F.col("mid_hi"), F.col("hi")).alias("hi"),
        pick(F.col("below"), F.col("below") + F.col("under"), F.col("below") + F.col("under") + F.col("between")).alias("below"),
        pick(F.col("under"), F.col("between"), F.col("m") - F.col("under") - F.col("between")).alias("m"),
    )
    out = cut(moved.union(state.where((F.col("m") <= most) | (F.col("lo") >= F.col("hi"))).select(*moved.columns)))
    discard(state, cuts)
    return out
