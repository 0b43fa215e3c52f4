"""Neighbours within a radius: sample and approximate entropy, recurrence, by joins on grid cells.

A series is rows (key, i, x). Its templates of m values in a row are points; every point is
hashed to the cell of a grid whose cells are as wide as the radius, so neighbours lie in the same
or in adjacent cells, and an equi-join on cells finds them. Pairs are counted where they are
found; no matrix of all pairs exists. Keys must not have the names i, j, v, n, a or b.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisonde.operators.ranks import cuts_of, ordered


def embedded(series: DataFrame, by: Sequence[str], at: str, x: str, m: int) -> DataFrame:
    """(by, i, v, n): templates of m values in a row, numbered from 0, with the series' length; the last m - 1 places have none."""
    cuts = cuts_of(series, at)
    out = ordered(series.select(*by, at, F.col(x).alias("x0")), by, [at], number="i", size="n", after={"x1": "x0"}, cuts=cuts)
    for k in range(2, m):
        out = ordered(out, by, [at], after={f"x{k}": f"x{k - 1}"}, cuts=cuts)
    names = [f"x{k}" for k in range(m)]
    whole = F.col("i") <= F.col("n") - m + 1
    return out.where(whole).select(*by, (F.col("i") - 1).alias("i"), F.array(*names).alias("v"), "n")


def pairs(points: DataFrame, by: Sequence[str], m: int, radius: Column, metric: str = "max", strict: bool = False) -> DataFrame:
    """(by, i, j) with i < j, and both points' other columns as a and b: all pairs of a series' points (i, v, ...) within its radius.

    metric is max or euclid. A radius of 0 finds equal points. A point asks its own cell for points of larger number, and the cells on one side of it, half of those around, for all.
    """
    wide = F.when(radius > 0, radius).otherwise(F.lit(1.0))
    cell = lambda v, k: F.floor(F.get(v, F.lit(k)) / F.col("r_")).cast("bigint")
    # cells along two values are enough to be selective; more would only multiply the cells asked for
    dims = min(m, 2)
    rest = F.struct(*[c for c in points.columns if c not in (*by, "i")])
    cells = points.withColumn("r_", wide).withColumn("radius_", radius)
    cells = cells.select(*by, "i", rest.alias("p"), F.array(*[cell("v", k) for k in range(dims)]).alias("c"), "radius_")
    # itself and the cells on one side: of two cells side by side only one asks the other
    steps = [[0], [1]] if dims == 1 else [[0, 0], [0, 1], [1, -1], [1, 0], [1, 1]]
    step = lambda k, s: F.struct(F.lit(k > 0).alias("other"), F.zip_with("c", F.array(*map(F.lit, s)), lambda u, d: u + d).alias("c"))
    asked = cells.select(*by, "i", F.col("p").alias("a"), "radius_", F.explode(F.array(*[step(k, s) for k, s in enumerate(steps)])).alias("s"))
    asked = asked.select(*by, "i", "a", "radius_", F.col("s.other").alias("other_"), F.col("s.c").alias("c"))
    there = cells.select(*by, F.col("i").alias("j"), F.col("p").alias("b"), "c")
    off = F.zip_with("a.v", "b.v", lambda u, w: F.abs(u - w))
    far = F.array_max(off) if metric == "max" else F.sqrt(F.aggregate(off, F.lit(0.0), lambda s, d: s + d * d))
    near = far < F.col("radius_") if strict else far <= F.col("radius_")
    found = asked.join(there, [*by, "c"]).where((F.col("other_") | (F.col("i") < F.col("j"))) & near)
    first = F.col("i") < F.col("j")
    swapped = lambda u, v: F.when(first, F.col(u)).otherwise(F.col(v)).alias(u)
    return found.select(*by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), swapped("a", "b"), swapped("b", "a"), "radius_")


def _with_radius(series: DataFrame, by: Sequence[str], x: str, r: float) -> DataFrame:
    return series.groupBy(*by).agg((F.lit(r) * F.stddev_pop(x)).alias("radius"))


def sample_entropy(series: DataFrame, by: Sequence[str], at: str, x: str, m: int = 2, r: float = 0.2) -> DataFrame:
    """(by, a, b, sample_entropy): pairs of templates of m and of m + 1 values within r deviations, and -ln(b / a); infinite where either is 0, NaN for fewer than m + 2 values."""
    from functools import reduce

    keys = list(by)
    longer = embedded(series, keys, at, x, m + 1).select(*keys, "i", F.get("v", F.lit(m)).alias("next"))
    points = embedded(series, keys, at, x, m).join(longer, [*keys, "i"], "left").join(_with_radius(series, keys, x, r), keys)
    found = pairs(points, keys, m, F.col("radius"))
    also = F.coalesce(F.abs(F.col("a.next") - F.col("b.next")) <= F.col("radius_"), F.lit(False))
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"), F.count_if(also).alias("b"))
    whole = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(counts, keys, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("a", "b")})
    none = reduce(lambda u, v: u | v, [F.col("a") == 0, F.col("b") == 0])
    value = F.when(F.col("n") < m + 2, float("nan")).when(none, float("inf")).otherwise(-F.log(F.col("b") / F.col("a")))
    return whole.select(*keys, "a", "b", value.alias("sample_entropy"))


def approximate_entropy(series: DataFrame, by: Sequence[str], at: str, x: str, m: int = 2, r: float = 0.2) -> DataFrame:
    """(by, approximate_entropy): mean log share of a template's neighbours (itself included) at m values, less that at m + 1."""
    keys = list(by)

    def phi(k: int) -> DataFrame:
        points = embedded(series, keys, at, x, k).join(_with_radius(series, keys, x, r), keys)
        found = pairs(points, keys, k, F.col("radius"))
        ends = found.select(*keys, F.explode(F.array("i", "j")).alias("i")).groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("c"))
        each = points.select(*keys, "i", (F.col("n") - k + 1).alias("t")).join(ends, [*keys, "i"], "left")
        return each.groupBy(*keys).agg(F.avg(F.log((F.coalesce("c", F.lit(0)) + 1) / F.col("t"))).alias(f"phi{k}"))

    return phi(m).join(phi(m + 1), keys).select(*keys, (F.col(f"phi{m}") - F.col(f"phi{m + 1}")).alias("approximate_entropy"))


def recurrence(series: DataFrame, by: Sequence[str], at: str, x: str, m: int = 3, r: float = 0.1, least: int = 2) -> DataFrame:
    """Per series: the share of pairs of templates closer than r deviations (each with itself included, as rows and columns of a matrix), the shares of these on diagonal and on vertical lines of a least length, and mean and largest diagonal.

    Diagonals are islands of i within one j - i, verticals islands of i within one j; either are found in rows of pairs.
    """
    keys = list(by)
    points = embedded(series, keys, at, x, m).join(_with_radius(series, keys, x, r), keys)
    found = pairs(points, keys, m, F.col("radius"), "euclid", strict=True).select(*keys, "i", "j")
    size = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.max("radius").alias("radius"))
    # above the diagonal; below it there are as many of everything, and the diagonal itself is one line
    off = (F.col("j") - F.col("i")).alias("off_")
    line = F.row_number().over(Window.partitionBy(*keys, "off_").orderBy("i"))  # at most as many rows as a series has
    lines = found.select(*keys, "i", off).withColumn("isle_", F.col("i") - line).groupBy(*keys, "off_", "isle_").agg(F.count(F.lit(1)).alias("len_")).where(F.col("len_") >= least)
    diagonal = lines.groupBy(*keys).agg(F.sum("len_").alias("on"), F.count(F.lit(1)).alias("lines"), F.max("len_").alias("longest"))
    own = points.where("radius > 0").select(*keys, "i", F.col("i").alias("j"))
    every = found.unionByName(found.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))).unionByName(own)
    run = F.row_number().over(Window.partitionBy(*keys, "j").orderBy("i"))
    upright = every.withColumn("isle_", F.col("i") - run).groupBy(*keys, "j", "isle_").agg(F.count(F.lit(1)).alias("len_"))
    upright = upright.groupBy(*keys).agg(F.sum("len_").alias("points"), F.sum(F.when(F.col("len_") >= least, F.col("len_")).otherwise(0)).alias("vertical"))
    out = size.join(diagonal, keys, "left").join(upright, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    main = (F.col("radius") > 0) & (F.col("size") >= least)  # the diagonal itself
    on, count = 2 * zero("on") + F.when(main, F.col("size")).otherwise(0), 2 * zero("lines") + main.cast("int")
    share = lambda u, v: F.when(v > 0, u / v).otherwise(0.0)
    return out.select(
        *keys, (zero("points") / (F.col("size") * F.col("size"))).alias("recurrence_rate"), share(on, zero("points")).alias("determinism"), share(zero("vertical"), zero("points")).alias("laminarity"),
        share(on, count).alias("mean_diagonal"), F.greatest(zero("longest"), F.when(main, F.col("size")).otherwise(0)).cast("bigint").alias("longest_diagonal"),
    )


def correlation_dimension(series: DataFrame, by: Sequence[str], at: str, x: str, m: int = 3, low: float = 0.1, high: float = 1.0, count: int = 10) -> DataFrame:
    """(by, pairs, dimension): the slope of the log share of pairs of templates within a radius over its log, for radii from low to high deviations evenly spaced by logarithm; 0 for a constant series, null where fewer than two radii have pairs.

    Pairs are found once, at the largest radius, and counted by the smallest that holds them.
    """
    keys = list(by)
    points = embedded(series, keys, at, x, m).join(_with_radius(series, keys, x, high), keys)
    found = pairs(points, keys, m, F.col("radius"), "euclid")
    far = F.sqrt(F.aggregate(F.zip_with("a.v", "b.v", lambda u, w: u - w), F.lit(0.0), lambda s, d: s + d * d))
    radii = [low * (high / low) ** (k / (count - 1)) for k in range(count)]
    # at radius k: pairs within it
    within = [F.count_if(far <= F.col("radius_") * (r / high)).alias(f"c{k}_") for k, r in enumerate(radii)]
    counts = found.where("radius_ > 0").groupBy(*keys).agg(*within, F.count(F.lit(1)).alias("pairs"))
    rows = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("r"), F.col(f"c{k}_").alias("c")) for k, r in enumerate(radii)])).alias("p")
    slopes = counts.select(*keys, "pairs", rows).where("p.c > 0").groupBy(*keys, "pairs").agg(F.regr_slope(F.log("p.c"), F.log("p.r")).alias("dimension"))
    flat = _with_radius(series, keys, x, 1.0).select(*keys, (F.coalesce(F.col("radius"), F.lit(0.0)) == 0).alias("flat_"))
    out = flat.join(slopes, keys, "left")
    return out.select(*keys, F.coalesce("pairs", F.lit(0)).alias("pairs"), F.when(F.col("flat_"), 0.0).otherwise(F.col("dimension")).alias("dimension"))
