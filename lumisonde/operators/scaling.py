"""How fluctuations of series grow with scale: fractal dimension, rescaled range, detrended fluctuation.

A series is rows (key, i, x), i from 0. Every scale of a series is a group of rows, every segment of a scale
a smaller one; exponents are slopes over the few scales of a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of series that a task gets, if series are shorter.
ROWS = 50_000


def series_of(clips: DataFrame, key: str, x: str) -> DataFrame:
    """(key, i, x) of an array column.

    Clips are dealt by key before they become rows, into as many parts as leave about ``ROWS`` rows in one (this takes a pass over the lengths): what is done by key then needs no further
    shuffle, and a task's rows do not grow with the table. Left to itself Spark would join the parts again, as they are small until rows come of them.
    """
    rows = clips.agg(F.sum(F.size(x).cast("long")).alias("n")).first()["n"] or 0
    parts = max(clips.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))
    return clips.select(key, x).repartition(parts, key).select(key, F.posexplode(x).alias("i", "x"))


def _sized(series: DataFrame, by: Sequence[str]) -> DataFrame:
    return series.join(series.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"), F.avg("x").alias("mean_")), list(by))


def _scales(least: int, most: Column, count: int) -> Column:
    """Whole numbers evenly spaced by their logarithms."""
    step = (F.log10(most) - math.log10(least)) / (count - 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.floor(F.pow(F.lit(10.0), math.log10(least) + k * step) + 1e-9)))


def higuchi(series: DataFrame, by: Sequence[str], most: int = 6) -> DataFrame:
    """(by, higuchi): minus the slope of log curve length over log scale, for scales up to most or a tenth of the length."""
    order = Window.partitionBy(*by).orderBy("i")
    each = _sized(series, by).withColumn("jumps_", F.array(*[F.struct(F.lit(k).alias("k"), F.abs(F.col("x") - F.lag("x", k).over(order)).alias("d")) for k in range(1, most + 1)]))
    each = each.select(*by, "i", "n_", F.explode("jumps_").alias("j")).where(F.col("j.d").isNotNull() & (F.col("j.k") <= F.greatest(F.lit(2), F.least(F.lit(most), F.floor(F.col("n_") / 10)))))
    k = F.col("k")
    start = each.select(*by, "i", "n_", "j.k", "j.d").groupBy(*by, "k", (F.col("i") % k).alias("o_")).agg((F.sum("d") * (F.max("n_") - 1) / F.count(F.lit(1)) / k / k).alias("l_"))
    lengths = start.groupBy(*by, "k").agg((F.avg("l_") + 1e-12).alias("l_"))
    return lengths.groupBy(*by).agg((-F.regr_slope(F.log("l_"), F.log(k.cast("double")))).alias("higuchi"))


def _segments(series: DataFrame, by: Sequence[str], least: int, share: int, count: int) -> DataFrame:
    """Rows of the whole segments of every scale: (by, s, w, t, x) with the place t within the segment."""
    each = _sized(series, by)
    each = each.withColumn("s", F.explode(_scales(least, F.greatest(F.lit(least + 1), F.floor(F.col("n_") / share)).cast("double"), count)))
    each = each.withColumns({"w": F.floor(F.col("i") / F.col("s")), "t": F.col("i") % F.col("s")})
    return each.where((F.col("w") + 1) * F.col("s") <= F.col("n_"))


def hurst(series: DataFrame, by: Sequence[str], scales: int = 10) -> DataFrame:
    """(by, hurst): slope of the log of the rescaled range over log scale, for scales from 4 to an eighth of the length, over all whole segments of each."""
    cut = _segments(series, by, 4, 8, scales)
    own = Window.partitionBy(*by, "s", "w")
    cut = cut.withColumn("d_", F.col("x") - F.avg("x").over(own))
    cut = cut.withColumn("c_", F.sum("d_").over(own.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    each = cut.groupBy(*by, "s", "w").agg((F.max("c_") - F.min("c_")).alias("r_"), F.stddev_pop("x").alias("sd_")).where("sd_ > 0")
    means = each.groupBy(*by, "s").agg(F.avg(F.col("r_") / F.col("sd_")).alias("rs_"))
    return means.groupBy(*by).agg(F.regr_slope(F.log("rs_"), F.log(F.col("s").cast("double"))).alias("hurst"))


def dfa(series: DataFrame, by: Sequence[str], scales: int = 6) -> DataFrame:
    """(by, dfa): slope of the log of the fluctuation around straight lines over log scale, for scales from 4 to a quarter of the length, over all whole segments of each."""
    order = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    walk = _sized(series, by).withColumn("x", F.sum(F.col("x") - F.col("mean_")).over(order)).select(*by, "i", "x")
    s, t = F.col("s"), F.col("t") - (F.col("s") - 1) / 2
    sums = _segments(walk, by, 4, 4, scales).groupBy(*by, "s", "w").agg(F.sum("x").alias("y_"), F.sum(F.col("x") * F.col("x")).alias("yy_"), F.sum(F.col("x") * t).alias("yt_"))
    rest = F.col("yy_") - F.col("y_") * F.col("y_") / s - F.col("yt_") * F.col("yt_") / (s * (s * s - 1) / 12)
    each = sums.groupBy(*by, "s").agg(F.sqrt(F.greatest(F.avg(rest / s), F.lit(0.0))).alias("f_"))
    return each.groupBy(*by).agg(F.regr_slope(F.log(F.col("f_") + 1e-12), F.log(s.cast("double"))).alias("dfa"))


def coarse(series: DataFrame, by: Sequence[str], most: int = 8, least_rows: int = 20) -> DataFrame:
    """(by, scale, i, x): means of as many values in a row as the scale says, for scales up to most that leave enough rows."""
    each = _sized(series, by).withColumn("scale", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("n_") / least_rows).cast("int"))))))
    each = each.withColumn("g_", F.floor(F.col("i") / F.col("scale"))).where((F.col("g_") + 1) * F.col("scale") <= F.col("n_"))
    return each.groupBy(*by, "scale", "g_").agg(F.avg("x").alias("x")).withColumnRenamed("g_", "i")
