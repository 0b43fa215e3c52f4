"""Algebra of interval sets: union, intersection, difference and complement of half-open intervals, by key.

Every interval is two rows, +1 at its start and -1 at its end. Running sums over the borders of a
key tell how many intervals of each set cover what follows a border; the result begins where the
condition on these numbers becomes true and ends where it becomes false. Borders are summed by
position first, and the order of a key is cut into ranges, so a key with any share of the intervals is not one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.operators.ranks import cuts_of, ordered

#: A condition on whether a position lies in the first and in the second set.
Rule = Callable[[Column, Column], Column]


def _borders(spans: DataFrame, by: Sequence[str], one: int, two: int) -> DataFrame:
    """Both borders of each non-empty interval (start, end), with what they change in either set."""
    border = lambda c, d: F.struct(F.col(c).alias("at_"), F.lit(d * one).alias("one_"), F.lit(d * two).alias("two_"))
    return spans.where("start < end").select(*by, F.explode(F.array(border("start", 1), border("end", -1))).alias("border_")).select(*by, "border_.*")


def combined(first: DataFrame, second: DataFrame, by: Sequence[str], rule: Rule) -> DataFrame:
    """(by, start, end): the maximal intervals where rule(in first, in second) holds. Both have by, start and end; outside of all intervals rule must not hold."""
    changes = _borders(first, by, 1, 0).unionByName(_borders(second, by, 0, 1)).groupBy(*by, "at_").agg(F.sum("one_").alias("one_"), F.sum("two_").alias("two_"))
    cuts = cuts_of(first.select("start").unionByName(second.select("start")), "start")
    swept = ordered(changes, by, ["at_"], sums={"n1_": "one_", "n2_": "two_"}, cuts=cuts)
    holds = rule(F.col("n1_") > 0, F.col("n2_") > 0)
    held = rule(F.col("n1_") - F.col("one_") > 0, F.col("n2_") - F.col("two_") > 0)
    turns = swept.where(holds != held).select(*by, "at_", holds.cast("int").alias("starts_"))
    # the k-th start belongs to the k-th end
    counted = ordered(turns, by, ["at_"], sums={"nth_": "starts_"}, cuts=cuts)
    return counted.groupBy(*by, "nth_").agg(F.min("at_").alias("start"), F.max("at_").alias("end")).select(*by, "start", "end")


def union(first: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    """What lies in either set; touching intervals become one."""
    return combined(first, second, by, lambda a, b: a | b)


def intersection(first: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    return combined(first, second, by, lambda a, b: a & b)


def difference(first: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    """What lies in the first set and not in the second."""
    return combined(first, second, by, lambda a, b: a & ~b)


def gaps(spans: DataFrame, frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """What of each key's frame (start, end) no interval covers."""
    return difference(frame, spans, by)


def runs(rows: DataFrame, by: Sequence[str], at: str, holds: Column, step: int = 1, width: int | None = None) -> DataFrame:
    """(by, start, end): stretches of consecutive numbers of a column where a condition holds, times step; the end is that of the last row, width (or step) after it begins."""
    seen = ordered(rows.where(holds).select(*by, at), by, [at], number="rn_")
    island = seen.groupBy(*by, (F.col(at) - F.col("rn_")).alias("isle_")).agg(F.min(at).alias("lo_"), F.max(at).alias("hi_"))
    return island.select(*by, (F.col("lo_") * step).alias("start"), (F.col("hi_") * step + (width or step)).alias("end"))


def durations(spans: DataFrame, by: Sequence[str], rate: float, short: float = 0.2, long: float = 0.5) -> DataFrame:
    """Per key: number, mean, deviation (population), longest and total of the intervals in seconds, and the shares that are short, in between and long."""
    s = (F.col("end") - F.col("start")) / rate
    share = lambda c: F.avg(c.cast("double"))
    return spans.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.max(s).alias("longest"), F.sum(s).alias("total"),
        share(s < short).alias("short"), share((s >= short) & (s < long)).alias("medium"), share(s >= long).alias("long"),
    )
