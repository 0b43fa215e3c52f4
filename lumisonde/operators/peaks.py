"""Peaks of series of rows, with a least height and a least distance.

A candidate is a row above its neighbours. Candidates of a series that are less than the least distance from the
next one form a chain; peaks of different chains do not compete, so a chain is settled on its
own, by a fold. A series is never one array; a chain is as long as its candidates lie close.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.operators.ranks import cuts_of, ordered


def candidates(rows: DataFrame, by: Sequence[str], at: str, value: str, height: Column | float | None = None, cuts: Sequence[float] | None = None) -> DataFrame:
    """(by, at, value) of rows higher than those before and after them; the first and last of a series, and plateaus, are none."""
    seen = ordered(rows.select(*by, at, value), by, [at], before={"before_": value}, after={"after_": value}, cuts=cuts)
    high = (F.col(value) > F.col("before_")) & (F.col(value) > F.col("after_"))
    return seen.where(high if height is None else high & (F.col(value) >= height)).select(*by, at, value)


def _chains(found: DataFrame, by: Sequence[str], at: str, distance: int, cuts: Sequence[float] | None) -> DataFrame:
    cuts = cuts_of(found, at) if cuts is None else cuts
    apart = F.coalesce((F.col(at) - F.col("last_") >= distance).cast("int"), F.lit(1))
    seen = ordered(found, by, [at], before={"last_": at}, cuts=cuts).withColumn("apart_", apart)
    return ordered(seen, by, [at], sums={"chain_": "apart_"}, cuts=cuts)


def picked(found: DataFrame, by: Sequence[str], at: str, value: str, distance: int, highest: bool = False, cuts: Sequence[float] | None = None) -> DataFrame:
    """The candidates that stay: each in its turn stays if none within the distance has. Turns go from left to right, or from the highest to the lowest (later first among equals)."""
    chains = _chains(found, by, at, distance, cuts)
    row = F.struct((-F.col(value) if highest else F.lit(0.0)).alias("v"), (-F.col(at) if highest else F.col(at)).alias("a"))
    place = lambda r: -r["a"] if highest else r["a"]
    none = F.array().cast("array<bigint>")
    at_ = lambda r: place(r).cast("bigint")
    near = (lambda kept, r: F.exists(kept, lambda k: F.abs(k - at_(r)) < distance)) if highest else (lambda kept, r: F.coalesce(at_(r) - F.try_element_at(kept, F.lit(-1)) < distance, F.lit(False)))
    fold = F.aggregate(F.sort_array(F.collect_list(row)), none, lambda kept, r: F.when(near(kept, r), kept).otherwise(F.concat(kept, F.array(at_(r)))))
    kept = chains.groupBy(*by, "chain_").agg(fold.alias("kept_")).select(*by, F.explode("kept_").alias(at))
    return found.withColumn(at, F.col(at).cast("bigint")).join(kept, [*by, at])
