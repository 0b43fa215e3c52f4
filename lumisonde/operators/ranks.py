"""Exact ranks, running sums, neighbours and percentiles within groups of any size.

A window over a group with a third of all rows would be one task. Here the order is cut into
ranges by approximate quantiles of its first column; windows see a range of a group each, and
what the earlier and later ranges of the group hold (counts, sums, border rows) is joined from a
table with a row for each range of each group. Cutting runs a job while the plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order, unless the caller names another number.
RANGES = 32
#: Ranges at most, where their number follows that of the rows.
MOST = 1024


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _range_of(x: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending cuts are at most x: first by every 16th of them, then among 16. One literal, however many there are."""
    if not cuts:
        return F.lit(0)
    among = lambda c: F.size(F.filter(c, lambda v: v <= x))
    every = F.lit(np.array(cuts, np.float64))
    skipped = 16 * F.greatest(among(F.lit(np.array(cuts[::16], np.float64))) - 1, F.lit(0))
    return F.when(x.isNull(), 0).otherwise(skipped + among(F.slice(every, skipped + 1, 16)))


def _number(rows: DataFrame, value: Column | str) -> Column:
    c = _col(value)
    timed = dict(rows.select(c.alias("x")).dtypes)["x"].startswith("timestamp")
    return (F.unix_micros(c.cast("timestamp")) if timed else c).cast("double")


def cuts_of(rows: DataFrame, value: Column | str, ranges: int = RANGES, each: int | None = None) -> list[float]:
    """Where to cut the order of a number or time into ranges of about as many rows: a job over rows, whose result (ranges - 1 numbers) serves every ``ordered`` by the same value.

    With each, there are more ranges the more rows there are (doubled until about ``each`` rows are left in one, ``MOST`` at most), so that a range does not grow with the table. This is for few
    groups: the table of ranges has a row for each range of each group.
    """
    q = max(ranges, MOST) if each else ranges
    x = _number(rows, value)
    found = rows.agg(F.percentile_approx(F.when(~F.isnan(x), x), [k / q for k in range(1, q)], F.lit(10 * q if each else 1000)).alias("c"), F.count(F.lit(1)).alias("n")).first()
    cuts, step = found["c"] or [], q // ranges
    while each and step > 1 and found["n"] * step > each * q:
        step //= 2
    return sorted(set(cuts[step - 1 :: step]))


def ordered(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    number: str | None = None,
    size: str | None = None,
    sums: Mapping[str, Column | str] | None = None,
    totals: Mapping[str, Column | str] | None = None,
    before: Mapping[str, Column | str] | None = None,
    after: Mapping[str, Column | str] | None = None,
    ranges: int = RANGES,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """rows with, for their place in the order of their group: its number from 1, the group's size, running sums up to and with the row, the group's totals, and values of the row before and after.

    Columns of order ascend; the first is a number or a time. Many rows with one value of it are one range; the further columns order them.
    Summed values must not be null. cuts, if given, are those of ``cuts_of``: rows may then be costly to make, as no job reads them here.
    """
    sums, totals, before, after = sums or {}, totals or {}, before or {}, after or {}
    cuts = cuts_of(rows, order[0], ranges) if cuts is None else cuts
    part = _range_of(_number(rows, order[0]), cuts)
    piece, own, info = fresh(rows, "range_", "own_", "info_")
    local = Window.partitionBy(*by, piece).orderBy(*map(_col, order))
    cut = rows.withColumn(piece, part)
    shown = lambda kept: F.struct(*[_col(c).alias(n) for n, c in kept.items()])
    key = F.struct(*[_col(c).alias(f"k{i}") for i, c in enumerate(order)])
    made = [F.count(F.lit(1)).alias("count")] + [F.sum(_col(c)).alias(f"sum_{n}") for n, c in {**sums, **totals}.items()]
    made += [F.max_by(shown(before), key).alias("last")] * bool(before) + [F.min_by(shown(after), key).alias("first")] * bool(after)
    # a row for each range of each group
    table = cut.groupBy(*by, piece).agg(F.struct(*made).alias(info))
    groups = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    up, of = groups.orderBy(piece), lambda n: F.col(f"{info}.{n}")
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    made = [F.coalesce(F.sum(of("count")).over(earlier), F.lit(0)).alias("before"), F.sum(of("count")).over(groups).alias("size"), of("count").alias("count")]
    made += [F.sum(of(f"sum_{n}")).over(earlier).alias(f"sum_{n}") for n in sums] + [F.sum(of(f"sum_{n}")).over(groups).alias(f"total_{n}") for n in totals]
    made += [F.lag(of("last")).over(up).alias("last")] * bool(before) + [F.lead(of("first")).over(up).alias("first")] * bool(after)
    table = table.select(*by, piece, F.struct(*made).alias(info))
    cut = cut.withColumn(own, F.row_number().over(local))
    names = {n: f"{n}_" for n in (*sums, *before, *after)}
    names = dict(zip(names, fresh(cut, *names.values())))
    cut = cut.withColumns({names[n]: F.sum(_col(c)).over(local.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()})
    cut = cut.withColumns({names[n]: F.lag(_col(c)).over(local) for n, c in before.items()} | {names[n]: F.lead(_col(c)).over(local) for n, c in after.items()})
    out = cut.alias("l").join(table.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, piece)])
    of = lambda n: F.col(f"r.{info}.{n}")
    left = lambda n: F.col(f"l.{n}")
    added = [(left(own) + of("before")).alias(number)] if number else []
    added += [of("size").alias(size)] if size else []
    added += [(left(names[n]) + F.coalesce(of(f"sum_{n}"), F.lit(0))).alias(n) for n in sums] + [of(f"total_{n}").alias(n) for n in totals]
    added += [F.when(left(own) == 1, of(f"last.{n}")).otherwise(left(names[n])).alias(n) for n in before]
    added += [F.when(left(own) == of("count"), of(f"first.{n}")).otherwise(left(names[n])).alias(n) for n in after]
    return out.select(*[left(c) for c in rows.columns if c not in {number, size, *sums, *totals, *before, *after}], *added)


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], into: str = "rn", size: str = "n", ranges: int = RANGES) -> DataFrame:
    """rows with their rank from 1 within their group, and the group's size."""
    return ordered(rows, by, order, number=into, size=size, ranges=ranges)


def percentiles(rows: DataFrame, by: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, a column for each name in at; nulls are left out."""
    each = ranked(rows.where(F.col(value).isNotNull()).select(*by, value), by, [value])
    made = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("n") - 1)
        low, high = (F.max(F.when(F.col("rn") - 1 == k, F.col(value))) for k in (F.floor(place), F.ceil(place)))
        made.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return each.groupBy(*by).agg(*made)
