"""Preparation and checks of a corpus of clips before training: cleaning, invariants, requirements, leaks, noise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a
from lumisonde.operators.metrics import ratio
from lumisonde.operators.ranks import ranked


def prepared(clips: DataFrame, x: str, rate: int, least: float = 0.0, most: float | None = None, db: float = -50.0, to: float = 0.95, tallest: float | None = None) -> DataFrame:
    """clips with state ok, non_finite (over half the values), short, long, silent or loud; those that are ok have x cleaned and scaled to a peak."""
    v = F.col(x)
    odd = F.size(F.filter(v, lambda e: F.isnan(e) | (F.abs(e) == float("inf"))))
    seconds, clean = F.size(v) / rate, a.clean(v)
    state = F.when(v.isNull() | (F.size(v) == 0), "short").when(odd / F.size(v) > 0.5, "non_finite").when(seconds < least, "short")
    if most is not None:
        state = state.when(seconds > most, "long")
    if tallest is not None:
        state = state.when(a.peak(clean) > tallest, "loud")
    state = state.when(a.silent(clean, db), "silent").otherwise("ok")
    return clips.withColumn("state", state).withColumn(x, F.when(F.col("state") == "ok", a.peak_normalize(clean, to)))


def invariants(rows: DataFrame, x: str, y: str, least: int = 2) -> DataFrame:
    """One row: rows, whether all arrays have one length, all values are finite, labels are 0 and 1, and each has enough rows."""
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    n0, n1 = F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        (F.min(F.size(x)) == F.max(F.size(x))).alias("one_shape"),
        (F.count_if(bad) == 0).alias("finite"),
        ((F.count_if(F.col(y).isNull() | ~F.col(y).isin(0, 1)) == 0) & (n0 > 0) & (n1 > 0)).alias("binary"),
        (F.least(n0, n1) >= least).alias("enough"),
    )


def first_filled(columns: Sequence[str], of: DataFrame) -> Column:
    """The first of the columns that of has and whose trimmed text is not empty."""
    have = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns if c in of.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def by_prefix(c: Column, prefixes: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The class of the first prefix that fits."""
    out = F.lit(otherwise)
    for prefix, name in reversed(prefixes):
        out = F.when(F.startswith(c, F.lit(prefix)), name).otherwise(out)
    return out


def requirements(counts: DataFrame, n0: str, n1: str, least: int, wanted: int) -> DataFrame:
    """counts with lists of errors and warnings, and whether there are no errors."""
    low, high, total = F.least(n0, n1), F.greatest(n0, n1), F.col(n0) + F.col(n1)
    out = counts.withColumn("errors", F.array_compact(F.array(F.when(total < least, "too few samples"), F.when(low == 0, "one class only"))))
    warned = F.array(F.when((total >= least) & (total < wanted), "fewer samples than recommended"), F.when((low > 0) & (high > 2 * low), "classes differ by more than two to one"))
    return out.withColumn("warnings", F.array_compact(warned)).withColumn("valid", F.size("errors") == 0)


def readiness(counts: DataFrame, n0: str, n1: str, tiers: DataFrame) -> DataFrame:
    """Each row of counts against each of a few tiers (tier, need): ready, partial from half the need, or no; and how well classes are balanced."""
    low, rate = F.least(n0, n1), ratio(F.col(n1), F.col(n0), float("inf"))
    status = F.when(low >= F.col("need"), "ready").when(2 * low >= F.col("need"), "partial").otherwise("no")
    balance = F.when((rate < 0.5) | (rate > 2), "severe").when((rate >= 0.8) & (rate <= 1.25), "ideal").otherwise("fair")
    return counts.join(F.broadcast(tiers), F.lit(True)).withColumn("status", status).withColumn("balance", balance)


def encoded(rows: DataFrame, column: str, codes: dict[str, int], into: str = "code") -> DataFrame:
    """rows with the code of a value's name; raises if a value has none, naming some."""
    code = F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])[F.col(column)]
    unknown = [r[0] for r in rows.where(code.isNull()).select(column).distinct().limit(5).collect()]  # five values at most
    if unknown:
        raise ValueError(f"unknown values of {column}: {unknown}")
    return rows.withColumn(into, code)


def in_order(names: Column, first: Sequence[str]) -> tuple[Column, Column]:
    """Sort keys: the place in a list, then names that are not in it by themselves."""
    at = F.array_position(F.array(*map(F.lit, first)), names)
    return F.when(at > 0, at).otherwise(len(first) + 1), names


def together(parts: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """One row per key with the features of all its types, one after another; types that it lacks are skipped.

    parts: (type, rows of key and an array column features). One grouping instead of a chain of joins.
    """
    every = None
    for i, (_, df) in enumerate(parts):
        each = df.select(key, F.lit(i).alias("at"), "features")
        every = each if every is None else every.unionByName(each)
    row = F.sort_array(F.collect_list(F.struct("at", "features")))  # at most one for each type
    return every.groupBy(key).agg(F.flatten(F.transform(row, lambda r: r["features"])).alias("features"))


def segment_features(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per key arrays mean, median, std (of samples), and all: means, stds, least and largest values, block after block.

    NaN counts as missing; columns without any value are left out; what is undefined is 0.
    """
    clean = rows.select(key, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    seen = clean.agg(*[F.count(c).alias(c) for c in columns]).first()  # one row
    kept = [c for c in columns if seen[c]]
    block = lambda f: F.array(*[F.coalesce(f(c), F.lit(0.0)) for c in kept])
    out = clean.groupBy(key).agg(block(F.avg).alias("mean"), block(F.median).alias("median"), block(F.stddev_samp).alias("std"), block(F.min).alias("least"), block(F.max).alias("most"))
    return out.select(key, "mean", "median", "std", F.concat("mean", "std", "least", "most").alias("all"))


def leaks(rows: DataFrame, split: str, content: Column) -> DataFrame:
    """Contents that stand in two splits or more, by digest: for each pair of splits the number of contents and of rows; none if there is no leak."""
    names = F.array_sort(F.collect_set(split))  # as many as there are splits
    each = rows.select(F.sha2(content, 256).alias("d"), split).groupBy("d").agg(names.alias("s"), F.count(F.lit(1)).alias("n")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda p: F.transform(F.filter("s", lambda q: q > p), lambda q: F.struct(p.alias("a"), q.alias("b")))))
    return each.select(F.explode(pairs).alias("p"), "n").groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("rows"))


def scaler_fits(rows: DataFrame, columns: Sequence[str], train: Column, tolerance: float = 0.01) -> DataFrame:
    """Per column the mean of training rows and of all rows, and whether the scaler was fitted to training rows only, judged by a mean given in the row of fitted."""
    made = [F.struct(F.lit(c).alias("column"), F.avg(F.when(train, F.col(c))).alias("train"), F.avg(c).alias("whole")).alias(c) for c in columns]
    out = rows.agg(*made).select(F.explode(F.array(*columns)).alias("s")).select("s.*")
    return out.withColumn("near", F.abs(F.col("train") - F.col("whole")) <= tolerance * F.abs(F.col("train")))


def split_strategy(rows: DataFrame, label: str, group: str | None = None, speaker: str | None = None, generator: str | None = None, hold_speaker: str | None = None, hold_generator: str | None = None) -> str:
    """How rows are to be split: a speaker held out, a generator held out, by speaker, by group, or stratified.

    The first that is asked for and possible counts: a held-out name must occur, a grouping needs at least three groups and both labels in at least two of them.
    """
    for column, held, name in ((speaker, hold_speaker, "holdout_speaker"), (generator, hold_generator, "holdout_generator")):
        if column and held and not rows.where(F.lower(F.col(column)) == held.lower()).isEmpty():
            return name
    for column, name in ((speaker, "speaker_split"), (group, "group_split")):
        if column:
            seen = rows.groupBy(column).agg(F.max((F.col(label) == 0).cast("int")).alias("a"), F.max((F.col(label) == 1).cast("int")).alias("b"))
            n, zeros, ones = seen.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
            if n >= 3 and zeros >= 2 and ones >= 2:
                return name
    return "stratified"


def with_noise(clips: DataFrame, key: str, x: str, snrs: Sequence[float], seed: int = 42) -> DataFrame:
    """A copy of each clip for each signal-to-noise ratio in dB, with white noise that depends on the key, the place, the ratio and the seed only."""
    each = clips.withColumn("snr", F.explode(F.array(*[F.lit(float(s)) for s in snrs])))
    unit = lambda *c: (F.pmod(F.xxhash64(*c), F.lit(1 << 40)).cast("double") + 0.5) / (1 << 40)
    wide = F.sqrt(a.energy(F.col(x)) / F.size(x) / F.pow(F.lit(10.0), F.col("snr") / 10))
    draw = lambda i: F.sqrt(-2 * F.log(unit(F.col(key), i, F.col("snr"), F.lit(seed)))) * F.cos(2 * math.pi * unit(F.lit(seed + 1), F.col("snr"), i, F.col(key)))
    each = each.withColumn("noise_", wide)
    return each.withColumn(x, F.transform(x, lambda v, i: v + F.col("noise_") * draw(i))).drop("noise_")


def hours(rows: DataFrame, group: str, order: str, seconds: str, probe: int = 150) -> DataFrame:
    """Hours of each group, from the mean of its first rows and its number of rows."""
    each = ranked(rows, [group], [order], "rn", "n")
    return each.groupBy(group).agg((F.avg(F.when(F.col("rn") <= probe, F.col(seconds))) * F.max("n") / 3600).alias("hours"))


def label_mismatch(rows: DataFrame, by: Sequence[str], path: str, label: str, warn: float = 0.01) -> DataFrame:
    """Per group how many paths name a label, the share of these where it is not the row's, and whether that is too much."""
    told = a.label_of(F.col(path))
    rate = F.avg((F.col(label) != told).cast("int"))
    return rows.groupBy(*by).agg(F.count(told).alias("told"), rate.alias("mismatch"), (rate > warn).alias("warn"))


def zipped(one: DataFrame, two: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of two sequences of each group at the same place (from 1), with all columns of the first and those of the second that it lacks; groups whose sequences differ in length have none."""
    left, right = ranked(one, by, order, "place", "rows_"), ranked(two, by, order, "place", "rows_")
    kept = [c for c in two.columns if c not in one.columns]
    return left.join(right.select(*by, "place", "rows_", *kept), [*by, "place", "rows_"]).drop("rows_")


def unequal(one: DataFrame, two: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups whose sequences differ in length, with both lengths."""
    both = one.select(*by, F.lit(1).alias("left_"), F.lit(0).alias("right_")).unionByName(two.select(*by, F.lit(0).alias("left_"), F.lit(1).alias("right_")))
    counts = both.groupBy(*by).agg(F.sum("left_").alias("left_rows"), F.sum("right_").alias("right_rows"))
    return counts.where(F.col("left_rows") != F.col("right_rows"))


def fit_set(rows: DataFrame, split: str, key: str, x: str, snrs: Sequence[float]) -> DataFrame:
    """What a classical model is fitted on: rows of train and val, and a noisy copy of each for each ratio; origin says which."""
    own = rows.where(F.col(split).isin("train", "val"))
    plain = own.withColumns({"origin": F.col(split), "snr": F.lit(None).cast("double")})
    return plain.unionByName(with_noise(own, key, x, snrs).withColumn("origin", F.lit("noisy")))
