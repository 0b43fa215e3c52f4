"""Altered copies of clips: noise, shift, gain, masks, mixtures, coarse coding.

What is drawn at random comes from a hash of the clip's key, a name and the seed, so a copy is
the same wherever and whenever it is made. A clip is an array in one row; copies are rows beside it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a
from lumisonde.operators.preparation import with_noise
from lumisonde.operators.ranks import ordered


def drawn(key: str, name: str, seed: int, *more: Column) -> Column:
    """A number from 0 to 1 (exclusive) of a key, a name and a seed."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(name), F.lit(seed), *more), F.lit(1 << 40)).cast("double") / (1 << 40)


def shifted(x: Column, by: Column) -> Column:
    """An array turned by so many places; what leaves at one end enters at the other."""
    n = F.size(x)
    k = F.pmod(by, F.greatest(n, F.lit(1))).cast("int")
    return F.when(n > 0, F.concat(F.slice(x, n - k + 1, k), F.slice(x, F.lit(1), n - k))).otherwise(x)


def masked(x: Column, start: Column, width: Column) -> Column:
    """Zeros from a place on, so many."""
    return F.transform(x, lambda v, i: F.when((i >= start) & (i < start + width), 0.0).otherwise(v))


def companded(x: Column, levels: int = 256) -> Column:
    """Samples of -1 to 1 as a coder of so many logarithmic levels gives them back."""
    mu = levels - 1
    coded = lambda v: F.signum(v) * F.log1p(mu * F.least(F.abs(v), F.lit(1.0))) / math.log1p(mu)
    kept = lambda v: F.floor((coded(v) + 1) / 2 * mu + 0.5) / mu * 2 - 1
    return F.transform(x, lambda v: F.signum(kept(v)) * (F.pow(F.lit(float(levels)), F.abs(kept(v))) - 1) / mu)


def copies(clips: DataFrame, key: str, x: str, kinds: Sequence[str] = ("noise", "shift", "gain", "mask", "code"), seed: int = 42, snr: float = 20.0, reach: float = 0.2, db: float = 6.0, share: float = 0.1) -> DataFrame:
    """A row for each clip and kind (column copy): noise at a ratio, a turn by up to a share of the length, a gain of up to some dB either way, zeros over up to a share, coarse coding."""
    n = F.size(x)
    turn = F.round((2 * drawn(key, "shift", seed) - 1) * reach * n).cast("int")
    width = F.floor(drawn(key, "width", seed) * share * n)
    start = F.floor(drawn(key, "start", seed) * (n - width + 1))
    gain = F.pow(F.lit(10.0), (2 * drawn(key, "gain", seed) - 1) * db / 20)
    made = {"shift": shifted(F.col(x), turn), "gain": F.transform(x, lambda v: v * gain), "mask": masked(F.col(x), start, width), "code": companded(F.col(x))}
    out = None
    for kind in kinds:
        rows = with_noise(clips, key, x, [snr], seed).drop("snr") if kind == "noise" else clips.withColumn(x, made[kind])
        rows = rows.select(*clips.columns, F.lit(kind).alias("copy"))
        out = rows if out is None else out.unionByName(rows)
    return out


def mixed(clips: DataFrame, key: str, x: str, label: str, seed: int = 42, sharp: float = 0.4) -> DataFrame:
    """Each clip mixed with the next one in an order by hash, both labels with their shares: (key, other, share, x, y). The share of the clip itself is at least one half and the nearer to 1 the smaller ``sharp``; a longer partner is cut, a shorter one ends early.

    The last in the order has no next one and is left out.
    """
    each = clips.select(key, F.col(x).cast("array<double>").alias("x_"), F.col(label).cast("double").alias("y_")).withColumn("h_", F.xxhash64(F.col(key), F.lit(seed)))
    pair = ordered(each, [], ["h_", key], after={"other_": key, "x2_": "x_", "y2_": "y_"}).where(F.col("other_").isNotNull())
    share = F.pow(F.greatest(drawn(key, "share", seed), F.lit(1e-9)), F.lit(sharp))
    pair = pair.withColumn("share", F.greatest(share, 1 - share))
    both = F.transform("x_", lambda v, i: F.col("share") * v + (1 - F.col("share")) * F.coalesce(F.get("x2_", i), F.lit(0.0)))
    return pair.select(key, F.col("other_").alias("other"), "share", both.alias("x"), (F.col("share") * F.col("y_") + (1 - F.col("share")) * F.col("y2_")).alias("y"))


def leveled(x: Column, db: float = -3.0) -> Column:
    """Scaled so that the peak is so many dB below full scale; silence stays."""
    return a.peak_normalize(x, 10 ** (db / 20))
