"""Pitch and voice quality of frames: fundamental frequency, periodicity, perturbation, noise.

Frames are rows. What needs sums over all pairs of lags is numpy over Arrow batches of
frames (a difference function, autocorrelations, a transform); picking a lag and everything after is expressions and aggregates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisonde.functions import arrays as a
from lumisonde.functions import frames as fr

def differences(frames: Column, most: int) -> Column:
    """For each frame the differences at lags 0 to most, each over the mean of those up to it; the first half of a frame is compared with what follows it by the lag."""

    def of(x: np.ndarray) -> np.ndarray:
        w = x.shape[1] // 2
        lags = min(most, x.shape[1] - w)
        power = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1)
        n = 1 << (x.shape[1] + w - 1).bit_length()
        both = np.fft.irfft(np.conj(np.fft.rfft(x[:, :w], n)) * np.fft.rfft(x, n), n)[:, : lags + 1]
        k = np.arange(lags + 1)
        d = np.maximum(power[:, [w]] + power[:, k + w] - power[:, k] - 2 * both, 0.0)
        d[:, 0] = 0.0
        total = np.cumsum(d, axis=1)
        out = np.ones_like(d)
        np.divide(d * k, total, out=out, where=total > 1e-12)
        return out

    return fr.per_batch(of, frames)


def autocorrelations(frames: Column, most: int) -> Column:
    """For each frame the sums of x[t] x[t + k] for k from 0 to most; beyond its length 0."""

    def of(x: np.ndarray) -> np.ndarray:
        n = 1 << (2 * x.shape[1] - 1).bit_length()
        r = np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2, n)[:, : min(most + 1, x.shape[1])]
        return np.pad(r, ((0, 0), (0, most + 1 - r.shape[1])))

    return fr.per_batch(of, frames)


def period(d: Column, least: int, threshold: float = 0.1) -> Column:
    """(lag, dip) from differences: the first local minimum under the threshold from the least lag on, or else the lowest lag; a parabola through its neighbours refines it.

    A scan from left to right, as a fold whose state is the first dip under the threshold and the lowest value so far.
    """
    n = F.size(d)
    at = lambda i: F.get(d, i)
    start = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("low"), F.lit(float("inf")).alias("v"))

    def step(s: Column, i: Column) -> Column:
        v = at(i)
        falls = F.when(i == least, v < at(i + 1)).otherwise((v < at(i - 1)) & F.coalesce(v <= at(i + 1), F.lit(True)))
        dip = F.coalesce(falls, F.lit(False)) & (v < threshold)
        lower = v < s["v"]
        return F.struct(
            F.when((s["first"] < 0) & dip, i).otherwise(s["first"]).alias("first"), F.when(lower, i).otherwise(s["low"]).alias("low"), F.when(lower, v).otherwise(s["v"]).alias("v")
        )

    lag = F.aggregate(F.sequence(F.lit(least), n - 1), start, step, lambda s: F.when(s["first"] >= 0, s["first"]).otherwise(s["low"]))

    def refined(i: Column) -> Column:
        before, here, after = at(i - 1), at(i), at(i + 1)
        bend = before + after - 2 * here
        shift = F.when((i > least) & (i < n - 1) & (bend > 0), (before - after) / (2 * bend)).otherwise(0.0)
        shift = F.when(F.abs(shift) > 1, 0.0).otherwise(shift)
        return F.struct((i + shift).alias("lag"), here.alias("dip"))

    return F.when(n > least, a.let(lag, refined))


def pitch(frames: DataFrame, rate: float, low: float, high: float, threshold: float = 0.1, voiced: float = 0.5, silence: float = 1e-8) -> DataFrame:
    """frames (with w, the samples) with f0 in Hz, the dip of the difference there, and whether the frame is voiced: a dip deep enough, and power over silence."""
    least, most = max(1, int(rate // high)), math.ceil(rate / low)
    out = frames.withColumn("d_", differences(F.col("w"), most))
    out = out.withColumn("p_", period(F.col("d_"), least, threshold)).drop("d_")
    power = a.energy(F.col("w")) / F.size("w")
    return out.withColumns({"f0": rate / F.col("p_.lag"), "dip": F.col("p_.dip"), "voiced": F.coalesce((F.col("p_.dip") < voiced) & (power > silence), F.lit(False))}).drop("p_")


def cut(clips: DataFrame, key: str, x: str, size: int, hop: int) -> DataFrame:
    """(key, frame, w): all full frames of each clip, a row each; no array holds more than one of them."""
    return fr.cut(clips, key, x, size, hop)


def pitch_statistics(frames: DataFrame, key: str) -> DataFrame:
    """Per clip, over its voiced frames: mean, deviation, variance, least, largest, range, median, quartiles, slope over their number, coefficient of variation, skewness, excess, rises and falls; and the share of voiced frames.

    A clip without voiced frames has zeros. A clip's frames are at most the samples of one array, so a window may hold them.
    """
    w = Window.partitionBy(key).orderBy("frame")
    shares = frames.groupBy(key).agg(F.avg(F.col("voiced").cast("double")).alias("voicing"))
    v = frames.where("voiced").select(key, "frame", "f0")
    v = v.withColumns({"k": F.row_number().over(w) - 1, "d": F.col("f0") - F.lag("f0").over(w)})
    f = F.col("f0")
    q = lambda p: F.percentile("f0", F.lit(p))
    out = v.groupBy(key).agg(
        F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"), F.var_pop(f).alias("variance"), F.min(f).alias("least"), F.max(f).alias("most"), (F.max(f) - F.min(f)).alias("range"),
        q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), (q(0.75) - q(0.25)).alias("iqr"), F.coalesce(F.regr_slope("f0", "k"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.skewness(f), F.lit(0.0)).alias("skewness"), F.coalesce(F.kurtosis(f), F.lit(0.0)).alias("kurtosis"), (F.stddev_pop(f) / F.avg(f)).alias("variation"),
        F.count_if(F.col("d") > 0).alias("rises"), F.count_if(F.col("d") < 0).alias("falls"),
    )
    made = [c for c in out.columns if c != key]
    return shares.join(out, key, "left").select(key, "voicing", *[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in out.dtypes if c in made])


def perturbation(frames: DataFrame, key: str, rate: float) -> DataFrame:
    """Per clip, over its voiced frames (f0, and peak and rms of the samples): jitter, shimmer, shimmer in dB, and the quotients of a period to its 3 and 5 neighbours and of an amplitude to its 11; 0 where frames are too few."""
    w = Window.partitionBy(key).orderBy("frame")
    around = lambda c, r: F.avg(c).over(w.rowsBetween(-r, r))
    t, p, r = F.col("t"), F.col("peak"), F.col("rms")
    v = frames.where("voiced").select(key, "frame", (rate / F.col("f0")).alias("t"), a.peak(F.col("w")).alias("peak"), a.rms(F.col("w")).alias("rms"))
    v = v.withColumns({"k": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy(key)), "t0": F.lag(t).over(w), "p0": F.lag(p).over(w), "r0": F.lag(r).over(w), "t3": around(t, 1), "t5": around(t, 2), "r11": around(r, 5)})
    inner = lambda m: (F.col("k") > m) & (F.col("k") <= F.col("n") - m)
    db = F.when((r > 0) & (F.col("r0") > 0), F.abs(20 * F.log10(F.col("r0") / r)))
    share = lambda d, of, m=None: F.coalesce(F.avg(d if m is None else F.when(inner(m), d)) / F.avg(of), F.lit(0.0))
    return v.groupBy(key).agg(
        share(F.abs(t - F.col("t0")), t).alias("jitter"), share(F.abs(p - F.col("p0")), p).alias("shimmer"), F.coalesce(F.avg(db), F.lit(0.0)).alias("shimmer_db"),
        share(F.abs(t - F.col("t3")), t, 1).alias("rap"), share(F.abs(t - F.col("t5")), t, 2).alias("ppq"), share(F.abs(r - F.col("r11")), r, 5).alias("apq"),
    )


def pitch_strength(frames: DataFrame, rate: float) -> DataFrame:
    """frames (f0, voiced, w) with the autocorrelation at the period over that at 0; 0 where a frame is not voiced or too short."""
    lag, n = F.floor(rate / F.col("f0")).cast("int"), F.size("w")
    # two sums a frame: the transform gives all lags, of which one is asked for
    kept = F.greatest(n - lag, F.lit(0))
    own, shifted = a.energy(F.col("w")), fr.dot(F.slice("w", F.lit(1), kept), F.slice("w", lag + 1, kept))
    at = F.when(F.col("voiced") & (lag < n) & (own > 0), shifted / own)
    return frames.withColumn("strength", F.coalesce(at, F.lit(0.0)))


def harmonics_to_noise(frames: DataFrame, key: str, size: int, rate: float, harmonics: int = 5, reach: int = 2) -> DataFrame:
    """Per clip the power within some bins of the first harmonics of voiced frames (f0, m: magnitudes) over all other power, in dB, and the ratio of the noise to them; 0 if there is no noise or no harmonic."""
    power = F.transform("m", lambda x: x * x)
    bins = size // 2 + 1
    place = lambda h: F.floor(h * F.col("f0") * size / rate).cast("int")
    near = lambda q, h: F.when((h * F.col("f0") < rate / 2) & (place(h) < bins), a.total(F.slice(q, F.greatest(place(h) - reach, F.lit(0)) + 1, F.least(place(h) + reach, F.lit(bins - 1)) - F.greatest(place(h) - reach, F.lit(0)) + 1))).otherwise(0.0)
    kept = frames.where("voiced").withColumn("q_", power)
    each = kept.select(key, a.total(F.col("q_")).alias("all"), sum((near(F.col("q_"), h) for h in range(1, harmonics + 1)), F.lit(0.0)).alias("own"))
    sums = each.groupBy(key).agg(F.sum("all").alias("all"), F.sum("own").alias("own"))
    good = (F.col("all") > F.col("own")) & (F.col("own") > 0)
    rest = F.col("all") - F.col("own")
    return sums.select(key, F.when(good, 10 * F.log10(F.col("own") / rest)).otherwise(0.0).alias("hnr"), F.when(good, rest / F.col("own")).otherwise(0.0).alias("nhr"))


def signal_to_noise(frames: DataFrame, key: str) -> DataFrame:
    """Per clip the mean energy of frames over the tenth percentile, in dB; 100 if that is 0."""
    e = frames.select(key, a.energy(F.col("w")).alias("e")).groupBy(key).agg(F.avg("e").alias("mean"), F.percentile("e", F.lit(0.1)).alias("low"))
    return e.select(key, F.when(F.col("low") > 0, 10 * F.log10(F.col("mean") / F.col("low"))).otherwise(100.0).alias("snr"))


def cepstral_peak(frames: Column, rate: float, low: float = 80.0, high: float = 400.0) -> Column:
    """For each frame the highest cepstral value at the periods of low to high Hz, less the mean below; 0 if a frame is too short."""
    least, most = int(rate / high), int(rate / low)

    def of(x: np.ndarray) -> np.ndarray:
        if most >= x.shape[1] or least >= most or not least:
            return np.zeros(len(x))
        c = np.fft.ifft(np.log(np.abs(np.fft.fft(x * np.hamming(x.shape[1]))) + 1e-10)).real
        return c[:, least:most].max(1) - c[:, :least].mean(1)

    return fr.per_batch(of, frames, T.DoubleType())
