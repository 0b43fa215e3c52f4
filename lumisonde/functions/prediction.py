"""Linear prediction of frames: coefficients, reflections, error, stability, cepstra and formants.

Levinson's recursion is a fold over the autocorrelations of a frame, with the coefficients, the
error and the reflections as its state. Coefficients predict: x[t] is about sum of c[k] x[t - 1 - k].
Poles of a batch of predictors are eigenvalues of stacked companion matrices, in numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisonde.functions import arrays as a
from lumisonde.functions import frames as fr

SOLVED = "struct<c: array<double>, e: double, k: array<double>, open: boolean>"


def levinson(r: Column, order: int) -> Column:
    """(c, e, k) from autocorrelations: coefficients, remaining error, reflections. Silence has zeros; a step that would leave no error is the last."""
    nothing = F.array().cast("array<double>")
    start = F.struct(nothing.alias("c"), F.get(r, F.lit(0)).alias("e"), nothing.alias("k"), F.lit(True).alias("open")).cast(SOLVED)

    def step(s: Column, i: Column) -> Column:
        c = s["c"]
        ahead = F.aggregate(F.zip_with(c, F.reverse(F.slice(r, F.lit(2), i)), lambda x, y: x * y), F.lit(0.0), lambda u, v: u + v)
        k = (F.get(r, i + 1) - ahead) / s["e"]

        def grown(k: Column) -> Column:
            e = s["e"] * (1 - k * k)
            more = F.concat(F.zip_with(c, F.reverse(c), lambda x, y: x - k * y), F.array(k))
            return F.struct(more.alias("c"), e.alias("e"), F.concat(s["k"], F.array(k)).alias("k"), (e > 0).alias("open")).cast(SOLVED)

        rest = F.struct(F.concat(c, F.array(F.lit(0.0))).alias("c"), s["e"].alias("e"), F.concat(s["k"], F.array(F.lit(0.0))).alias("k"), F.lit(False).alias("open")).cast(SOLVED)
        return F.when(s["open"] & (s["e"] > 0), a.let(k, grown)).otherwise(rest)

    return F.aggregate(F.sequence(F.lit(0), F.lit(order - 1)), start, step, lambda s: F.struct(s["c"].alias("c"), s["e"].alias("e"), s["k"].alias("k")))


def predicted(frames: DataFrame, order: int, w: str = "w") -> DataFrame:
    """frames with c, e and k of each, from the samples in w."""
    from lumisonde.functions.voice import autocorrelations

    out = frames.withColumn("r_", autocorrelations(F.col(w), order)).withColumn("s_", levinson(F.col("r_"), order))
    return out.select(*frames.columns, F.col("r_").alias("r"), "s_.c", "s_.e", "s_.k")


def cepstrum(c: Column, n: int) -> Column:
    """The first n cepstral coefficients of a predictor: each is its own coefficient and those before it, weighted."""

    def step(s: Column, i: Column) -> Column:
        part = F.transform(s, lambda q, j: (j + 1) / (i + 1) * q * F.coalesce(F.get(c, i - j - 1), F.lit(0.0)))
        return F.concat(s, F.array(F.coalesce(F.get(c, i), F.lit(0.0)) + F.aggregate(part, F.lit(0.0), lambda u, v: u + v)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array().cast("array<double>"), step)


def quality(frames: DataFrame) -> DataFrame:
    """frames (r, c, e, k) with the gain of prediction in dB, the share of reflections below 1, the last of them over 0.1, and whether the predictor is stable."""
    k = F.col("k")
    stable = F.size(F.filter(k, lambda v: F.abs(v) < 1))
    last = F.aggregate(F.transform(k, lambda v, i: F.when(F.abs(v) > 0.1, i + 1).otherwise(0)), F.lit(0), lambda u, v: F.greatest(u, v))
    power = F.get("r", F.lit(0))
    gain = F.when((power > 0) & (F.col("e") > 0), 10 * F.log10(power / F.col("e"))).otherwise(0.0)
    return frames.withColumns({"gain": gain, "below_one": stable / F.size(k), "effective_order": last, "stable": stable == F.size(k)})


def preemphasized(x: Column, by: float = 0.97) -> Column:
    """Each sample less a share of the one before; the first stays."""
    return F.transform(x, lambda v, i: v - by * F.coalesce(F.get(x, i - 1), F.lit(0.0)))


def poles(r: np.ndarray) -> np.ndarray:
    """(real, imaginary) of the poles of the predictor of each row of autocorrelations: eigenvalues of its companion matrix. Silence, and what no predictor fits, has poles at 0."""
    n = r.shape[1] - 1
    lag = np.abs(np.arange(n)[:, None] - np.arange(n))
    good = np.isfinite(r).all(1) & (r[:, 0] > 0)
    toeplitz = np.where(good[:, None, None], r[:, lag], np.eye(n))
    toeplitz = toeplitz + np.eye(n) * (1e-12 * np.abs(toeplitz).max(axis=(1, 2), keepdims=True))
    companion = np.zeros((len(r), n, n))
    companion[:, 0, :] = np.where(good[:, None], np.linalg.solve(toeplitz, np.where(good[:, None], r[:, 1:], 0.0)[..., None])[..., 0], 0.0)
    companion[:, np.arange(1, n), np.arange(n - 1)] = 1.0
    z = np.linalg.eigvals(companion)
    return np.stack([z.real, z.imag], axis=2)


def formants(frames: DataFrame, rate: float, count: int = 4, lowest: float = 50.0) -> DataFrame:
    """frames (r) with the first formants of each predictor, as (hz, width, size) from the lowest: its poles in the upper half plane, of positive width, from 50 Hz to half the rate."""
    out = frames.withColumn("z_", fr.per_batch(lambda r: [list(map(list, z)) for z in poles(r)], F.col("r"), T.ArrayType(fr.DOUBLES)))
    pair = F.transform("z_", lambda z: F.struct(F.get(z, F.lit(0)).alias("x"), F.get(z, F.lit(1)).alias("y")))
    size = lambda p: F.hypot(p["x"], p["y"])
    upper = F.filter(pair, lambda p: (p["y"] > 1e-9) & (size(p) > 0))
    found = F.transform(upper, lambda p: F.struct((F.atan2(p["y"], p["x"]) * rate / (2 * np.pi)).alias("hz"), (-F.log(size(p)) * rate / np.pi).alias("width"), size(p).alias("size")))
    good = F.filter(found, lambda f: (f["hz"] >= lowest) & (f["hz"] <= rate / 2) & (f["width"] > 0))
    return out.withColumn("formants", F.slice(F.array_sort(good), 1, count)).drop("z_")


def formant_frames(clips: DataFrame, key: str, x: str, size: int, hop: int, rate: float, count: int = 4, by: float = 0.97) -> DataFrame:
    """(key, frame, formants): by prediction of the pre-emphasized frames under a Hamming window; the order follows the rate, 16 at most."""
    order = int(min(2 + rate // 1000, 16))
    from lumisonde.functions.voice import autocorrelations

    cut = fr.cut(clips, key, x, size, hop).withColumn("w", preemphasized(F.col("w"), by)).withColumn("w", F.zip_with("w", fr.hamming(size), lambda v, h: v * h))
    return formants(cut.withColumn("r", autocorrelations(F.col("w"), order)), rate, count).select(key, "frame", "formants")


def formant_statistics(frames: DataFrame, key: str, count: int = 4) -> DataFrame:
    """Per clip: mean and deviation of each formant's frequency, means of its width; F2/F1 and F3/F2 (mean, deviation), F2 drawn a tenth towards F3, the area of the F1-F2 triangle of 10th and 90th percentiles (0 from fewer than three frames), and the deviation of all frequencies together."""
    f = lambda i: F.get("formants", F.lit(i))["hz"]
    q = lambda i, p: F.percentile(F.when(f(1).isNotNull(), f(i)), F.lit(p))
    made = [g(x).alias(f"f{i + 1}_{n}") for i in range(count) for n, g, x in (("mean", F.avg, f(i)), ("std", F.stddev_pop, f(i)), ("width", F.avg, F.get("formants", F.lit(i))["width"]))]
    made += [g(f(i + 1) / f(i)).alias(f"f{i + 2}_f{i + 1}_{n}") for i in (0, 1) for n, g in (("mean", F.avg), ("std", F.stddev_pop))]
    area = 0.5 * F.abs((q(0, 0.9) - q(0, 0.1)) * (q(1, 0.1) - q(1, 0.9)))
    made += [F.avg(f(1) + 0.1 * (f(2) - f(1))).alias("effective_f2"), F.when(F.count(f(1)) >= 3, area).otherwise(0.0).alias("vowel_area")]
    # deviation of all frequencies from counts, sums and squares of each formant
    each = F.transform("formants", lambda p: p["hz"])
    n, s, ss = F.sum(F.size("formants")), F.sum(a.total(each)), F.sum(a.energy(each))
    made.append(F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), ss / n - F.pow(s / n, F.lit(2))))).otherwise(0.0).alias("dispersion"))
    return frames.groupBy(key).agg(*made)
