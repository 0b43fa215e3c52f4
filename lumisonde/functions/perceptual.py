"""Perceptual measures of frames of magnitudes: auditory bands, loudness, roughness, harmonicity, tonality, pitch classes.

Frames are rows with m, the magnitudes of a transform of ``size`` samples. Sums over bands are products with a
matrix, a batch at a time; what follows are expressions over the few bands of a frame.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a
from lumisonde.functions import frames as fr

TINY = 1e-10
#: Borders in Hz of the bands whose shares of power are told; each holds both its borders.
SUBBANDS = ((0, 500), (500, 1000), (1000, 2000), (2000, 4000), (4000, 8000))


def hertz(size: int, rate: float) -> np.ndarray:
    return np.arange(size // 2 + 1) * rate / size


def bark_of(hz: np.ndarray) -> np.ndarray:
    return 13 * np.arctan(0.00076 * hz) + 3.5 * np.arctan((hz / 7500) ** 2)


def erb_of(hz: np.ndarray) -> np.ndarray:
    return 21.4 * np.log10(1 + 0.00437 * hz)


def scale_bands(size: int, rate: float, scale: str, count: int) -> np.ndarray:
    """A row for each of count equal bands of the bark or erb scale up to half the rate, 1 where a bin lies in it."""
    z = {"bark": bark_of, "erb": erb_of}[scale](hertz(size, rate))
    band = np.minimum((z / z[-1] * count).astype(int), count - 1)
    return (band == np.arange(count)[:, None]).astype(float)


def band_measures(frames: DataFrame, size: int, rate: float, scale: str = "bark", count: int = 24) -> DataFrame:
    """frames with <scale>_centroid, _spread (deviation) and _entropy (bits) of the shares of power in the bands, by number of band."""
    out = frames.withColumn("e_", fr.through(F.col("m"), scale_bands(size, rate, scale, count), squared=True))
    out = out.withColumn("p_", a.let(a.total(F.col("e_")), lambda t: F.transform("e_", lambda v: v / (t + TINY))))
    centre = F.aggregate(F.transform("p_", lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v)
    out = out.withColumn("c_", centre)
    spread = F.sqrt(F.aggregate(F.transform("p_", lambda v, i: v * (i - F.col("c_")) * (i - F.col("c_"))), F.lit(0.0), lambda s, v: s + v))
    entropy = F.aggregate("p_", F.lit(0.0), lambda s, v: s - v * F.log2(v + TINY))
    return out.withColumns({f"{scale}_centroid": F.col("c_"), f"{scale}_spread": spread, f"{scale}_entropy": entropy}).drop("e_", "p_", "c_")


def loudness(frames: DataFrame, size: int, rate: float) -> DataFrame:
    """frames with loudness (mean of the power's share of the largest to the 0.3) and sharpness (bands above 15.8 bark weigh more)."""
    z = bark_of(hertz(size, rate))
    weight = np.where(z > 15.8, 0.066 * np.exp(0.171 * z), 1.0)
    power = F.transform("m", lambda v: v * v)
    top = F.array_max(power)
    loud = F.when(top > 0, a.mean(a.let(top, lambda t: F.transform(power, lambda v: F.pow(v / t, F.lit(0.3)))))).otherwise(0.0)
    sums = frames.withColumn("w_", fr.through(F.col("m"), np.stack([weight * z, np.ones(len(z))]), squared=True))
    sharp = F.when(F.get("w_", F.lit(1)) > 0, 0.11 * F.get("w_", F.lit(0)) / F.get("w_", F.lit(1))).otherwise(0.0)
    return sums.withColumns({"loudness": loud, "sharpness": sharp}).drop("w_")


def roughness(m: Column, size: int, rate: float, reach: int = 4) -> Column:
    """Sum over pairs of bins at most reach apart of the product of their magnitudes, less the farther apart."""
    bins, step = size // 2 + 1, rate / size
    part = lambda k: math.exp(-k * step / 100) * fr.dot(F.slice(m, 1, bins - k), F.slice(m, k + 1, bins - k))
    return sum((part(k) for k in range(1, reach + 1)), F.lit(0.0))


def subbands(m: Column, size: int, rate: float) -> dict[str, Column]:
    """Shares of the power in SUBBANDS and above 4 kHz."""
    hz = hertz(size, rate)
    power = F.transform(m, lambda v: v * v)
    whole = a.total(power) + TINY

    def share(low: float, high: float) -> Column:
        at = np.flatnonzero((hz >= low) & (hz <= high))
        return a.total(F.slice(power, int(at[0]) + 1, len(at))) / whole if len(at) else F.lit(0.0)

    out = {f"band_{low}_{high}": share(low, high) for low, high in SUBBANDS}
    above = np.flatnonzero(hz > 4000)
    return out | {"high_share": a.total(F.slice(power, int(above[0]) + 1, len(above))) / whole if len(above) else F.lit(0.0)}


def spectral_peaks(m: Column, share: float = 0.1) -> Column:
    """(bin, size) of bins above both neighbours and a share of the largest."""
    top = F.array_max(m)
    each = F.transform(m, lambda v, i: F.struct(i.alias("bin"), v.alias("size"), F.coalesce(F.get(m, i - 1), F.lit(float("inf"))).alias("before"), F.coalesce(F.get(m, i + 1), F.lit(float("inf"))).alias("after")))
    return a.let(top, lambda t: F.filter(each, lambda p: (p["size"] > p["before"]) & (p["size"] > p["after"]) & (p["size"] >= share * t)))


def harmonicity(frames: DataFrame, size: int, rate: float) -> DataFrame:
    """frames with inharmonicity (mean over peaks of their distance from the nearest multiple of the strongest one, in its units, weighted by size) and tonality (share of the power in peaks); 0 without peaks."""
    out = frames.withColumn("peaks_", spectral_peaks(F.col("m")))
    best = F.element_at(F.array_sort(F.transform("peaks_", lambda p: F.struct((-p["size"]).alias("s"), p["bin"].alias("b")))), 1)["b"]
    out = out.withColumn("f_", F.when(F.size("peaks_") > 0, best))
    ratio = lambda p: p["bin"] / F.col("f_")
    off = F.aggregate(F.transform("peaks_", lambda p: p["size"] * F.abs(ratio(p) - F.greatest(F.floor(ratio(p) + 0.5), F.lit(1)))), F.lit(0.0), lambda s, v: s + v)
    weight = F.aggregate(F.transform("peaks_", lambda p: p["size"]), F.lit(0.0), lambda s, v: s + v)
    power = F.aggregate(F.transform("peaks_", lambda p: p["size"] * p["size"]), F.lit(0.0), lambda s, v: s + v)
    some = F.size("peaks_") > 0
    return out.withColumns({"inharmonicity": F.when(some & (weight > 0), off / weight).otherwise(0.0), "tonality": F.when(some, power / (a.energy(F.col("m")) + TINY)).otherwise(0.0)}).drop("peaks_", "f_")


def tilt(m: Column, size: int, rate: float, low: float = 100.0, high: float = 8000.0) -> Column:
    """Slope of a straight line through the magnitudes in dB over frequency, in dB a Hz."""
    hz = hertz(size, rate)
    at = np.flatnonzero((hz >= low) & (hz <= high))
    x = hz[at] - hz[at].mean()
    db = F.transform(F.slice(m, int(at[0]) + 1, len(at)), lambda v: 20 * F.log10(v + TINY))
    return fr.dot(fr.constants(x), db) / float((x * x).sum())


def chroma_matrix(size: int, rate: float, tuning: float = 440.0) -> np.ndarray:
    """A row for each of the twelve pitch classes from C, 1 where a bin (but the first) is nearest to it."""
    hz = hertz(size, rate)[1:]
    number = np.round(12 * np.log2(hz / tuning)).astype(int) + 9
    return np.column_stack([np.zeros(12), (number % 12 == np.arange(12)[:, None]).astype(float)])


def chroma(frames: DataFrame, size: int, rate: float) -> DataFrame:
    """frames with the power of each pitch class over the largest of the frame."""
    out = frames.withColumn("h_", fr.through(F.col("m"), chroma_matrix(size, rate), squared=True))
    return out.withColumn("chroma", a.let(F.array_max("h_"), lambda t: F.transform("h_", lambda v: F.when(t > 0, v / t).otherwise(0.0)))).drop("h_")
