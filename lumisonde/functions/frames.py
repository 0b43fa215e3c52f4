"""Short-time analysis: clips to frames, frames to magnitudes, then features of frames as expressions and of clips as aggregates.

A frame is a row, cut from its clip where the row is made, so no array holds more than one of them. Transforms and
products with matrices (filter banks, cosines) of a batch of frames are numpy; a bank of any size is one matrix in the function, not literals in the plan.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisonde.functions import arrays as a

TINY = 1e-10
DOUBLES = T.ArrayType(T.DoubleType())


def batched(frames: pd.Series, of: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """of, applied to the frames of each length at once; none for none."""
    out: list = [None] * len(frames)
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(frames):
        if x is not None and len(x):
            by_size.setdefault(len(x), []).append(i)
    for rows in by_size.values():
        for i, v in zip(rows, of(np.stack([frames.iloc[i] for i in rows]))):
            out[i] = v
    return pd.Series(out, dtype=object)


def per_batch(of: Callable[[np.ndarray], np.ndarray], frames: Column, kind: T.DataType = DOUBLES) -> Column:
    """A function of stacked frames, as a column; declared nondeterministic so that no plan computes it twice for a row, or within a lambda."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = batched(b, of)
            yield out.astype(float) if kind == T.DoubleType() else out

    return run.asNondeterministic()(frames)


def magnitudes(frames: Column) -> Column:
    """Magnitudes of the transform of each frame."""
    return per_batch(lambda x: np.abs(np.fft.rfft(x)), frames)


def through(x: Column, matrix: np.ndarray, squared: bool = False) -> Column:
    """The product of a matrix with each frame (or its squares)."""
    m = np.ascontiguousarray(np.asarray(matrix, float).T)
    return per_batch(lambda v: (v * v if squared else v) @ m, x)


def hann(n: int) -> Column:
    return constants(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))


def hamming(n: int) -> Column:
    return constants(0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))


def constants(values: Sequence[float]) -> Column:
    """One literal that holds all the numbers: a text that the optimizer reads once."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), DOUBLES)


def dot(x: Column, y: Column) -> Column:
    return a.total(F.zip_with(x, y, lambda p, q: p * q))


def cut(clips: DataFrame, key: str, x: str, size: int, hop: int) -> DataFrame:
    """(key, frame, w): all full frames of each clip, a row each."""
    last = F.floor((F.size(x) - size) / hop).cast("int")
    each = clips.where(F.size(x) >= size).select(key, x, F.explode(F.sequence(F.lit(0), last)).alias("frame"))
    return each.select(key, "frame", F.slice(x, F.col("frame") * hop + 1, size).alias("w"))


def transformed(clips: DataFrame, key: str, x: str, size: int, hop: int, window: Column | None = None) -> DataFrame:
    """(key, frame, m): magnitudes of all full frames of each clip, under a window (Hann unless given)."""
    shaped = F.zip_with("w", hann(size) if window is None else window, lambda v, h: v * h)
    return cut(clips, key, x, size, hop).select(key, "frame", magnitudes(shaped).alias("m"))


def spectral(frames: DataFrame, key: str, size: int, rate: float) -> DataFrame:
    """frames (key, frame, m) with features of each: moments of frequency, shape of magnitudes, and change since the frame before."""
    bins = size // 2 + 1
    hz = [k * rate / size for k in range(bins)]
    f, k, m = constants(hz), constants(range(bins)), F.col("m")
    total = a.total(m)
    out = frames.withColumn("sum_", total).withColumn("p_", F.transform(m, lambda v: v / (F.col("sum_") + TINY)))
    p, c = F.col("p_"), F.col("centroid")
    out = out.withColumn("centroid", dot(f, p))
    central = lambda n: dot(F.transform(f, lambda v: F.pow(v - c, F.lit(n))), p)
    out = out.withColumn("spread", central(2))
    deviation = F.sqrt("spread") + TINY
    power = F.transform(m, lambda v: v * v)
    # bins passed and power so far, until the share is reached
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"))
    passed = lambda limit: F.aggregate(power, start, lambda s, v: F.when(s["sum"] >= limit, s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["sum"] + v).alias("sum"))), lambda s: s["n"])
    log_f = [math.log(v) for v in hz[1:]]
    mean_f = sum(log_f) / len(log_f)
    off = [v - mean_f for v in log_f]
    log_m = F.transform(F.slice(m, 2, bins), lambda v: F.log(v + TINY))
    before = F.lag("m").over(Window.partitionBy(key).orderBy("frame"))
    first = F.get(m, F.lit(0))
    jumps = F.zip_with(F.slice(m, 1, bins - 1), F.slice(m, 2, bins), lambda u, v: F.abs(u - v))
    out = out.withColumns(
        {
            "skewness": central(3) / F.pow(deviation, F.lit(3)),
            "kurtosis": central(4) / F.pow(deviation, F.lit(4)) - 3,
            "entropy": -a.total(F.transform(p, lambda v: v * F.log2(v + TINY))),
            "rolloff": F.element_at(f, F.greatest(F.lit(1), a.let(0.85 * a.total(power), passed))),
            "flatness": F.exp(a.mean(F.transform(m, lambda v: F.log(v + TINY)))) / (a.mean(m) + TINY),
            "crest": F.array_max(m) / (a.mean(m) + TINY),
            "slope": dot(constants(off), log_m) / sum(v * v for v in off),
            "decrease": F.when(first > 0, dot(k, F.transform(m, lambda v: v - first)) / (dot(k, F.array_repeat(F.lit(1.0), bins)) * first)).otherwise(0.0),
            "irregularity": a.total(jumps) / (F.col("sum_") + TINY),
            "flux": F.when(before.isNull(), 0.0).otherwise(a.total(F.zip_with(m, before, lambda u, v: F.greatest(u - v, F.lit(0.0))))),
        }
    )
    return out.drop("sum_", "p_")


def summarized(frames: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation (population), least and largest value of each feature over a clip's frames."""
    made = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return frames.groupBy(key).agg(*made)


# -- filter banks and cepstra --------------------------------------------------------------------


def triangles(edges: Sequence[float], size: int, rate: float) -> list[list[float]]:
    """Weights of each bin in triangular bands between neighbouring edges in Hz."""
    hz = [k * rate / size for k in range(size // 2 + 1)]
    rise = lambda f, lo, mid: (f - lo) / (mid - lo)
    return [[max(0.0, min(rise(f, lo, mid), rise(f, hi, mid))) for f in hz] for lo, mid, hi in zip(edges, edges[1:], edges[2:])]


def mel_edges(bands: int, low: float, high: float) -> list[float]:
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    step = (mel(high) - mel(low)) / (bands + 1)
    return [700 * (10 ** ((mel(low) + step * k) / 2595) - 1) for k in range(bands + 2)]


def linear_edges(bands: int, low: float, high: float) -> list[float]:
    return [low + (high - low) * k / (bands + 1) for k in range(bands + 2)]


def bands(m: Column, filters: Sequence[Sequence[float]]) -> Column:
    """The power of a frame in each band."""
    return through(m, np.array(filters), squared=True)


def cosines(x: Column, bands_: int, n: int) -> Column:
    """The first n coefficients of the orthonormal cosine transform, type two."""
    j, k = np.arange(n)[:, None], np.arange(bands_)
    basis = np.cos(np.pi * j * (2 * k + 1) / (2 * bands_)) * np.sqrt(np.where(j == 0, 1, 2) / bands_)
    return through(x, basis)


def decibels(frames: DataFrame, key: str, x: str, floor: float = TINY) -> DataFrame:
    """Powers as dB below the clip's largest one."""
    top = frames.groupBy(key).agg(F.max(F.array_max(x)).alias("top_"))
    db = F.transform(x, lambda v: 10 * (F.log10(F.greatest(v, F.lit(floor))) - F.log10(F.greatest(F.col("top_"), F.lit(floor)))))
    return frames.join(top, key).withColumn(x, db).drop("top_")


def mfcc(frames: DataFrame, key: str, size: int, rate: float, n: int = 13, count: int = 20, low: float = 80.0, high: float = 8000.0, lifter: int = 22, centred: bool = True) -> DataFrame:
    """frames with liftered coefficients of log mel powers, less each coefficient's mean over the clip."""
    logs = F.transform(bands(F.col("m"), triangles(mel_edges(count, low, min(high, rate / 2)), size, rate)), lambda v: F.log(v + TINY))
    lift = constants([1 + lifter / 2 * math.sin(math.pi * j / lifter) for j in range(n)])
    out = frames.withColumn("mfcc", F.zip_with(cosines(logs, count, n), lift, lambda u, v: u * v))
    if not centred:
        return out
    means = out.groupBy(key).agg(F.array(*[F.avg(F.get("mfcc", F.lit(j))) for j in range(n)]).alias("mean_"))
    return out.join(means, key).withColumn("mfcc", F.zip_with("mfcc", "mean_", lambda u, v: u - v)).drop("mean_")


def lfcc(frames: DataFrame, size: int, rate: float, n: int = 13, count: int = 20) -> DataFrame:
    """frames with coefficients of log powers in bands of equal width."""
    logs = F.transform(bands(F.col("m"), triangles(linear_edges(count, 0.0, rate / 2), size, rate)), lambda v: F.log(v + 1e-6))
    return frames.withColumn("lfcc", cosines(logs, count, n))


def delta(frames: DataFrame, key: str, x: str, reach: int = 2, into: str = "delta") -> DataFrame:
    """Slope of each coefficient over the frames around, the first and last frame standing for those beyond the clip's ends."""
    w = Window.partitionBy(key).orderBy("frame")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = lambda j: F.coalesce(F.lead(x, j).over(w), F.last(x).over(whole))
    behind = lambda j: F.coalesce(F.lag(x, j).over(w), F.first(x).over(whole))
    norm = 2 * sum(j * j for j in range(1, reach + 1))
    slope = lambda j: F.zip_with(ahead(j), behind(j), lambda u, v: j * (u - v) / norm)
    out = slope(1)
    for j in range(2, reach + 1):
        out = F.zip_with(out, slope(j), lambda u, v: u + v)
    return frames.withColumn(into, out)
