"""Time-frequency measures: spectrograms by bin number, instantaneous phase, and resampling.

Frames are rows with m, their magnitudes. What a frame shares with the one before is a
window by clip, whose frames come from one array.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a
from lumisonde.functions import frames as fr

TINY = 1e-10


def spectrogram(frames: DataFrame, key: str, size: int) -> DataFrame:
    """frames with power, centroid and bandwidth over bin numbers, rolloff (first bin with 0.85 of the magnitudes so far), flux (sum of squared changes, 0 at first), entropy (natural, of shares of power) and concentration (share of the largest bin)."""
    m = F.col("m")
    out = frames.withColumn("s_", a.total(m))
    at = F.aggregate(F.transform(m, lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v) / (F.col("s_") + TINY)
    out = out.withColumns({"power": a.energy(m), "centroid": at})
    wide = F.aggregate(F.transform(m, lambda v, i: v * (i - F.col("centroid")) * (i - F.col("centroid"))), F.lit(0.0), lambda s, v: s + v)
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"))
    limit = 0.85 * F.col("s_")
    passed = F.aggregate(m, start, lambda s, v: F.when(s["sum"] >= limit, s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["sum"] + v).alias("sum"))), lambda s: s["n"])
    before = F.lag("m").over(Window.partitionBy(key).orderBy("frame"))
    change = F.when(before.isNull(), 0.0).otherwise(a.total(F.zip_with(m, before, lambda u, v: (u - v) * (u - v))))
    share = F.transform(m, lambda v: v * v / (F.col("power") + TINY))
    return out.withColumns({
        "bandwidth": F.sqrt(wide / (F.col("s_") + TINY)), "rolloff": F.greatest(passed - 1, F.lit(0)), "flux": change,
        "entropy": F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log(p + TINY)), "concentration": F.array_max(share),
    }).drop("s_")


def octaves(m: Column, size: int, count: int) -> Column:
    """Power in bins 1, 2 to 3, 4 to 7 and so on, as shares of the whole."""
    power = F.transform(m, lambda v: v * v)
    whole = a.total(power) + TINY
    last = size // 2 + 1
    return F.array(*[a.total(F.slice(power, 2**k + 1, max(0, min(2 ** (k + 1), last) - 2**k))) / whole for k in range(count)])


def instantaneous(frames: Column, rate: float) -> Column:
    """For each frame mean and deviation of the envelope and of the instantaneous frequency, from the analytic signal."""

    def of(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        h = np.zeros(n)
        h[0] = 1
        h[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            h[n // 2] = 1
        z = np.fft.ifft(np.fft.fft(x) * h)
        f = np.diff(np.unwrap(np.angle(z))) * rate / (2 * np.pi) if n > 1 else np.zeros((len(x), 1))
        e = np.abs(z)
        return np.column_stack([e.mean(1), e.std(1), f.mean(1), f.std(1)])

    return fr.per_batch(of, frames)


def resampled(clips: DataFrame, x: str, source: int, target: int) -> DataFrame:
    """clips at another rate: the same spectrum up to half the lower rate, by a transform of the whole clip."""

    def of(v: np.ndarray) -> list[np.ndarray]:
        n = max(1, round(v.shape[1] * target / source))
        s = np.fft.rfft(v)
        kept = min(s.shape[1], n // 2 + 1)
        out = np.zeros((len(v), n // 2 + 1), complex)
        out[:, :kept] = s[:, :kept]
        if n % 2 == 0 and kept == n // 2 + 1 and n < v.shape[1]:
            out[:, -1] = out[:, -1].real  # the bin at half the rate is its own mirror
        return list(np.fft.irfft(out, n) * (n / v.shape[1]))

    return clips.withColumn(x, fr.per_batch(of, F.col(x)))


def mono(channels: Column) -> Column:
    """The mean of a clip's channels, an array of arrays of one length."""
    n = F.size(channels)
    return F.aggregate(channels, F.transform(F.get(channels, F.lit(0)), lambda v: F.lit(0.0)), lambda s, c: F.zip_with(s, c, lambda u, v: u + v / n))


def line_spectra(c: Column) -> Column:
    """Line spectral frequencies, in radians from the lowest, of each predictor."""

    def of(c: np.ndarray) -> np.ndarray:
        p = c.shape[1]
        poly = np.column_stack([np.ones(len(c)), -c, np.zeros(len(c))])
        out = []
        for q in poly:
            roots = np.concatenate([np.roots(q + q[::-1]), np.roots(q - q[::-1])])
            angles = np.sort(np.angle(roots))
            out.append(angles[(angles > 1e-6) & (angles < np.pi - 1e-6)][:p])
        return np.array([np.pad(o, (0, p - len(o)), constant_values=np.nan) for o in out])

    return fr.per_batch(of, c)


def tract_length(hz: Column, number: int, speed: float = 35_000.0) -> Column:
    """Centimetres of a tube, closed at one end, whose resonance of that number has a frequency."""
    return F.when(hz > 0, (2 * number - 1) * speed / (4 * hz))


