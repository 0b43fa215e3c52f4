"""Speech as intervals: where clips speak and pause, vowels and consonants, syllables, rhythm and rates.

Frames are judged one by one; stretches of frames become intervals of samples, sets of
intervals are combined by sweeps (``intervals``), and peaks of the energy are picked by chains (``peaks``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a
from lumisonde.functions import frames as fr
from lumisonde.functions import voice
from lumisonde.operators import intervals, peaks


def frame_energy(clips: DataFrame, key: str, x: str, size: int, hop: int) -> DataFrame:
    """(key, frame, e): the energy of each full frame."""
    return fr.cut(clips, key, x, size, hop).select(key, "frame", a.energy(F.col("w")).alias("e"))


def whole(clips: DataFrame, key: str, x: str) -> DataFrame:
    """(key, start, end) of the clips themselves."""
    return clips.select(key, F.lit(0).cast("bigint").alias("start"), F.size(x).cast("bigint").alias("end"))


def speech(clips: DataFrame, key: str, x: str, size: int, hop: int, threshold: float = 0.01) -> DataFrame:
    """Stretches of frames whose mean energy is over a threshold; one that lasts to the last frame ends with the clip."""
    e = frame_energy(clips, key, x, size, hop)
    spans = intervals.runs(e, [key], "frame", F.col("e") / size > threshold, hop)
    ends = clips.select(key, F.size(x).alias("n_")).withColumn("last_", F.floor((F.col("n_") - size) / hop) * hop + hop)
    found = spans.join(ends, key)
    return found.select(key, F.col("start").cast("bigint").alias("start"), F.when(F.col("end") == F.col("last_"), F.col("n_")).otherwise(F.col("end")).cast("bigint").alias("end"))


def pauses(clips: DataFrame, key: str, x: str, size: int, hop: int, threshold: float = 0.01) -> DataFrame:
    """What of a clip no speech covers."""
    return intervals.gaps(speech(clips, key, x, size, hop, threshold), whole(clips, key, x), [key])


def vowels(clips: DataFrame, key: str, x: str, size: int, hop: int, energy: float = 0.001, periodic: float = 0.3) -> DataFrame:
    """Stretches of frames with some energy and a repetition: an autocorrelation at some lag over a share of that at none."""
    w = fr.cut(clips, key, x, size, hop).withColumn("w", F.zip_with("w", fr.hann(size), lambda v, h: v * h))
    w = w.withColumn("r_", voice.autocorrelations(F.col("w"), size - 1))
    first = F.get("r_", F.lit(0))
    holds = (first > energy) & (F.array_max(F.slice("r_", 2, size)) > periodic * first)
    return intervals.runs(w, [key], "frame", holds, hop).select(key, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def consonants(clips: DataFrame, key: str, x: str, size: int, hop: int) -> DataFrame:
    """What of speech is no vowel."""
    return intervals.difference(speech(clips, key, x, size, hop), vowels(clips, key, x, size, hop), [key])


def smoothing(window: int, degree: int) -> np.ndarray:
    """A row for each place of a window: the weights that give there the value of the polynomial of least squares."""
    x = np.arange(window) - window // 2
    basis = np.vander(x, degree + 1, increasing=True).astype(float)
    return basis @ np.linalg.pinv(basis)


def smoothed(values: Column, window: int = 21, degree: int = 3) -> Column:
    """Arrays smoothed by polynomials over windows, the first and last window standing for the ends; short arrays take a window of their own length, made odd."""

    def of(v: np.ndarray) -> np.ndarray:
        n = v.shape[1]
        w = max(3, min(window, n if n % 2 else n - 1))
        if n < w:
            return v
        s, h = smoothing(w, min(degree, w - 1)), w // 2
        middle = np.lib.stride_tricks.sliding_window_view(v, w, axis=1) @ s[h]
        return np.concatenate([v[:, :w] @ s[:h].T, middle, v[:, n - w :] @ s[h + 1 :].T], axis=1)

    return fr.per_batch(of, values)


def beats(clips: DataFrame, key: str, x: str, size: int, hop: int, rate: float, smooth: bool = True, apart: float = 0.1) -> DataFrame:
    """(key, frame, e): peaks of the (smoothed) energy of at least its mean, the highest first, not less than a time apart."""
    rows = F.sort_array(F.collect_list(F.struct("frame", "e")))  # a number for each frame of a clip, less than the clip itself
    each = frame_energy(clips, key, x, size, hop).groupBy(key).agg(F.transform(rows, lambda r: r["e"]).alias("env_"))
    if smooth:
        each = each.withColumn("env_", smoothed(F.col("env_")))
    each = each.withColumn("mean_", a.mean(F.col("env_")))
    found = each.select(key, "mean_", F.posexplode("env_").alias("frame", "e")).withColumn("frame", F.col("frame").cast("bigint"))
    high = peaks.candidates(found, [key], "frame", "e").join(each.select(key, "mean_"), key).where(F.col("e") >= F.col("mean_")).drop("mean_")
    return peaks.picked(high, [key], "frame", "e", max(1, int(apart * rate / hop)), highest=True)


def rhythm(clips: DataFrame, key: str, x: str, size: int, hop: int, rate: float) -> DataFrame:
    """(key, beats, interval_mean, interval_std, regularity, per_minute) of the unsmoothed energy; clips with fewer than two beats have nulls."""
    from lumisonde.operators.ranks import ordered

    b = ordered(beats(clips, key, x, size, hop, rate, smooth=False), [key], ["frame"], before={"last_": "frame"})
    d = (F.col("frame") - F.col("last_")) * hop / rate
    out = b.groupBy(key).agg(F.count(F.lit(1)).alias("beats"), F.avg(d).alias("interval_mean"), F.stddev_pop(d).alias("interval_std"))
    return out.withColumns({"regularity": 1 / (1 + F.col("interval_std")), "per_minute": 60 / F.col("interval_mean")})


def summary(clips: DataFrame, key: str, x: str, size: int, hop: int, rate: float) -> DataFrame:
    """Per clip: speech and pauses (number, seconds, longest), breathing pauses (0.2 to 2 s), continuous speech (half a second or more), vowels, consonants and their ratio, syllables (one at least) and their rate."""
    seconds = (F.col("end") - F.col("start")) / rate

    def told(spans: DataFrame, name: str) -> DataFrame:
        return spans.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_count"), F.sum(seconds).alias(f"{name}_seconds"), F.max(seconds).alias(f"{name}_longest"))

    spoken, silent = speech(clips, key, x, size, hop), pauses(clips, key, x, size, hop)
    out = clips.select(key, (F.size(x) / rate).alias("seconds"))
    parts = [told(spoken, "speech"), told(silent, "pause"), told(vowels(clips, key, x, size, hop), "vowel"), told(consonants(clips, key, x, size, hop), "consonant")]
    parts += [silent.groupBy(key).agg(F.count_if((seconds >= 0.2) & (seconds <= 2)).alias("breathing")), spoken.groupBy(key).agg(F.count_if(seconds >= 0.5).alias("continuous"))]
    parts.append(beats(clips, key, x, size, hop, rate).groupBy(key).agg(F.count(F.lit(1)).alias("syllables")))
    for p in parts:
        out = out.join(p, key, "left")
    out = out.select(key, "seconds", *[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in out.dtypes if c not in (key, "seconds")])
    n = F.greatest(F.col("syllables"), F.lit(1))
    ratio = F.when(F.col("vowel_count") > 0, F.col("consonant_count") / F.col("vowel_count")).otherwise(0.0)
    return out.withColumns({"syllables": n, "syllable_rate": F.when(F.col("seconds") > 0, n / F.col("seconds")).otherwise(0.0), "pause_ratio": F.when(F.col("seconds") > 0, F.col("pause_seconds") / F.col("seconds")).otherwise(0.0), "consonant_vowel_ratio": ratio})
