"""Streams: a detector over sliding windows of samples with smoothed scores, and event-time windows with a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key long, seq long, raw double, smooth double, is_fake boolean"
STATE = "values array<double>, seen long, next long, smooth double, windows long"


def step(values: list[float], state: tuple | None, size: int, hop: int, ring: int, alpha: float, score: Callable[[list[float]], float]) -> tuple[tuple, tuple | None]:
    """One push of samples: the new state, and the one result it may emit.

    At most one window is scored for a push, the latest; the ring drops its oldest samples. The
    smoothed score starts at the first raw one and moves by alpha of the difference.
    """
    held, seen, due, smooth, windows = state or ([], 0, size, None, 0)
    held = ([*held, *values])[-ring:]
    seen += len(values)
    if seen < due or len(held) < size:
        return (held, seen, due, smooth, windows), None
    window = held[-size:]
    top = max(map(abs, window)) or 1.0
    raw = score([v / top for v in window])
    smooth = raw if smooth is None else alpha * raw + (1 - alpha) * smooth
    due = seen + hop
    windows += 1
    return (held, seen, due, smooth, windows), (windows, raw, smooth)


def mean_square(window: list[float]) -> float:
    """A stand-in for a model: the mean square of a window scaled to its peak."""
    return sum(v * v for v in window) / len(window)


def detect(stream: DataFrame, key: str, at: list[str], value: str, size: int = 8, hop: int = 4, ring: int = 64, alpha: float = 0.3, threshold: float = 0.5, score: Callable[[list[float]], float] = mean_square) -> DataFrame:
    """Results (key, seq, raw, smooth, is_fake) of a stream of samples. Within a micro-batch a key's samples are ordered by `at` and pushed hop by hop."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(at)[value].tolist()  # a key's samples of one micro-batch
        now = state.get if state.exists else None
        if now is not None:
            held, seen, due, smooth, windows = now
            now = (list(held), seen, due, smooth, windows)
        out = []
        for a in range(0, len(rows), hop):
            now, found = step(rows[a : a + hop], now, size, hop, ring, alpha, score)
            if found:
                out.append((k[0], *found, found[2] > threshold))
        state.update(now)
        yield pd.DataFrame(out, columns=["key", "seq", "raw", "smooth", "is_fake"])

    return stream.select(F.col(key).alias("key"), *at, value).groupBy("key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Counts and sums per event type and sliding window of event time; works on a batch as well as a stream."""
    at = F.window("ts", size, slide)
    return events.withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
