"""State of jobs in a stream that is forgotten after a time: short while a job runs, longer once it has ended.

Each key keeps its last status, its last scores (a bounded number) and when it expires. A timer
removes the key's state; a status that arrives later begins anew, and a status ``reset`` clears the scores at once.
Time is that of events, so a replay gives the same rows. The session needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Milliseconds that a status lives: of a job that goes on, and of one that has ended.
ACTIVE, ENDED = 30_000, 300_000
ENDS = ("done", "failed")
#: Scores that are kept.
HISTORY = 100
OUT = "key string, at timestamp, status string, seen int, mean double, event string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def life(status: str) -> int:
    return ENDED if status in ENDS else ACTIVE


def step(held: tuple[str, list[float], int] | None, at: int, status: str, score: float | None, most: int = HISTORY) -> tuple[str, list[float], int]:
    """A key's state (status, scores, expiry) after one row."""
    scores = [] if held is None or status == "reset" else list(held[1])
    if score is not None and status != "reset":
        scores = (scores + [score])[-most:]
    return status, scores, at + life(status)


class Status(StatefulProcessor):
    """Emits a row for each input row, in order of time within a batch, and one when a key expires."""

    def __init__(self, most: int = HISTORY):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "status string, scores array<double>, expires long")

    def _row(self, key, at: int, status: str, scores: list[float], event: str) -> pd.DataFrame:
        mean = sum(scores) / len(scores) if scores else float("nan")
        return pd.DataFrame({"key": [key[0]], "at": [pd.Timestamp(at, unit="ms")], "status": [status], "seen": pd.array([len(scores)], "int32"), "mean": [mean], "event": [event]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.held.get() if self.held.exists() else None
        state = (state[0], list(state[1]), state[2]) if state else None
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            at = int(r.at.value // 1_000_000)
            if state and at > state[2]:
                yield self._row(key, state[2], state[0], state[1], "expired")
                state = None
            state = step(state, at, r.status, None if pd.isna(r.score) else float(r.score), self.most)
            yield self._row(key, at, state[0], state[1], "update")
        self.held.update((state[0], state[1], state[2]))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(state[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            state = self.held.get()
            self.held.clear()
            yield self._row(key, state[2], state[0], list(state[1]), "expired")

    def close(self) -> None:
        pass


def tracked(stream: DataFrame, key: str, late: str = "1 minute", most: int = HISTORY) -> DataFrame:
    """stream (key, at, status, score) with a row for every update and expiry of a key's status."""
    rows = stream.select(stream[key].cast("string").alias("key"), "at", "status", "score").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Status(most), outputStructType=StructType.fromDDL(OUT), outputMode="Append", timeMode="EventTime")
