"""Hard negatives by a vector-approximation file.

Every component of every vector is replaced by one of 16 cells, whose borders are quantiles of
that dimension over all rows; two cells make a byte. For an anchor a table has, for each pair of
dimensions and each byte, the least and largest share that a vector in those cells can add to the
inner product. A row's bounds are sums of looked-up entries. Only rows whose bounds leave it open
whether they belong to the answer are scored from their components, so the answer is exact.

Two scans of the file: the first finds each anchor's positives, the best rows of its label; the
second, for each window of scores that a positive defines, the best rows of other labels in it.
Each task keeps the best of its own rows for each anchor, and a window over the few rows of an
anchor joins them. Anchors come in blocks of about ``ANCHORS``, broadcast one after the other, so
what is broadcast has a bound; rows are never shuffled by label, so a label with any share of
the rows is dealt evenly.

Defined cases: rows with a null identifier, label or vector, or any null or non-finite component,
take no part; a vec_id that occurs more than once counts once, with its smallest label and
vector; vectors of unequal length are continued with zeros; components are held within
+-2^24, so that scores fit in 64 bits; ties go to the smaller vec_id; an anchor without others of its label, or
a window without rows, gives no row; a positive score of zero or less has the window of its
formula (zero itself, or nothing); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisonde.llm.common import written

CELLS = 16
#: Anchors in a broadcast, on average: at 64 dimensions some 4 MB.
ANCHORS = 16_384
#: Rows that a task looks up at once, and anchors whose tables it holds.
ROWS, TABLES = 16_384, 16
#: Rows scored for a window's first threshold.
PROBES = 32
#: Scores are whole numbers: components times SCALE, rounded down, within LIMIT.
SCALE, LIMIT = 256, 1 << 24


def usable(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def whole(vector: Column) -> Column:
    """A vector's components as whole numbers."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))


class Cells(NamedTuple):
    """cuts: the upper borders of all cells but the last of each dimension; low, high: the least and largest whole number in each."""

    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray


def cells_of(rows: DataFrame) -> Cells:
    """The cells of each dimension, from quantiles of all rows; a few numbers for each dimension reach the driver."""
    each = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d")
    cuts = F.percentile_approx("v", [k / CELLS for k in range(1, CELLS)], F.lit(1000)).alias("c")
    found = {r.d: r for r in each.agg(cuts, F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    size = max(found, default=-1) + 1
    size += size % 2
    zero = (*[0] * (CELLS - 1),)
    c = np.array([sorted(found[d].c) if d in found else zero for d in range(size)], np.int64).reshape(size, CELLS - 1)
    least = np.array([min(found[d].low, 0) if d in found else 0 for d in range(size)], np.int64)  # shorter vectors are continued with zeros
    most = np.array([max(found[d].high, 0) if d in found else 0 for d in range(size)], np.int64)
    # a cell holds the numbers above the border before it, up to its own; an empty one has any bounds
    low, high = np.column_stack([least, c + 1]), np.column_stack([c, most])
    return Cells(c, low, np.maximum(low, high))


def approximations(x: np.ndarray, cells: Cells) -> np.ndarray:
    """Bytes of two cells each."""
    near = np.empty(x.shape, np.uint8)
    for d in range(x.shape[1]):
        near[:, d] = np.searchsorted(cells.cuts[d], x[:, d], "left")
    return near[:, ::2] * CELLS + near[:, 1::2]


FILE = "vec_id long, label int, cells binary, x binary"


def approximation_file(vectors: DataFrame, label: Column) -> tuple[DataFrame, Cells]:
    """(vec_id, label, cells, x) of all rows that take part, written once."""
    good = F.col("vec_id").isNotNull() & F.col("label_").isNotNull() & F.col("embedding").isNotNull() & usable(F.col("embedding"))
    rows = vectors.select("vec_id", label.alias("label_"), "embedding").where(good).select("vec_id", F.struct("label_", whole(F.col("embedding")).alias("x")).alias("v"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as asked for: the work of a row is not its size
    rows = written(rows.repartition(parts, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.col("v.label_").cast("int").alias("label"), "v.x"), "vectors")
    cells = cells_of(rows)
    size = len(cells.cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ends = lists.offsets.to_numpy()
            flat, n = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
            x = np.zeros((len(n), size), np.int32)
            x[np.arange(size) < n[:, None]] = flat[ends[0] : ends[-1]]
            near = approximations(x, cells)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in near], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "label", "cells", "x"])

    return written(rows.mapInArrow(pack, FILE), "approximations"), cells


class Rows(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    near: np.ndarray
    x: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Rows]:
    """Rows in order of their labels, about ROWS at once."""

    def rows(held: list[pa.RecordBatch]) -> Rows:
        t = pa.Table.from_batches(held)
        whole = lambda name, kind, n: np.frombuffer(b"".join(t[name].to_pylist()), kind).reshape(len(t), n)
        ids, labels = t["vec_id"].to_numpy(), t["label"].to_numpy()
        order = np.argsort(labels, kind="stable")
        return Rows(ids[order], labels[order], np.ascontiguousarray(whole("cells", np.uint8, size // 2)[order].T), whole("x", np.int32, size)[order])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(len(x) for x in held) >= ROWS:
            yield rows(held)
            held = []
    if sum(len(x) for x in held):
        yield rows(held)


def tables(anchors: np.ndarray, cells: Cells) -> np.ndarray:
    """For each anchor, pair of dimensions and byte the least share of the score, and as imaginary part the largest."""
    a = anchors.astype(np.float64)[:, :, None]
    one, two = a * cells.low, a * cells.high
    each = np.minimum(one, two) + 1j * np.maximum(one, two)
    both = each[:, ::2, :, None] + each[:, 1::2, None, :]
    return both.reshape(len(anchors), anchors.shape[1] // 2, CELLS * CELLS)


def bounds(table: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest score that each row can have."""
    total = np.zeros(near.shape[1], np.complex128)
    for t, byte in zip(table, near, strict=True):
        total += t[byte]
    slack = 1e-12 * (np.abs(table.real).max(1).sum() + np.abs(table.imag).max(1).sum()) if len(table) else 0.0  # sums of large numbers are rounded
    return total.real - slack, total.imag + slack


def exact(rows: Rows, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return rows.x[at].astype(np.int64) @ anchor.astype(np.int64)


class Best:
    """The best k rows so far: largest score, then smallest identifier."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = -np.inf  # what a row's score must reach to come in

    def raise_floor(self, scores: np.ndarray) -> None:
        """Scores of k different rows that may come in: no row below the least of the best k can."""
        if len(scores) >= self.k:
            self.floor = max(self.floor, np.partition(scores, -self.k)[-self.k])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            first = np.lexsort((i, -s))[: self.k]
            self.scores, self.ids = s[first], i[first]
            self.raise_floor(self.scores)


def _best_of_label(rows: Rows, part: slice, anchor_id: int, anchor: np.ndarray, table: np.ndarray, best: Best) -> None:
    """Brings the rows of a slice into best, the anchor itself excepted."""
    low, high = bounds(table, rows.near[:, part])
    # the anchor itself may be one of the rows that the threshold counts
    sure = np.partition(low, -best.k - 1)[-best.k - 1] if len(low) > best.k else -np.inf
    at = np.flatnonzero(high >= max(best.floor, sure)) + part.start
    at = at[rows.ids[at] != anchor_id]
    best.add(exact(rows, at, anchor), rows.ids[at])


def _best_in_windows(rows: Rows, own: slice, anchor: np.ndarray, table: np.ndarray, windows: list[tuple[int, int]], best: list[Best]) -> None:
    """Brings the rows outside a slice into the best of each window (least and largest score)."""
    low, high = bounds(table, rows.near)
    high[own] = -np.inf
    for (least, most), b in zip(windows, best, strict=True):
        if b.floor == -np.inf:  # a first threshold, from the rows most likely near the window's top
            middle = np.where(((low + high) / 2 <= most) & (high > -np.inf), low + high, -np.inf)
            at = np.argpartition(middle, -PROBES)[-PROBES:] if len(middle) > PROBES else np.arange(len(middle))
            s = exact(rows, at[high[at] > -np.inf], anchor)
            b.raise_floor(s[(s >= least) & (s <= most)])
    reach = [(max(least, b.floor), most) for (least, most), b in zip(windows, best, strict=True)]
    at = np.flatnonzero(high >= min(least for least, _ in reach))
    keep = np.zeros(len(at), bool)
    for least, most in reach:
        keep |= (high[at] >= least) & (low[at] <= most)
    at = at[keep]
    s, ids = exact(rows, at, anchor), rows.ids[at]
    for (least, most), b in zip(reach, best, strict=True):
        inside = (s >= least) & (s <= most)
        b.add(s[inside], ids[inside])


def window_of(positive: int, least: int = 50, most: int = 95) -> tuple[int, int]:
    """The scores s with least * positive <= 100 * s <= most * positive."""
    return -(-least * positive // 100), most * positive // 100


class Anchors(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    #: For each anchor the different scores of its positives; empty in the first scan.
    scores: list[list[int]]


def _scan(held: Broadcast, cells: Cells, k: int, positives: bool):
    """A task's work: the best rows of its own for each anchor (and window)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = held.value
        windows = [[window_of(p) for p in s] for s in anchors.scores]
        best = [[Best(k) for _ in (w if not positives else [0])] for w in windows]
        for rows in _blocks(batches, len(cells.cuts)):
            for start in range(0, len(anchors.ids), TABLES):
                some = range(start, min(start + TABLES, len(anchors.ids)))
                for i, table in zip(some, tables(anchors.x[some.start : some.stop], cells), strict=True):
                    own = slice(*np.searchsorted(rows.labels, [anchors.labels[i], anchors.labels[i] + 1]))
                    if positives and own.start < own.stop:
                        _best_of_label(rows, own, anchors.ids[i], anchors.x[i], table, best[i][0])
                    elif not positives and windows[i]:
                        _best_in_windows(rows, own, anchors.x[i], table, windows[i], best[i])
        out = [(anchors.ids[i], anchors.scores[i][j] if not positives else 0, b) for i, every in enumerate(best) for j, b in enumerate(every) if len(b.ids)]
        lengths = [len(b.ids) for _, _, b in out]
        repeat = lambda n: np.repeat(np.array([x[n] for x in out], np.int64), lengths)
        glued = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (repeat(0), repeat(1), glued([b.ids for _, _, b in out]), glued([b.scores for _, _, b in out]))], ["anchor_id", "positive_score", "vec_id", "score"])

    return scan


FOUND = "anchor_id long, positive_score long, vec_id long, score long"


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive the first negatives in its window."""
    spark = vectors.sparkSession
    file, cells = approximation_file(vectors, label)
    chosen = file.where(anchors)
    blocks = max(1, -(-chosen.count() // ANCHORS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    out = None
    for k in range(blocks):
        these = chosen.where(block == k).toPandas().sort_values(["label", "vec_id"])  # about ANCHORS rows
        x = np.frombuffer(b"".join(these["x"]), np.int32).reshape(len(these), len(cells.cuts))
        ids, labels = these["vec_id"].to_numpy(np.int64), these["label"].to_numpy(np.int64)
        sent = spark.sparkContext.broadcast(Anchors(ids, labels, x, [[] for _ in ids]))
        best = written(_first(file.mapInArrow(_scan(sent, cells, positives, True), FOUND), ["anchor_id"], positives), "positives")
        sent.unpersist()
        scores = {r.anchor_id: sorted(r.s) for r in best.groupBy("anchor_id").agg(F.collect_set("score").alias("s")).collect()}  # a few for each anchor
        sent = spark.sparkContext.broadcast(Anchors(ids, labels, x, [scores.get(i, []) for i in ids]))
        near = file.mapInArrow(_scan(sent, cells, negatives, False), FOUND)
        near = written(_first(near, ["anchor_id", "positive_score"], negatives), "negatives")
        sent.unpersist()
        pairs = best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = pairs.join(near, ["anchor_id", "positive_score"])
        out = found if out is None else out.unionByName(found)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
