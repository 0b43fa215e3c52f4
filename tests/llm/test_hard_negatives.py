"""Hard negatives against all scores of a table."""

from __future__ import annotations

import math

import numpy as np
import pytest
from compare import SF, of_spark, of_sql
from pyspark.sql import functions as F

from lumisonde.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows: list[tuple]) -> list[tuple]:
    """Rows (vec_id, embedding, label) with every score computed."""
    kept: dict[int, tuple] = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = math.fmod(label + 1, 10) if i % 7 == 0 else label
        one = (int(label), [math.floor(max(min(256 * x, 2.0**24), -(2.0**24))) for x in v])
        kept[i] = min(kept.get(i, one), one)
    out = []
    for a, (label, x) in kept.items():
        if a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, other == label) for i, (other, y) in kept.items() if i != a]
        scored.sort()
        for ps, p, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(a, p, k + 1, n, -ps, -s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows: list[tuple], parts: int = 3) -> list[tuple]:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, label).collect())


def test_embeddings_against_sql(spark):
    assert of_spark(queries.op11_hard_negatives(spark, SF)) == of_sql(queries.OP11_SQL, SF)


@pytest.mark.parametrize("kind", ["even", "clusters", "ties"])
def test_random_vectors(spark, kind, monkeypatch):
    """Vectors of every direction, near copies of a few, and many equal ones; several blocks of anchors."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    rng = np.random.default_rng(5)
    n = 900
    x = rng.normal(0, 0.2, (n, 7))
    if kind == "clusters":
        x = x[rng.integers(0, 12, n)] + rng.normal(0, 0.02, (n, 7))
    if kind == "ties":
        x[rng.random(n) < 0.5] = x[0]
        x = np.round(x, 1)
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(0, 4))) for i in range(n)]
    want = plain(rows)
    assert want and mined(spark, rows) == want


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (500, 6))
    cuts = np.sort(rng.integers(-300, 300, (6, 15)), axis=1)
    low, high = np.column_stack([x.min(0), cuts + 1]), np.column_stack([cuts, x.max(0)])
    cells = hard_negatives.Cells(cuts, low, np.maximum(low, high))
    near = hard_negatives.approximations(x, cells)
    for table, a in zip(hard_negatives.tables(x[:20], cells), x[:20]):
        least, most = hard_negatives.bounds(table, near.T)
        assert (least <= x @ a).all() and (x @ a <= most).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5, 0.2], 1), (0, [1.0, 0.5, 0.2], 1), (0, [0.0], 9), (50, [], 1), (100, [1e30, -1e30], 2), (150, [0.0, 0.0], 2), (-50, [1.0], -3)]
    rows += [(None, [1.0], 1), (3, None, 1), (4, [1.0], None), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (8, [inf], 2), (9, [-inf, 0.0], 1)]
    rows += [(k, [1.0 / k, 1.0, -0.3 * k][: k % 4], k % 3) for k in range(10, 40)] + [(k, [0.6, 0.1], 2) for k in range(60, 70)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(0, [], 1), (1, [], 1), (2, [], 3)]) == plain([(0, [], 1), (1, [], 1), (2, [], 3)])


def test_other_columns_are_ignored(spark):
    rows = [(k, [k / 50, 1.0], k % 2) for k in range(101)]
    df = spark.createDataFrame([(*r, 1, b"x", 2, "y") for r in rows], SCHEMA + ", x int, cells binary, score int, label_ string")
    assert sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))).collect()) == plain(rows)
