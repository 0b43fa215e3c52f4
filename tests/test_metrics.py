"""Known answers of the metrics."""

from __future__ import annotations

import math

import pytest

from lumisonde.operators import metrics as m


def scores(spark, ys, ps):
    return spark.createDataFrame([(i, "g", int(y), float(p)) for i, (y, p) in enumerate(zip(ys, ps))], "id long, g string, y int, p double")


def test_perfect_separation(spark):
    s = scores(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    r = m.evaluate(s, ["g"]).first()
    assert (r.auc, r.eer, r.accuracy, r.converged) == (1.0, 0.0, 1.0, True)
    assert m.accuracy_at_eer(s, ["g"]).first().accuracy_at_eer == 1.0
    assert m.pr_auc(s, ["g"]).first().pr_auc == pytest.approx(1.0)


def test_sanitize(spark):
    from pyspark.sql import functions as F

    s = scores(spark, [0, 1, 0, 1], [float("nan"), float("inf"), float("-inf"), 0.75])
    assert [r[0] for r in s.orderBy("id").select(m.sanitize(F.col("p"))).collect()] == [0.5, 1.0, 0.0, 0.75]


def test_one_class(spark):
    s = scores(spark, [0, 0, 0], [0.1, 0.2, 0.3])
    assert m.min_tdcf(s, ["g"]).first().min_tdcf == 1.0
    assert math.isnan(m.roc_auc(s, ["g"]).first().auc)
    assert m.eer(s, ["g"]).count() == 0
    assert m.evaluate(s, ["g"]).first().converged is False


def test_tdcf_good_and_constant(spark):
    ys = [0] * 4 + [1] * 4
    good = m.min_tdcf(scores(spark, ys, [0.05, 0.1, 0.2, 0.15, 0.9, 0.85, 0.95, 0.8]), ["g"]).first().min_tdcf
    same = m.min_tdcf(scores(spark, ys, [0.5] * 8), ["g"]).first().min_tdcf
    assert good < 0.2 and good < same


def test_auc_counts_pairs(spark):
    import random

    rng = random.Random(3)
    ys, ps = [rng.randint(0, 1) for _ in range(200)], [rng.randint(0, 20) / 20 for _ in range(200)]
    pos, neg = [p for y, p in zip(ys, ps) if y], [p for y, p in zip(ys, ps) if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert m.roc_auc(scores(spark, ys, ps), ["g"]).first().auc == pytest.approx(want)


def test_empty(spark):
    s = scores(spark, [], [])
    for f in (m.roc_auc, m.pr_auc, m.eer, m.min_tdcf, m.evaluate, m.report, m.sweep):
        assert f(s, ["g"]).count() == 0
