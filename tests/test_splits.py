"""Whole groups, modes of splitting, the shortcut audit, and noise of single rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisonde.operators import audit, preparation, splits
from lumisonde.operators.metrics import roc_auc


@pytest.mark.parametrize("dealt", [4096, 20])
def test_groups_are_whole_and_labels_even(spark, dealt):
    rng = np.random.default_rng(2)
    size = rng.integers(1, 30, 150)
    rows = [(i * 100 + j, f"g{i}" if i else None, int(rng.random() < (0.2 if i % 3 else 0.7))) for i, n in enumerate(size) for j in range(n)]
    df = spark.createDataFrame(rows, "id long, g string, y int")
    out = splits.stratified_groups(df, "y", "g", 5, dealt).cache()
    assert out.count() == len(rows) and out.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    counts = {(r.fold, r.y): r["count"] for r in out.groupBy("fold", "y").count().collect()}
    for y in (0, 1):
        even = sum(r[2] == y for r in rows) / 5
        assert all(abs(counts[f, y] - even) <= (0.1 if dealt > 150 else 0.35) * even for f in range(5))
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in splits.stratified_groups(df.repartition(7), "y", "g", 5, dealt).collect()}


def test_every_mode_splits(spark):
    rows = spark.createDataFrame([(i, i % 2, f"s{i % 12}", "ab"[i % 5 == 0]) for i in range(240)], "id long, y int, s string, g string")
    ask = lambda **k: splits.by_mode(rows, "y", ["id"], **k)
    made = {
        "holdout_speaker": ask(speaker="s", hold_speaker="S3", generator="g", hold_generator="a"), "holdout_generator": ask(speaker="s", hold_speaker="nobody", generator="g", hold_generator="B"),
        "speaker_split": ask(speaker="s", group="g"), "group_split": ask(group="s"), "stratified": ask(group="g"),
    }
    for mode, out in made.items():
        got = out.collect()
        assert len({r.id for r in got}) == len(got) == 240 and {r["mode"] for r in got} == {mode} and {r.split for r in got} == {"train", "val", "test"}
        if mode in ("speaker_split", "group_split"):
            sides = {r.s: r.split for r in got}
            assert all(sides[r.s] == r.split for r in got)
    held = made["holdout_speaker"].where("split = 'test'").collect()
    assert sum(r.s == "s3" for r in held) == 20 and all(r.s == "s3" or r.y == 0 for r in held) and len(held) == 40


def test_shortcuts_are_found_where_they_are(spark):
    rng = np.random.default_rng(1)

    def clips(planted):
        out = []
        for i in range(300):
            y = int(rng.random() < 0.5)
            x = rng.normal(0, 0.1, 64) + (0.05 * y if planted else 0.0)
            out.append((y, f"g{i // 5}", x.tolist()))
        df = spark.createDataFrame(out, "y int, g string, x array<double>")
        return df.select("y", "g", *[c.alias(n) for n, c in audit.features(F.col("x")).items()])

    names = ["offset", "std", "zero_crossings", "silent_share"]
    found = {r.feature: r for r in audit.shortcuts(clips(True), "y", "g", names).collect()}
    assert found[None].accuracy > 0.9 and found[None].shortcut and {n for n in names if found[n].shortcut} == {"offset"}
    none = {r.feature: r for r in audit.shortcuts(clips(False), "y", "g", names).collect()}
    assert none[None].accuracy < 0.65 and not any(r.shortcut for r in none.values())


def test_noise_of_single_rows(spark):
    clips = spark.createDataFrame([(i, [float(np.sin(i + k)) for k in range(400)]) for i in range(20)], "id long, x array<double>").withColumn("clean", F.col("x"))
    got = preparation.with_noise(clips, "id", "x", [30, 10]).collect()
    noise = {(r.id, r.snr): np.array(r.x) - np.array(r.clean) for r in got}
    for (i, snr), e in noise.items():
        x = np.array(next(r.clean for r in got if r.id == i))
        assert abs(10 * np.log10((x @ x) / (e @ e)) - snr) < 1.2
        z = e / e.std()
        assert abs(z.mean()) < 0.25 and abs((z**4).mean() - 3) < 1.5 and abs(z[1:] @ z[:-1]) / 400 < 0.25
    assert not np.allclose(noise[0, 30.0], noise[1, 30.0]) and not np.allclose(noise[0, 30.0] * 10, noise[0, 10.0])
    again = {(r.id, r.snr): r.x for r in preparation.with_noise(clips.repartition(5), "id", "x", [30, 10]).collect()}
    assert all(again[r.id, r.snr] == r.x for r in got)


def test_lengths_that_differ_are_noticed(spark):
    one = spark.createDataFrame([("a", 2, 0.1), ("a", 1, 0.2), ("b", 1, 0.3), ("c", 1, 0.4)], "g string, i int, p double")
    two = spark.createDataFrame([("a", 5, 1), ("a", 6, 0), ("b", 1, 1), ("b", 2, 1), ("d", 1, 0)], "g string, j int, y int")
    two = two.withColumnRenamed("j", "i")
    assert sorted(tuple(r) for r in preparation.zipped(one, two, ["g"], ["i"]).select("g", "place", "p", "y").collect()) == [("a", 1, 0.2, 1), ("a", 2, 0.1, 0)]
    assert sorted(tuple(r) for r in preparation.unequal(one, two, ["g"]).collect()) == [("b", 1, 2), ("c", 1, 0), ("d", 0, 1)]


def test_curves_have_no_window_over_a_group(spark):
    import re

    s = spark.createDataFrame([("g", i % 2, i / 100) for i in range(100)], "g string, y int, p double")
    plan = roc_auc(s, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"sum\((?:pos|neg)#\w+\) windowspecdefinition\(([^)]*?) ASC", plan)
    assert keys and all("range_" in k for k in keys)
