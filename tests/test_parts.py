"""Arrays, spectra, streams, tables and files against plain Python."""

from __future__ import annotations

import math
import re
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a
from lumisonde.operators import splits, tables
from lumisonde.sources import archives, files
from lumisonde.streaming import detector


def one(spark, x, c):
    return spark.createDataFrame([(x,)], "x array<double>").select(c).first()[0]


@pytest.mark.parametrize("method", ["minmax", "zscore", "robust"])
def test_normalize(spark, method):
    x = [3.0, 1.0, 4.0, 1.0, 5.0]
    v = np.array(x)
    low, spread = {"minmax": (v.min(), np.ptp(v)), "zscore": (v.mean(), v.std()), "robust": (np.median(v), np.median(abs(v - np.median(v))))}[method]
    assert one(spark, x, a.normalize(F.col("x"), method)) == pytest.approx(((v - low) / spread).tolist())
    assert one(spark, [2.0, 2.0], a.normalize(F.col("x"), method)) == [0.0, 0.0]


def test_shapes(spark):
    x = [float(i) for i in range(10)]
    assert one(spark, x, a.fit(F.col("x"), 4)) == [3.0, 4.0, 5.0, 6.0]
    assert one(spark, x, a.fit(F.col("x"), 12)) == x + [0.0, 0.0]
    assert one(spark, [1.0, 2.0], a.fit(F.col("x"), 5, tile=True)) == [1.0, 2.0, 1.0, 2.0, 1.0]
    assert one(spark, x, a.segments(F.col("x"), 4, 2, 3)) == [x[i : i + 4] for i in (0, 2, 4, 6)]
    assert one(spark, x, a.segments(F.col("x"), 4, 4, pad=True))[-1] == [8.0, 9.0, 0.0, 0.0]
    assert one(spark, x, a.chunks(F.col("x"), 4)) == [x[:4], x[4:8], x[8:]]
    assert one(spark, [1.0, -1.0, 0.0, -2.0], a.sign_changes(F.col("x"))) == 1.0
    assert one(spark, [1.0, 3.0, 2.0], a.differences(F.col("x"))) == [2.0, -1.0]
    assert one(spark, [float("nan"), 1.0, float("inf")], a.clean(F.col("x"))) == [0.0, 1.0, 0.0]


def test_stream_steps():
    state, out = None, []
    for k in range(0, 40, 4):
        state, found = detector.step([1.0] * 4, state, 8, 4, 16, 0.3, detector.mean_square)
        out.append(found)
    assert [bool(x) for x in out] == [False] + [True] * 9 and len(state[0]) == 16
    state, found = detector.step([0.5] * 100, None, 8, 4, 64, 0.3, detector.mean_square)
    assert found[0] == 1 and len(state[0]) == 64  # one window for a push, however long


def test_stream_detector_matches_plain_steps(spark):
    from compare import SF
    from lumisonde.plans.stream_queries import stream_detector

    got = {(r.key, r.seq): (round(r.raw, 9), round(r.smooth, 9)) for r in stream_detector(spark, SF).collect()}
    want = {}
    for user, rows in spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values(["ts", "event_id"]).groupby("user_id"):
        state, v = None, rows["value"].tolist()
        for k in range(0, len(v), 4):
            state, found = detector.step(v[k : k + 4], state, 8, 4, 64, 0.3, detector.mean_square)
            if found:
                want[user, found[0]] = (round(found[1], 9), round(found[2], 9))
    assert got == want


def test_balanced_matches_turns(spark):
    rows = [(i, i % 2, "abc"[i * i % 3]) for i in range(31)]
    out = tables.balanced(spark.createDataFrame(rows, "id long, y int, g string"), "y", "g", "id", 9)
    kept = {r.id for r in out.where("kept").collect()}
    want = set()
    for y in (0, 1):
        queues = {g: [i for i, l, h in rows if l == y and h == g] for g in "abc"}
        taken = []
        while len(taken) < 9:
            for g in "abc":
                if queues[g] and len(taken) < 9:
                    taken.append(queues[g].pop(0))
        want |= set(taken)
    assert kept == want


def test_groups_stay_whole(spark):
    rows = spark.createDataFrame([(i, f"g{i % 7}") for i in range(60)], "id long, g string")
    out = splits.grouped(rows, "g", 3)
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert out.select("fold").distinct().count() == 3


def test_files(spark, tmp_path):
    for name, n in (("real/a.wav", 16000), ("fake/b.wav", 800)):
        p = tmp_path / "train" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        with wave.open(str(p), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(16000)
            w.writeframes((np.sin(np.arange(n)) * 20000).astype("<i2").tobytes())
    (tmp_path / "train/real/c.wav").write_bytes(b"not a clip")
    found = files.scan(spark, str(tmp_path), "*.wav")
    assert sorted((r.path[-5:], r.label, r.split) for r in found.collect()) == [("a.wav", 0, "train"), ("b.wav", 1, "train"), ("c.wav", 0, "train")]
    assert files.changed(found, found).count() == 0 and files.totals(found).first().files == 3
    checked = files.validity(files.clips(spark, str(tmp_path)))
    assert sorted((r.path[-5:], r.status) for r in checked.collect()) == [("a.wav", "ok"), ("b.wav", "too_short"), ("c.wav", "corrupted")]
    table = spark.createDataFrame([(1, 0.1234565, 2.0)], "segment_id int, mfcc_a double, pitch_b double")
    files.save_features(table, str(tmp_path / "csv"))
    assert files.features(spark, str(tmp_path / "csv")).columns == ["mfcc_a", "pitch_b"]
    files.save_by_category(table, ["segment_id"], str(tmp_path / "cat"))
    assert {p.name for p in (tmp_path / "cat").iterdir() if p.is_dir()} == {"category=mfcc", "category=pitch"}
    assert files.columns_like(spark, str(tmp_path / "cat"), "VAL") == ["value"]
    assert "| 1 |" in files.markdown(table)


def test_cepstra_of_frames_are_those_of_numpy(spark):
    from lumisonde.functions import frames as fr

    rng = np.random.default_rng(3)
    size, hop, rate, n, count = 64, 32, 16000.0, 5, 10
    x = rng.normal(size=400)
    cut = np.stack([x[i : i + size] for i in range(0, len(x) - size + 1, hop)])
    m = np.abs(np.fft.rfft(cut * np.hamming(size)))
    frame = fr.transformed(spark.createDataFrame([(1, x.tolist())], "id long, x array<double>"), "id", "x", size, hop, fr.hamming(size))
    got = fr.delta(fr.lfcc(fr.mfcc(frame, "id", size, rate, n, count), size, rate, n, count), "id", "mfcc").orderBy("frame").collect()
    assert np.allclose([r.m for r in got], m)
    f = np.fft.rfftfreq(size, 1 / rate)
    basis = np.cos(np.pi / count * (np.arange(count) + 0.5) * np.arange(n)[:, None]) * np.sqrt(2 / count)
    basis[0] /= np.sqrt(2)

    def bank(edges):
        return np.array([np.maximum(0, np.minimum((f - a) / (b - a), (c - f) / (c - b))) for a, b, c in zip(edges, edges[1:], edges[2:])])

    mel = lambda h: 2595 * np.log10(1 + h / 700)
    hz = 700 * (10 ** (np.linspace(mel(80), mel(8000), count + 2) / 2595) - 1)
    c = np.log(m**2 @ bank(hz).T + 1e-10) @ basis.T * (1 + 11 * np.sin(np.pi * np.arange(n) / 22))
    c -= c.mean(0)
    assert np.allclose([r.mfcc for r in got], c)
    assert np.allclose([r.lfcc for r in got], np.log(m**2 @ bank(np.linspace(0, 8000, count + 2)).T + 1e-6) @ basis.T)
    wide = np.concatenate((c[:1], c[:1], c, c[-1:], c[-1:]))
    assert np.allclose([r.delta for r in got], [(wide[i + 3] - wide[i + 1] + 2 * (wide[i + 4] - wide[i])) / 10 for i in range(len(c))])


def test_ranks_do_not_depend_on_ranges(spark):
    from pyspark.sql import Window

    from lumisonde.operators.ranks import percentiles, ranked

    rows = spark.range(3000).select((F.col("id") % 3 % 2).alias("g"), (F.col("id") * 7919 % 97).alias("v"), "id").unionByName(spark.createDataFrame([(0, None, 5000), (None, 4, 5001)], "g long, v long, id long"))
    want = {(r.id, r.k) for r in rows.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).collect()}
    for ranges in (1, 7, 32):
        got = ranked(rows, ["g"], ["v", "id"], ranges=ranges)
        assert {(r.id, r.rn) for r in got.collect()} == want and {(r.g, r.n) for r in got.collect()} == {(0, 2001), (1, 1000), (None, 1)}
    p = {r.g: (r.a, r.b) for r in percentiles(rows, ["g"], "v", {"a": 0.5, "b": 0.93}).collect()}
    q = {r.g: (r.a, r.b) for r in rows.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.93)).alias("b")).collect()}
    assert {g: pytest.approx(x) for g, x in q.items()} == p


def test_no_window_has_a_label_for_a_key(spark):
    frame = spark.range(100).select("id", (F.col("id") % 2).alias("y"))
    for out in (splits.stratified(frame, "y", ["id"]), splits.folds(frame, "y", ["id"], 5), splits.temporal(frame, ["y"], ["id"]), splits.leave_one_out(frame.withColumn("s", F.lit("a")), "s", "b", "y", ["id"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        keys = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*?) ASC", plan)
        assert keys and all("range_" in k for k in keys)


def test_unknown_labels_and_npz(spark, tmp_path):
    from lumisonde.operators import preparation

    with pytest.raises(ValueError, match="zz"):
        preparation.encoded(spark.createDataFrame([("en",), ("zz",)], "lang string"), "lang", {"en": 1})
    np.savez(tmp_path / "d.npz", X_train=np.arange(12).reshape(3, 2, 2), y_train=np.array([0, 1, 0]), X_test=np.ones((2, 4)), y_test=np.array([1, 1]))
    got = archives.read_rows(spark, str(tmp_path), rows=2).collect()
    assert sorted((r.split, r.row, r.x, r.y) for r in got) == [("test", 0, [1.0] * 4, 1), ("test", 1, [1.0] * 4, 1), ("train", 0, [0.0, 1.0, 2.0, 3.0], 0), ("train", 1, [4.0, 5.0, 6.0, 7.0], 1), ("train", 2, [8.0, 9.0, 10.0, 11.0], 0)]
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    files.save_table(frame, str(tmp_path / "t"))
    files.append(frame, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "t" / "jsonl")).count() == 2 and files.first_rows(spark, str(tmp_path / "p"), 1).count() == 1


def test_secure_split_keeps_shares(spark):
    rows = spark.range(100).select("id", (F.col("id") % 2).alias("y"))
    got = {(r.y, r.split): r["count"] for r in splits.secure(rows, "y", ["id"], 0.2, 0.2).groupBy("y", "split").count().collect()}
    assert got == {(y, s): n for y in (0, 1) for s, n in (("train", 30), ("val", 10), ("test", 10))}
