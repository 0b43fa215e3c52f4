"""Pitch, formants, neighbours, intervals, peaks and wavelets against known signals and plain loops."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisonde.functions import frames as fr
from lumisonde.functions import prediction, voice, wavelets
from lumisonde.operators import intervals, neighbours, peaks, scaling
from lumisonde.operators.ranks import cuts_of, ordered

RATE = 16000


def clips(spark, *signals):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(signals)], "id int, x array<double>")


def test_pitch_of_tones_glides_and_noise(spark):
    t = np.arange(8000) / RATE
    glide = np.sin(2 * np.pi * (120 * t + 160 * t * t))
    c = clips(spark, np.sin(2 * np.pi * 220 * t), glide, np.random.default_rng(0).normal(size=8000), np.zeros(4096), np.sin(2 * np.pi * 87.3 * t) + 0.5 * np.sin(2 * np.pi * 174.6 * t))
    f = voice.pitch(voice.cut(c, "id", "x", 2048, 512), RATE, 65, 1000).cache()
    rows = f.select("id", "frame", "f0", "voiced").collect()
    assert all(r.voiced and abs(r.f0 / 220 - 1) < 0.01 for r in rows if r.id == 0) and all(r.voiced and abs(r.f0 / 87.3 - 1) < 0.01 for r in rows if r.id == 4)
    # the first half of a frame is compared with what follows within a period: its middle lies half a period after a quarter frame
    middle = lambda r: (r.frame * 512 + 512) / RATE
    assert all(abs(r.f0 / (120 + 320 * middle(r)) - 1) < 0.04 for r in rows if r.id == 1)
    assert not any(r.voiced for r in rows if r.id in (2, 3))
    s = {r.id: r for r in voice.pitch_statistics(f, "id").collect()}
    assert s[0].voicing == 1 and s[0].std < 0.1 and s[1].falls == 0 and s[1].rises == sum(r.id == 1 for r in rows) - 1 and (s[2].voicing, s[2].mean, s[3].rises) == (0, 0, 0)
    p = {r.id: r for r in voice.perturbation(f, "id", RATE).collect()}
    assert p[0].jitter < 1e-4 and p[0].shimmer < 1e-3 and p[1].jitter > 0.01
    power = {r.id: r.s for r in voice.pitch_strength(f, RATE).groupBy("id").agg(F.avg("strength").alias("s")).collect()}
    assert power[0] > 0.9 and power[2] == 0
    m = f.withColumn("m", fr.magnitudes(F.zip_with("w", fr.hann(2048), lambda v, h: v * h)))
    assert {r.id: r.hnr for r in voice.harmonics_to_noise(m, "id", 2048, RATE).collect()}[0] > 20
    peak = {r.id: r.c for r in f.select("id", voice.cepstral_peak(F.col("w"), RATE).alias("c")).groupBy("id").agg(F.avg("c").alias("c")).collect()}
    assert peak[4] > peak[2]


def test_jitter_and_shimmer_of_known_frames(spark):
    f0, amp = [100.0, 110.0, 100.0, 120.0, 100.0, 90.0], [1.0, 0.5, 1.0, 0.8, 0.9, 1.0]
    rows = [(1, i, f, True, [a, -a]) for i, (f, a) in enumerate(zip(f0, amp))] + [(1, 9, 50.0, False, [9.0])]
    got = voice.perturbation(spark.createDataFrame(rows, "id int, frame int, f0 double, voiced boolean, w array<double>"), "id", RATE).first()
    t, a = RATE / np.array(f0), np.array(amp)
    assert got.jitter == pytest.approx(np.abs(np.diff(t)).mean() / t.mean()) and got.shimmer == pytest.approx(np.abs(np.diff(a)).mean() / a.mean())
    assert got.shimmer_db == pytest.approx(np.abs(20 * np.log10(a[1:] / a[:-1])).mean()) and got.apq == 0
    assert got.rap == pytest.approx(np.mean([abs(t[i] - t[i - 1 : i + 2].mean()) for i in range(1, 5)]) / t.mean())
    assert got.ppq == pytest.approx(np.mean([abs(t[i] - t[i - 2 : i + 3].mean()) for i in range(2, 4)]) / t.mean())


def test_plans_of_large_banks_are_small(spark):
    c = clips(spark, np.zeros(4096))
    started = time.time()
    m = fr.mfcc(fr.transformed(c, "id", "x", 2048, 512), "id", 2048, RATE, 13, 128)
    took = time.time() - started
    assert m.count() == 5 and took < 3 and len(m._jdf.queryExecution().logical().toString()) < 100_000


def test_prediction_is_that_of_normal_equations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=600)
    for i in range(2, 600):
        x[i] += 1.2 * x[i - 1] - 0.6 * x[i - 2]
    order = 8
    got = prediction.quality(prediction.predicted(clips(spark, x, np.zeros(64)).withColumnRenamed("x", "w"), order)).orderBy("id").collect()
    r = np.array([x[: 600 - k] @ x[k:] for k in range(order + 1)])
    c = np.linalg.solve(r[np.abs(np.arange(order)[:, None] - np.arange(order))], r[1:])
    assert np.allclose(got[0].c, c) and got[0].e == pytest.approx(r[0] - c @ r[1:]) and got[0].stable and abs(got[0].c[0] - 1.2) < 0.15
    assert got[1].c == [0.0] * order and got[1].gain == 0


def test_formants_are_poles(spark):
    z = [0.97 * np.exp(2j * np.pi * f / 8000) for f in (500, 1500, 2500)]
    a = np.real(np.poly([*z, *np.conj(z)]))
    y = np.zeros(1600)
    for i in range(1600):
        y[i] = (i % 80 == 0) - sum(a[k] * y[i - k] for k in range(1, 7) if i >= k)
    f = prediction.formant_frames(clips(spark, y), "id", "x", 512, 256, 8000.0, count=5, by=0.0).collect()
    narrow = [[p.hz for p in r.formants if p.width < 400] for r in f[1:]]  # the order has room for poles that are no formants
    assert narrow and all(min(abs(hz - g) for g in found) < 60 for found in narrow for hz in (500, 1500, 2500))
    roots = prediction.poles(np.array([[1.0, 0.5, 0.2], [0.0, 0.0, 0.0]]))
    c = np.linalg.solve([[1, 0.5], [0.5, 1]], [0.5, 0.2])
    assert np.allclose(sorted(roots[0][:, 0]), sorted(np.roots([1, -c[0], -c[1]]).real)) and not roots[1].any()


def plain_matches(y, m, tol):
    n = len(y) - m + 1
    return sum(max(abs(y[i + k] - y[j + k]) for k in range(m)) <= tol for i in range(n) for j in range(i + 1, n))


def test_entropies_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    series = {0: np.cumsum(rng.normal(size=150)), 1: np.tile([0.0, 1, 2, 3, 4], 12), 2: rng.normal(size=80), 3: np.ones(30), 4: np.arange(3.0)}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "g int, t long, y double")
    got = {r.g: r for r in neighbours.sample_entropy(rows, ["g"], "t", "y").collect()}
    for k, x in series.items():
        tol = 0.2 * x.std()
        a, b = plain_matches(x, 2, tol), plain_matches(x, 3, tol)
        assert (got[k].a, got[k].b) == (a, b)
        want = np.nan if len(x) < 4 else np.inf if not a or not b else -np.log(b / a)
        assert got[k].sample_entropy == pytest.approx(want, nan_ok=True)
    some = neighbours.approximate_entropy(rows.where("g in (0, 2)"), ["g"], "t", "y").collect()
    for r in some:
        x = series[r.g]

        def phi(m):
            p = np.lib.stride_tricks.sliding_window_view(x, m)
            return np.mean([np.log(np.mean(np.abs(p - q).max(1) <= 0.2 * x.std())) for q in p])

        assert r.approximate_entropy == pytest.approx(phi(2) - phi(3))


def test_recurrence_is_that_of_the_matrix(spark):
    rng = np.random.default_rng(5)
    series = {0: np.cumsum(rng.normal(size=90)), 1: np.tile([0.0, 1, 2], 10), 2: rng.normal(size=40)}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "g int, t long, y double")

    def runs(lines):
        out = []
        for line in lines:
            text = "".join(map(str, line)).split("0")
            out += [len(s) for s in text if len(s) >= 2]
        return out

    for r in neighbours.recurrence(rows, ["g"], "t", "y", 3, 0.3).collect():
        x = series[r.g]
        p = np.lib.stride_tricks.sliding_window_view(x, 3)
        m = (np.linalg.norm(p[:, None] - p[None], axis=2) < 0.3 * x.std()).astype(int)
        d, v = runs(np.diagonal(m, k) for k in range(-len(m) + 1, len(m))), runs(m.T)
        assert r.recurrence_rate == pytest.approx(m.mean()) and r.determinism == pytest.approx(sum(d) / m.sum()) and r.laminarity == pytest.approx(sum(v) / m.sum())
        assert r.mean_diagonal == pytest.approx(np.mean(d)) and r.longest_diagonal == max(d)


def test_exponents_of_noise_and_walks(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=1500)
    s = scaling.series_of(clips(spark, noise, np.cumsum(noise)), "id", "x")
    d, h, u = ({r.id: r[1] for r in f(s, ["id"]).collect()} for f in (scaling.dfa, scaling.higuchi, scaling.hurst))
    assert 0.3 < d[0] < 0.75 and d[1] > 1.1 and h[0] > 1.85 and 1.3 < h[1] < 1.7 and u[0] < u[1]


def test_exponents_look_at_all_segments(spark):
    """Series that are calm at first and rough later, against plain loops over all whole segments."""
    rng = np.random.default_rng(4)
    series = [rng.normal(size=n) * np.linspace(0.1, 5, n) ** 2 for n in (64, 150, 333)]

    def scales(n, share, count):
        top = max(5, n // share)
        return sorted({math.floor(10 ** (math.log10(4) + k * (math.log10(top) - math.log10(4)) / (count - 1)) + 1e-9) for k in range(count)})

    def rescaled(x):
        points = []
        for s in scales(len(x), 8, 10):
            parts = [x[k : k + s] for k in range(0, len(x) - s + 1, s)]
            points.append((s, np.mean([np.ptp(np.cumsum(p - p.mean())) / p.std() for p in parts])))
        return np.polyfit(*np.log(points).T, 1)[0]

    def detrended(x):
        y, points = np.cumsum(x - x.mean()), []
        for s in scales(len(x), 4, 6):
            t = np.arange(s)
            parts = [y[k : k + s] for k in range(0, len(y) - s + 1, s)]
            points.append((s, math.sqrt(np.mean([np.mean((p - np.polyval(np.polyfit(t, p, 1), t)) ** 2) for p in parts]))))
        return np.polyfit(*np.log(points).T, 1)[0]

    s = scaling.series_of(clips(spark, *series), "id", "x")
    for f, plain in ((scaling.hurst, rescaled), (scaling.dfa, detrended)):
        got = {r.id: r[1] for r in f(s, ["id"]).collect()}
        assert [got[i] for i in range(3)] == pytest.approx([plain(x) for x in series], rel=1e-6)


@pytest.mark.parametrize("ranges", [1, 5])
def test_interval_sets(spark, ranges, monkeypatch):
    monkeypatch.setattr(intervals, "cuts_of", lambda *a: cuts_of(*a, ranges=ranges))
    rng = random.Random(ranges)
    spans = lambda n: [(k, s, s + rng.randint(0, 9)) for k in (None, 1, 2) for s in (rng.randint(0, 80) for _ in range(n))]
    one, two = spans(9), spans(6)
    a, b = (spark.createDataFrame(x, "k int, start int, end int") for x in (one, two))
    cover = lambda x: {(k, p) for k, s, e in x for p in range(s, e)}
    for f, g in ((intervals.union, set.union), (intervals.intersection, set.intersection), (intervals.difference, set.difference)):
        got = [tuple(r) for r in f(a, b, ["k"]).collect()]
        assert cover(got) == g(cover(one), cover(two)) and len(cover(got)) == sum(e - s for _, s, e in got)
        assert not {(k, e) for k, _, e in got} & {(k, s) for k, s, _ in got}  # maximal
    frame = spark.createDataFrame([(1, 0, 100)], "k int, start int, end int")
    assert cover(tuple(r) for r in intervals.gaps(a, frame, ["k"]).collect()) == {(1, p) for p in range(100)} - cover(one)
    assert intervals.union(a.limit(0), b.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("ranges", [1, 7])
def test_peaks_are_those_of_plain_loops(spark, ranges, monkeypatch):
    monkeypatch.setattr(peaks, "cuts_of", lambda *a: cuts_of(*a, ranges=ranges))
    rng = random.Random(ranges)
    x = [round(rng.random(), 1) for _ in range(400)]
    found = [i for i in range(1, 399) if x[i] > x[i - 1] and x[i] > x[i + 1]]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", 0, 1.0)], "k string, i long, v double")
    c = peaks.candidates(rows, ["k"], "i", "v", cuts=cuts_of(rows, "i", ranges)).cache()
    assert sorted(r.i for r in c.collect()) == found
    assert sorted(r.i for r in peaks.candidates(rows, ["k"], "i", "v", 0.8).collect()) == [i for i in found if x[i] >= 0.8]
    for distance in (1, 4, 11):
        kept: list[int] = []
        for i in found:
            if not kept or i - kept[-1] >= distance:
                kept.append(i)
        assert sorted(r.i for r in peaks.picked(c, ["k"], "i", "v", distance).collect()) == kept
        kept = []
        for i in sorted(found, key=lambda i: (-x[i], -i)):
            if all(abs(i - q) >= distance for q in kept):
                kept.append(i)
        assert sorted(r.i for r in peaks.picked(c, ["k"], "i", "v", distance, highest=True).collect()) == sorted(kept)


@pytest.mark.parametrize("taps", [wavelets.HAAR, wavelets.DB2, wavelets.DB4])
def test_pyramids_give_the_signal_back(spark, taps):
    rng = np.random.default_rng(1)
    x = [rng.normal(size=n).tolist() for n in (64, 48, 2, 1)]
    p = wavelets.pyramid(clips(spark, *x), "x", 4, taps)
    for r in wavelets.restored(p, 4, taps).collect():
        assert np.allclose(r.restored[: len(r.x)], r.x)
        if len(r.x) == 64:
            assert sum(v * v for c in (r.d1, r.d2, r.d3, r.d4, r.approx) for v in c) == pytest.approx(sum(v * v for v in r.x)) and [len(c) for c in (r.d1, r.d2, r.d3, r.d4, r.approx)] == [32, 16, 8, 4, 4]
    shares = p.select(*[c.alias(n) for n, c in wavelets.energies(p, 4).items()]).first()
    assert sum(shares[f"{n}_share"] for n in ("d1", "d2", "d3", "d4", "approx")) == pytest.approx(1)


def test_neighbours_across_ranges(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 91).alias("v"), "id")
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("v", "id")
    want = {tuple(r) for r in rows.select("id", F.row_number().over(w), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lag("v").over(w), F.lead("id").over(w)).collect()}
    for ranges in (1, 4, 40):
        got = ordered(rows, ["g"], ["v", "id"], number="k", sums={"s": "v"}, totals={"t": "v"}, before={"b": "v"}, after={"a": "id"}, ranges=ranges)
        assert {(r.id, r.k, r.s, r.b, r.a) for r in got.collect()} == want
    clash = rows.withColumns({"range_": F.lit(1), "own_": F.lit(2), "info_": F.lit(3)})
    assert ordered(clash, ["g"], ["v"], number="k").columns == [*clash.columns, "k"]


def test_speech_of_bursts(spark):
    """Three bursts of a tone, and one of noise, between silences."""
    from lumisonde.operators import speech

    rate, rng = 8000, np.random.default_rng(3)
    x = np.zeros(3 * rate)
    for start, end in ((0.2, 0.5), (1.0, 1.3), (1.8, 2.5)):
        i = np.arange(int(start * rate), int(end * rate))
        x[i] = 0.5 * np.sin(2 * np.pi * 150 * i / rate)
    i = np.arange(int(2.5 * rate), int(2.8 * rate))
    x[i] = rng.normal(0, 0.3, len(i))
    c = clips(spark, x, np.zeros(2000))
    size, hop = 400, 160
    near = lambda spans, want: len(spans) == len(want) and all(abs(s - a * rate) <= size and abs(e - b * rate) <= size for (s, e), (a, b) in zip(spans, want))
    of = lambda f, k: sorted((r.start, r.end) for r in f(c, "id", "x", size, hop).collect() if r.id == k)
    assert near(of(speech.speech, 0), [(0.2, 0.5), (1.0, 1.3), (1.8, 2.8)]) and of(speech.speech, 1) == []
    assert near(of(speech.pauses, 0), [(0, 0.2), (0.5, 1.0), (1.3, 1.8), (2.8, 3.0)]) and of(speech.pauses, 1) == [(0, 2000)]
    assert near(of(speech.vowels, 0), [(0.2, 0.5), (1.0, 1.3), (1.8, 2.5)])
    assert near([s for s in of(speech.consonants, 0) if s[1] - s[0] > size], [(2.5, 2.8)])
    s = {r.id: r for r in speech.summary(c, "id", "x", size, hop, rate).collect()}
    assert s[0].speech_count == 3 and s[0].breathing >= 2 and s[0].continuous == 1 and s[1].speech_count == 0 and s[1].syllables == 1 and s[1].pause_ratio == 1


def test_smoothing_keeps_polynomials(spark):
    from lumisonde.operators import speech

    t = np.arange(40.0)
    cubic = (t**3 / 50 - t**2 + 3).tolist()
    rows = spark.createDataFrame([(0, cubic), (1, [1.0, 5.0]), (2, [1.0, 2.0, 4.0, 8.0])], "id int, x array<double>")
    got = {r.id: r.s for r in rows.select("id", speech.smoothed(F.col("x")).alias("s")).collect()}
    assert np.allclose(got[0], cubic) and got[1] == [1.0, 5.0] and len(got[2]) == 4
    noisy = np.sin(t / 6) + np.random.default_rng(0).normal(0, 0.3, 40)
    out = spark.createDataFrame([(noisy.tolist(),)], "x array<double>").select(speech.smoothed(F.col("x")).alias("s")).first().s
    for i in range(10, 30):
        assert out[i] == pytest.approx(np.polyval(np.polyfit(np.arange(-10, 11), noisy[i - 10 : i + 11], 3), 0))
    assert out[2] == pytest.approx(np.polyval(np.polyfit(np.arange(21), noisy[:21], 3), 2))


def test_pitch_classes_and_harmonics(spark):
    from lumisonde.functions import perceptual

    t = np.arange(4096) / RATE
    c = clips(spark, np.sin(2 * np.pi * 880 * t), sum(np.sin(2 * np.pi * 200 * k * t) / k for k in range(1, 6)), np.sin(2 * np.pi * 700 * t) + 0.5 * np.sin(2 * np.pi * 1050 * t))
    m = fr.transformed(c, "id", "x", 4096, 4096)
    got = {r.id: r for r in perceptual.chroma(perceptual.harmonicity(m, 4096, RATE), 4096, RATE).collect()}
    assert np.argmax(got[0].chroma) == 9 and got[1].inharmonicity < 0.02 and got[2].inharmonicity > 0.1 and got[0].tonality > 0.3
