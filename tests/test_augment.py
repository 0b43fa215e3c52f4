"""Altered copies, resampling, line spectra, archives of files."""

from __future__ import annotations

import io
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisonde.functions import timefreq
from lumisonde.operators import augment, neighbours
from lumisonde.sources import files


def clips(spark, *signals):
    return spark.createDataFrame([(i, [float(v) for v in x], i % 2) for i, x in enumerate(signals)], "id long, x array<double>, y int")


def test_copies(spark):
    rng = np.random.default_rng(1)
    signals = [rng.uniform(-1, 1, 200) for _ in range(12)] + [np.zeros(5), np.array([])]
    c = clips(spark, *signals)
    got = {(r.id, r.copy): np.array(r.x) for r in augment.copies(c, "id", "x").collect()}
    assert len(got) == 5 * len(signals)
    turns = set()
    for i, x in enumerate(signals[:12]):
        k = next(k for k in range(-40, 41) if np.allclose(np.roll(x, k), got[i, "shift"]))
        turns.add(k)
        ratio = got[i, "gain"] / x
        assert np.allclose(ratio, ratio[0]) and 10 ** (-6 / 20) <= ratio[0] <= 10 ** (6 / 20)
        zero = np.flatnonzero(got[i, "mask"] != x)
        assert not len(zero) or (zero[-1] - zero[0] + 1 == len(zero) <= 20 and not got[i, "mask"][zero].any())
        assert np.abs(got[i, "code"] - x).max() < 0.05 and len(set(got[i, "code"])) <= 256
        e = got[i, "noise"] - x
        assert abs(10 * np.log10((x @ x) / (e @ e)) - 20) < 1.5
    assert len(turns) > 5 and got[13, "shift"].size == 0 and not got[12, "gain"].any()
    again = {(r.id, r.copy): r.x for r in augment.copies(c.repartition(5), "id", "x").collect()}
    assert all(np.array_equal(again[k], v) for k, v in got.items())


def test_mixtures(spark):
    c = clips(spark, *[np.full(4 + i, float(i)) for i in range(9)])
    got = augment.mixed(c, "id", "x", "y").collect()
    assert len(got) == 8 and len({r.id for r in got}) == 8 and len({r.other for r in got}) == 8
    for r in got:
        assert 0.5 <= r.share <= 1 and len(r.x) == 4 + r.id and r.y == pytest.approx(r.share * (r.id % 2) + (1 - r.share) * (r.other % 2))
        assert r.x[0] == pytest.approx(r.share * r.id + (1 - r.share) * r.other)


def test_resampling_keeps_tones(spark):
    t = np.arange(1600) / 16000
    c = clips(spark, np.sin(2 * np.pi * 500 * t), np.sin(2 * np.pi * 500 * t) + np.sin(2 * np.pi * 7000 * t), [1.0])
    half = {r.id: np.array(r.x) for r in timefreq.resampled(c, "x", 16000, 8000).collect()}
    want = np.sin(2 * np.pi * 500 * np.arange(800) / 8000)
    assert np.allclose(half[0], want, atol=1e-9) and np.allclose(half[1], want, atol=1e-9) and len(half[2]) == 1
    more = {r.id: np.array(r.x) for r in timefreq.resampled(c, "x", 16000, 44100).collect()}
    assert len(more[0]) == 4410 and np.allclose(more[0], np.sin(2 * np.pi * 500 * np.arange(4410) / 44100), atol=1e-9)
    two = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "x array<array<double>>")
    assert two.select(timefreq.mono(F.col("x")).alias("m")).first().m == [2.0, 4.0]


def test_instantaneous_and_line_spectra(spark):
    t = np.arange(1000) / 8000
    h = clips(spark, 0.5 * np.sin(2 * np.pi * 400 * t)).select(timefreq.instantaneous(F.col("x"), 8000.0).alias("h")).first().h
    assert h[0] == pytest.approx(0.5, abs=0.01) and h[2] == pytest.approx(400, rel=0.01)
    c = [1.2, -0.8, 0.3, -0.1]
    w = spark.createDataFrame([(c,)], "c array<double>").select(timefreq.line_spectra(F.col("c")).alias("w")).first().w
    assert len(w) == 4 and all(a < b for a, b in zip(w, w[1:]))
    p = np.array([1, *(-np.array(c)), 0])
    for v in w:
        z = np.exp(1j * v)
        assert min(abs(np.polyval(p + p[::-1], z)), abs(np.polyval(p - p[::-1], z))) < 1e-9


def test_dimension_of_a_circle_and_a_line(spark):
    t = np.arange(300)
    rows = spark.createDataFrame([(0, int(i), float(np.sin(i * 0.7331))) for i in t] + [(1, int(i), 2.0) for i in range(20)], "g int, t long, y double")
    got = {r.g: r for r in neighbours.correlation_dimension(rows, ["g"], "t", "y").collect()}
    assert 0.8 < got[0].dimension < 1.2 and got[1].dimension == 0


def test_members_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/one.txt", "1")
        z.writestr("../two.txt", "2")
        z.writestr("/three.txt", "3")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, kind in (("x/four.txt", tarfile.REGTYPE), ("x/../../five.txt", tarfile.REGTYPE), ("link", tarfile.SYMTYPE)):
            i = tarfile.TarInfo(name)
            i.type, i.linkname, i.size = kind, "/etc/passwd", 1 if kind == tarfile.REGTYPE else 0
            t.addfile(i, io.BytesIO(b"4"))
    got = {r.member: (r.safe, r.content and bytes(r.content)) for r in files.members(spark, str(tmp_path)).collect()}
    assert got == {"in/one.txt": (True, b"1"), "../two.txt": (False, None), "/three.txt": (False, None), "x/four.txt": (True, b"4"), "x/../../five.txt": (False, None), "link": (False, None)}
    few = {r.member: r.content for r in files.members(spark, str(tmp_path), most=0).collect()}
    assert few["in/one.txt"] is None


def test_json_with_a_default(spark, tmp_path):
    default = spark.createDataFrame([("a", 1)], "name string, n long")
    assert files.load_json(spark, str(tmp_path / "none"), default).collect() == default.collect()
    files.save_json(spark.createDataFrame([("b", 2), ("c", None)], "name string, n long"), str(tmp_path / "t"))
    assert sorted(tuple(r) for r in files.load_json(spark, str(tmp_path / "t"), default).collect()) == [("b", 2), ("c", None)]
