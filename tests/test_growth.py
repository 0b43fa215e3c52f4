"""Parts and ranges whose number follows the table, so that no task grows with it."""

from __future__ import annotations

from lumisonde.operators import ranks, scaling


def test_ranges_follow_the_rows(spark):
    rows = spark.range(10_000)
    assert len(ranks.cuts_of(rows, "id")) == ranks.RANGES - 1
    cuts = ranks.cuts_of(rows, "id", each=100)
    assert len(cuts) == 127 and max(b - a for a, b in zip(cuts, cuts[1:])) <= 100
    out = ranks.ordered(rows, [], ["id"], number="k", cuts=cuts)
    assert out.where("k <> id + 1").count() == 0


def test_series_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(scaling, "ROWS", 320)
    clips = spark.range(100).selectExpr("id", "transform(sequence(1, 64), k -> double(k)) AS x")
    s = scaling.series_of(clips, "id", "x")
    assert s.count() == 6400 and s.rdd.getNumPartitions() == 20
