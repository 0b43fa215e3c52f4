"""Rounding, order and formats against SQL where engines differ: ties, signs of zero, nulls, sums in any order."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return f"{tmp_path}/{name}.parquet/*.parquet"


def same(spark, tmp_path, query, table, rows, schema):
    """The query over one table against its SQL, as text, which shows the sign of a zero."""
    from lumisonde.plans.registry import ORACLE, QUERIES

    files = written(spark, tmp_path, table, rows, schema)
    df = QUERIES[query](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{files}'")
    got = con.execute(ORACLE[query])
    names = [d[0] for d in got.description]
    want = sorted(str(r) for r in got.fetchall())
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == want
    return want


def test_to_places_is_sql_round(spark):
    values = [0.0, -0.0, -1e-7, 1e-7, 0.5e-6, -0.5e-6, 2.5e-6, 1.0000005, 0.1234565, -0.1234565, 0.285, 1.005, 123456.7890125, 1e300, math.inf, -math.inf, math.nan, 0.49999999999999994e-6]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [str(r[0]) for r in df.select(a.to_places("v", 6)).collect()]
    con = duckdb.connect()
    assert got == [str(con.execute("select round(?::double, 6)", [v]).fetchone()[0]) for v in values]


def clip(i, *first):
    rest = [((i * 37 + k * 101) % 997 - 498) / 1000.0 for k in range(64 - len(first))]
    return (i, i % 3, [*first, *rest])


CLIPS = [clip(1, -1e-7, 1e-7, -3e-7), clip(5, 0.25, -4e-7), clip(8, 0.0, -0.0, -2e-7), clip(63)]
CLIP = "vec_id long, label int, embedding array<float>"


def test_array_shapes_small_negatives(spark, tmp_path):
    assert any("-0.0" in r for r in same(spark, tmp_path, "array_shapes", "embeddings", CLIPS, CLIP))


def test_padded_windows_small_negatives(spark, tmp_path):
    assert any("-0.0" in r for r in same(spark, tmp_path, "padded_windows", "embeddings", CLIPS, CLIP))


def test_prepare_clips_small_negatives(spark, tmp_path):
    assert any("-0.0" in r for r in same(spark, tmp_path, "prepare_clips", "embeddings", CLIPS, CLIP))


def test_roc_rates_at_ties(spark, tmp_path):
    # 640 negatives: 41 / 640 and others are ties at six places, where binary products fall to either side
    flags = [("R" if k % 2 else "A") for k in range(1280)]
    rows = [(k + 1, 1, 900.0 + 150.0 * k, f, "O") for k, f in enumerate(flags)]
    same(spark, tmp_path, "roc_of_real_scores", "lineitem", rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string")


LINE = "l_orderkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string"


def test_roc_of_missing_scores_and_labels(spark, tmp_path):
    """Scores that are NaN come first, missing ones last; points above the first label have no rates."""
    rows = [(k, 1 + k % 7, 900.0 + 150.0 * (k * 37 % 50), "RAN"[k % 3], "OFX"[k % 3 - k % 2]) for k in range(300)]
    rows += [(1000 + k, 1, None, "RA"[k % 2], "O") for k in range(4)] + [(None, 1, 500.0, "R", "F"), (5, None, 500.0, "A", "F")]
    rows += [(1100 + k, 1, math.nan, "RAA"[k % 3], "F") for k in range(4)] + [(1200 + k, 1, 9e6 - k, None, "OX"[k % 2]) for k in range(5)]
    rows += [(1300 + k, 1, 2000.0 + k, None, "OFX"[k % 3]) for k in range(9)] + [(1400, 1, math.inf, "A", "X"), (1401, 1, -math.inf, "R", "X")]
    want = same(spark, tmp_path, "roc_of_real_scores", "lineitem", rows, LINE)
    assert any("nan" in r for r in want) and any("None, None" in r for r in want) and any(r.count("None") == 1 for r in want)


ORDERS = [(k, 500.0 * k - 1000.0, f"1995-01-{1 + k % 28:02d}") for k in range(400)] + [(1000, 1234567.891, "1996-02-03"), (1001, 12500000.0, "1996-02-03")]


def test_formats_at_ties(spark, tmp_path):
    """0.15 is less than its digits say, 0.25 is a tie."""
    rows = [(k, p, __import__("datetime").datetime.fromisoformat(d)) for k, p, d in ORDERS]
    same(spark, tmp_path, "formats", "orders", rows, "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz")


def test_fusion_does_not_depend_on_the_order_of_rows(spark):
    """The sum of three scores is 1.2 in one order and just above in another; their mean is then 0.4 or just above, and majority the vote or the mean."""
    from itertools import permutations

    from lumisonde.operators.fusion import fuse

    parts = [(k, m, p, 1.0) for k in range(1, 10) for m, p in (("a", k / 10), ("b", 1 - k / 10), ("c", 0.2))]
    seen = set()
    for order in permutations("abc"):
        rows = [spark.createDataFrame([r for r in parts if r[1] == m], "id int, model string, p double, w double").coalesce(1) for m in order]
        out = fuse(rows[0].unionByName(rows[1]).unionByName(rows[2]).coalesce(1), "id")
        seen.add(str(sorted(map(tuple, out.collect()))))
    assert len(seen) == 1


def test_pitch_strength_has_no_rows_of_lags(spark):
    """Frames of any length: a period over 4,096 samples counts as well, and no array of lags goes through Python."""
    from lumisonde.functions import voice

    w = [math.sin(2 * math.pi * k / 5000) for k in range(12000)]
    df = spark.createDataFrame([(1, w, 3.2, True), (2, w[:100], 3.2, True), (3, w, 3.2, False)], "id int, w array<double>, f0 double, voiced boolean")
    out = voice.pitch_strength(df, 16000.0)
    want = sum(u * v for u, v in zip(w, w[5000:])) / sum(u * u for u in w)
    got = [r["strength"] for r in out.orderBy("id").collect()]
    assert abs(got[0] - want) < 1e-12 and got[1:] == [0.0, 0.0]
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
