"""Queries over pitch, prediction, intervals, peaks, neighbours, scaling and wavelets; embeddings and events stand in for clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a
from lumisonde.functions import frames as fr
from lumisonde.functions import perceptual, prediction, timefreq, voice, wavelets
from lumisonde.operators import audit, augment, intervals, neighbours, peaks, scaling, speech
from lumisonde.plans.array_queries import DFT, DFT64, V, clips
from lumisonde.plans.registry import query
from lumisonde.session import shipped, table


def _round(df: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, places).alias(c) for c in df.columns if c not in keys])


# -- pitch: frames of 32 samples, every 16, lags from 2 to 15 ------------------------------------

PITCH = f"""{V}, j AS (SELECT vec_id, f, l, sum((x[f * 16 + k + 1] - x[f * 16 + k + l + 1]) ** 2) AS d FROM v, range(3) t(f), range(16) u(l), range(16) w(k) GROUP BY ALL),
 c AS (SELECT *, sum(d) OVER (PARTITION BY vec_id, f ORDER BY l) AS s FROM j), n AS (SELECT vec_id, f, l, CASE WHEN s > 1e-12 THEN d * l / s ELSE 1.0 END AS d FROM c),
 a AS (SELECT *, lag(d) OVER w AS b, lead(d) OVER w AS e FROM n WINDOW w AS (PARTITION BY vec_id, f ORDER BY l)),
 q AS (SELECT vec_id, f, coalesce(min(l) FILTER (d < 0.6::DOUBLE AND CASE WHEN l = 2 THEN d < e ELSE d < b AND coalesce(d <= e, true) END), arg_min(l, (d, l))) AS l FROM a WHERE l >= 2 GROUP BY vec_id, f),
 r AS (SELECT a.*, CASE WHEN a.l > 2 AND a.l < 15 AND b + e - 2 * d > 0 THEN (b - e) / (2 * (b + e - 2 * d)) ELSE 0.0 END AS h FROM a JOIN q USING (vec_id, f, l)),
 p AS (SELECT r.vec_id, f::INT AS frame, 16000 / (l + CASE WHEN abs(h) > 1 THEN 0 ELSE h END) AS f0, d AS dip, x[f * 16 + 1:f * 16 + 32] AS w FROM r JOIN v USING (vec_id)),
 pitch AS (SELECT *, dip < 0.5::DOUBLE AND list_sum(list_transform(w, lambda u: u * u)) / 32 > 1e-8 AS voiced FROM p)"""


def _pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.pitch(voice.cut(clips(spark, sf_dir), "vec_id", "x", 32, 16), 16000.0, 1070.0, 8000.0, 0.6)


@query(f"WITH {PITCH} SELECT vec_id, frame, round(f0, 4) AS f0, round(dip, 6) AS dip, voiced FROM pitch")
@shipped
def pitch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pitch(spark, sf_dir).select("vec_id", "frame", F.round("f0", 4).alias("f0"), F.round("dip", 6).alias("dip"), "voiced")


@query(f"""WITH {PITCH}, o AS (SELECT *, row_number() OVER w - 1 AS k, f0 - lag(f0) OVER w AS d FROM pitch WHERE voiced WINDOW w AS (PARTITION BY vec_id ORDER BY frame)),
 s AS (SELECT vec_id, avg(f0) AS mean, stddev_pop(f0) AS std, max(f0) - min(f0) AS range, median(f0) AS median, quantile_cont(f0, 0.75) - quantile_cont(f0, 0.25) AS iqr, CASE WHEN count(*) > 1 THEN regr_slope(f0, k) ELSE 0 END AS slope, stddev_pop(f0) / avg(f0) AS variation, count_if(d > 0) AS rises, count_if(d < 0) AS falls FROM o GROUP BY vec_id)
 SELECT vec_id, round(avg(voiced::INT), 6) AS voicing, {', '.join(f'round(coalesce(max({c}), 0), 4) AS {c}' for c in ('mean', 'std', 'range', 'median', 'iqr', 'slope', 'variation'))}, coalesce(max(rises), 0) AS rises, coalesce(max(falls), 0) AS falls FROM pitch LEFT JOIN s USING (vec_id) GROUP BY vec_id""")
@shipped
def pitch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = voice.pitch_statistics(_pitch(spark, sf_dir), "vec_id")
    return out.select("vec_id", F.round("voicing", 6).alias("voicing"), *[F.round(c, 4).alias(c) for c in ("mean", "std", "range", "median", "iqr", "slope", "variation")], "rises", "falls")


@query(f"""WITH {PITCH}, o AS (SELECT vec_id, frame, 16000 / f0 AS t, list_max(list_transform(w, lambda u: abs(u))) AS p, sqrt(list_sum(list_transform(w, lambda u: u * u)) / 32) AS r FROM pitch WHERE voiced),
 l AS (SELECT *, lag(t) OVER w AS t0, lag(p) OVER w AS p0, lag(r) OVER w AS r0, avg(t) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t3, row_number() OVER w AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM o WINDOW w AS (PARTITION BY vec_id ORDER BY frame))
 SELECT vec_id, round(coalesce(avg(abs(t - t0)) / avg(t), 0), 6) AS jitter, round(coalesce(avg(abs(p - p0)) / avg(p), 0), 6) AS shimmer, round(coalesce(avg(abs(20 * log10(r0 / r))), 0), 6) AS shimmer_db, round(coalesce(avg(abs(t - t3)) FILTER (k > 1 AND k < n) / avg(t), 0), 6) AS rap FROM l GROUP BY vec_id""")
@shipped
def pitch_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(voice.perturbation(_pitch(spark, sf_dir), "vec_id", 16000.0).drop("ppq", "apq"), "vec_id")


@query(f"""WITH {PITCH}, e AS (SELECT vec_id, list_sum(list_transform(w, lambda u: u * u)) AS e FROM pitch), s AS (SELECT vec_id, CASE WHEN quantile_cont(e, 0.1) > 0 THEN 10 * log10(avg(e) / quantile_cont(e, 0.1)) ELSE 100 END AS snr FROM e GROUP BY vec_id),
 t AS (SELECT vec_id, CASE WHEN voiced THEN list_sum(list_transform(range(32 - floor(16000 / f0)::INT), lambda i: w[i + 1] * w[i + 1 + floor(16000 / f0)::INT])) / list_sum(list_transform(w, lambda u: u * u)) ELSE 0 END AS q FROM pitch)
 SELECT vec_id, round(max(snr), 6) AS snr, round(avg(q), 6) AS strength FROM t JOIN s USING (vec_id) GROUP BY vec_id""")
@shipped
def voice_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pitch(spark, sf_dir)
    strength = voice.pitch_strength(p, 16000.0).groupBy("vec_id").agg(F.avg("strength").alias("strength"))
    return _round(voice.signal_to_noise(p, "vec_id").join(strength, "vec_id"), "vec_id")


@query()
@shipped
def harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonics against noise and the cepstral peak of frames."""
    p = _pitch(spark, sf_dir)
    m = p.withColumn("m", fr.magnitudes(F.zip_with("w", fr.hann(32), lambda v, h: v * h)))
    cpp = p.withColumn("cpp", voice.cepstral_peak(F.col("w"), 16000.0, 1070.0, 8000.0)).groupBy("vec_id").agg(F.avg("cpp").alias("cpp"))
    return _round(cpp.join(voice.harmonics_to_noise(m, "vec_id", 32, 16000.0), "vec_id", "left"), "vec_id")


# -- prediction ----------------------------------------------------------------------------------

LEVINSON = f"""{V}, r AS (SELECT vec_id, list_transform(range(4), lambda k: list_sum(list_transform(range(64 - k), lambda i: x[i + 1] * x[i + 1 + k]))) AS r FROM v),
 o AS (SELECT *, r[2] / r[1] AS k1 FROM r), p AS (SELECT *, r[1] * (1 - k1 * k1) AS e1, (r[3] - k1 * r[2]) / (r[1] * (1 - k1 * k1)) AS k2 FROM o),
 q AS (SELECT *, k1 - k2 * k1 AS a, k2 AS b, e1 * (1 - k2 * k2) AS e2, (r[4] - (k1 - k2 * k1) * r[3] - k2 * r[2]) / (e1 * (1 - k2 * k2)) AS k3 FROM p)"""


@query(f"WITH {LEVINSON} SELECT vec_id, round(a - k3 * b, 6) AS c1, round(b - k3 * a, 6) AS c2, round(k3, 6) AS c3, round(k1, 6) AS k1, round(k2, 6) AS k2, round(e2 * (1 - k3 * k3), 6) AS e, round(10 * log10(r[1] / (e2 * (1 - k3 * k3))), 6) AS gain, CASE WHEN abs(k3) > 0.1 THEN 3 WHEN abs(k2) > 0.1 THEN 2 WHEN abs(k1) > 0.1 THEN 1 ELSE 0 END AS effective_order, abs(k1) < 1 AND abs(k2) < 1 AND abs(k3) < 1 AS stable, round(a - k3 * b, 6) AS cep1, round(b - k3 * a + (a - k3 * b) * (a - k3 * b) / 2, 6) AS cep2 FROM q")
@shipped
def linear_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prediction.quality(prediction.predicted(clips(spark, sf_dir).withColumnRenamed("x", "w"), 3)).withColumn("cep", prediction.cepstrum(F.col("c"), 2))
    at = lambda c, k, n: F.round(F.get(c, F.lit(k)), 6).alias(n)
    return p.select("vec_id", *[at("c", k, f"c{k + 1}") for k in range(3)], at("k", 0, "k1"), at("k", 1, "k2"), F.round("e", 6).alias("e"), F.round("gain", 6).alias("gain"), "effective_order", "stable", at("cep", 0, "cep1"), at("cep", 1, "cep2"))


@query()
@shipped
def formant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(prediction.formant_statistics(prediction.formant_frames(clips(spark, sf_dir), "vec_id", "x", 32, 16, 8000.0), "vec_id"), "vec_id", places=3)


# -- intervals: parts as tape positions, by supplier ---------------------------------------------

SPANS = "s AS (SELECT l_suppkey, (l_orderkey * 37 + l_linenumber) % 20011 AS a, (l_orderkey * 37 + l_linenumber) % 20011 + CAST(l_quantity AS BIGINT) AS b, l_returnflag AS g FROM lineitem)"
PLACES = SPANS + ", x AS (SELECT DISTINCT l_suppkey, unnest(range(a, b)) AS p FROM s WHERE g = 'R'), y AS (SELECT DISTINCT l_suppkey, unnest(range(a, b)) AS p FROM s WHERE g = 'A')"
ISLES = "i AS (SELECT l_suppkey, p, p - row_number() OVER (PARTITION BY l_suppkey ORDER BY p) AS k FROM z) SELECT l_suppkey, min(p) AS start, max(p) + 1 AS \"end\" FROM i GROUP BY l_suppkey, k"


def _spans(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    start = (F.col("l_orderkey") * 37 + F.col("l_linenumber")) % 20011
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select("l_suppkey", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


@query(f"WITH {PLACES}, z AS (SELECT * FROM x UNION SELECT * FROM y), {ISLES}")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(_spans(spark, sf_dir, "R"), _spans(spark, sf_dir, "A"), ["l_suppkey"])


@query(f"WITH {PLACES}, z AS (SELECT * FROM x INTERSECT SELECT * FROM y), {ISLES}")
def interval_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intersection(_spans(spark, sf_dir, "R"), _spans(spark, sf_dir, "A"), ["l_suppkey"])


@query(f"WITH {PLACES}, z AS (SELECT * FROM x EXCEPT SELECT * FROM y), {ISLES}")
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As consonants are what of speech is no vowel."""
    return intervals.difference(_spans(spark, sf_dir, "R"), _spans(spark, sf_dir, "A"), ["l_suppkey"])


@query(f"WITH {PLACES}, f AS (SELECT l_suppkey, unnest(range(min(a), max(b))) AS p FROM s WHERE g = 'R' GROUP BY l_suppkey), z AS (SELECT * FROM f EXCEPT SELECT * FROM x), o AS (WITH {ISLES}), d AS (SELECT l_suppkey, (\"end\" - start) / 100.0::DOUBLE AS d FROM o) SELECT l_suppkey, count(*) AS count, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(max(d), 6) AS longest, round(sum(d), 6) AS total, round(avg((d < 0.2::DOUBLE)::INT), 6) AS short, round(avg((d >= 0.2::DOUBLE AND d < 0.5::DOUBLE)::INT), 6) AS medium, round(avg((d >= 0.5::DOUBLE)::INT), 6) AS long FROM d GROUP BY l_suppkey")
def pause_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir, "R")
    frame = spans.groupBy("l_suppkey").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    out = intervals.durations(intervals.gaps(spans, frame, ["l_suppkey"]), ["l_suppkey"], 100.0)
    return out.select("l_suppkey", "count", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, value FROM events), z AS (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS k FROM f WHERE value > 40) SELECT user_id, min(p) * 160 AS start, max(p) * 160 + 400 AS \"end\" FROM z GROUP BY user_id, k")
def speech_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames over a threshold as segments of samples."""
    from lumisonde.operators.ranks import ranked

    e = ranked(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], into="p").withColumn("p", F.col("p").cast("long") - 1)
    return intervals.runs(e, ["user_id"], "p", F.col("value") > 40, 160, 400)


# -- peaks ---------------------------------------------------------------------------------------

PEAKS = """f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, value FROM events),
 n AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS e FROM f WINDOW w AS (PARTITION BY user_id ORDER BY p)), c AS (SELECT user_id, p, value FROM n WHERE value > b AND value > e)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumisonde.operators.ranks import ranked

    e = ranked(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], into="p").withColumn("p", F.col("p").cast("long"))
    return peaks.candidates(e, ["user_id"], "p", "value")


@query(f"WITH RECURSIVE {PEAKS}, k AS (SELECT user_id, min(p) AS p FROM c GROUP BY user_id UNION ALL SELECT k.user_id, min(c.p) FROM k JOIN c ON c.user_id = k.user_id AND c.p >= k.p + 5 GROUP BY k.user_id, k.p) SELECT user_id, p, value FROM k JOIN c USING (user_id, p)")
def peaks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.picked(_candidates(spark, sf_dir), ["user_id"], "p", "value", 5)


@query(f"WITH RECURSIVE {PEAKS}, o AS (SELECT user_id, list({{'v': -value, 'p': -p}} ORDER BY -value, -p) AS o FROM c GROUP BY user_id), k AS (SELECT user_id, o, 1 AS i, []::BIGINT[] AS kept FROM o UNION ALL SELECT user_id, o, i + 1, CASE WHEN len(list_filter(kept, lambda q: abs(q + o[i].p) < 5)) > 0 THEN kept ELSE list_append(kept, -o[i].p) END FROM k WHERE i <= len(o)), z AS (SELECT user_id, unnest(kept) AS p FROM k WHERE i = len(o) + 1) SELECT user_id, p, value FROM z JOIN c USING (user_id, p)")
def peaks_by_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.picked(_candidates(spark, sf_dir), ["user_id"], "p", "value", 5, highest=True)


# -- neighbours and scaling ----------------------------------------------------------------------

SERIES = f"{V}, g AS (SELECT vec_id, x, list_stddev_pop(x) AS sd FROM v)"


@query(f"WITH {SERIES}, p AS (SELECT vec_id, count(*) AS a, count_if(greatest(i, j) <= 62 AND abs(x[i + 2] - x[j + 2]) <= 0.2::DOUBLE * sd) AS b FROM g, range(1, 64) s(i), range(1, 64) t(j) WHERE i < j AND abs(x[i] - x[j]) <= 0.2::DOUBLE * sd AND abs(x[i + 1] - x[j + 1]) <= 0.2::DOUBLE * sd GROUP BY vec_id) SELECT v.vec_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, CASE WHEN coalesce(a, 0) = 0 OR b = 0 THEN 'inf'::DOUBLE ELSE round(-ln(b / a), 6) END AS sample_entropy FROM v LEFT JOIN p USING (vec_id)")
def sample_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbours.sample_entropy(scaling.series_of(clips(spark, sf_dir), "vec_id", "x"), ["vec_id"], "i", "x")
    return out.withColumn("sample_entropy", F.round("sample_entropy", 6))


@query(f"""WITH {SERIES}, m AS (SELECT vec_id, i, j FROM g, range(1, 63) s(i), range(1, 63) t(j) WHERE sqrt((x[i] - x[j]) ** 2 + (x[i + 1] - x[j + 1]) ** 2 + (x[i + 2] - x[j + 2]) ** 2) < 0.6::DOUBLE * sd),
 d AS (SELECT vec_id, i, j, i - row_number() OVER (PARTITION BY vec_id, j - i ORDER BY i) AS k, i - row_number() OVER (PARTITION BY vec_id, j ORDER BY i) AS u FROM m),
 l AS (SELECT vec_id, count(*) AS l FROM d GROUP BY vec_id, j - i, k HAVING count(*) >= 2), q AS (SELECT vec_id, count(*) AS l FROM d GROUP BY vec_id, j, u HAVING count(*) >= 2),
 a AS (SELECT vec_id, count(*) AS n FROM m GROUP BY vec_id), b AS (SELECT vec_id, sum(l) AS s, avg(l) AS mean, max(l) AS most FROM l GROUP BY vec_id), c AS (SELECT vec_id, sum(l) AS s FROM q GROUP BY vec_id)
 SELECT vec_id, round(n / 3844, 6) AS recurrence_rate, round(b.s / n, 6) AS determinism, round(coalesce(c.s, 0) / n, 6) AS laminarity, round(mean, 6) AS mean_diagonal, most AS longest_diagonal FROM a JOIN b USING (vec_id) LEFT JOIN c USING (vec_id)""")
def recurrence_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbours.recurrence(scaling.series_of(clips(spark, sf_dir), "vec_id", "x"), ["vec_id"], "i", "x", 3, 0.6)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("recurrence_rate", "determinism", "laminarity", "mean_diagonal")], "longest_diagonal")


@query(f"""WITH {V}, e AS (SELECT vec_id, k, i % k AS o, abs(x[i + 1] - x[i + 1 - k]) AS d FROM v, range(1, 7) s(k), range(64) t(i) WHERE i >= k), h AS (SELECT vec_id, k, o, sum(d) * 63 / count(*) / k / k AS l FROM e GROUP BY vec_id, k, o),
 l AS (SELECT vec_id, k, ln(avg(l) + 1e-12) AS l FROM h GROUP BY vec_id, k), hi AS (SELECT vec_id, -regr_slope(l, ln(k)) AS higuchi FROM l GROUP BY vec_id),
 y AS (SELECT vec_id, i, sum(x[i + 1] - list_avg(x)) OVER (PARTITION BY vec_id ORDER BY i) AS y FROM v, range(64) t(i)),
 ds AS (SELECT DISTINCT floor(10 ** (log10(4) + j * (log10(16) - log10(4)) / 5) + 1e-9)::BIGINT AS s FROM range(6) t(j)), hs AS (SELECT DISTINCT floor(10 ** (log10(4) + j * (log10(8) - log10(4)) / 9) + 1e-9)::BIGINT AS s FROM range(10) t(j)),
 w AS (SELECT vec_id, s, i // s AS w, regr_syy(y, i) - coalesce(regr_sxy(y, i) ** 2 / regr_sxx(y, i), 0) AS rest FROM y, ds WHERE (i // s + 1) * s <= 64 GROUP BY vec_id, s, i // s),
 f AS (SELECT vec_id, s, ln(sqrt(avg(rest / s)) + 1e-12) AS f FROM w GROUP BY vec_id, s), df AS (SELECT vec_id, regr_slope(f, ln(s)) AS dfa FROM f GROUP BY vec_id),
 g AS (SELECT vec_id, s, i // s AS w, i, x[i + 1] AS x, x[i + 1] - avg(x[i + 1]) OVER (PARTITION BY vec_id, s, i // s) AS d FROM v, range(64) t(i), hs WHERE (i // s + 1) * s <= 64),
 c AS (SELECT *, sum(d) OVER (PARTITION BY vec_id, s, w ORDER BY i) AS c FROM g), r AS (SELECT vec_id, s, w, (max(c) - min(c)) / stddev_pop(x) AS rs FROM c GROUP BY vec_id, s, w HAVING stddev_pop(x) > 0),
 m AS (SELECT vec_id, s, ln(avg(rs)) AS rs FROM r GROUP BY vec_id, s), hu AS (SELECT vec_id, regr_slope(rs, ln(s)) AS hurst FROM m GROUP BY vec_id)
 SELECT vec_id, round(higuchi, 5) AS higuchi, round(hurst, 5) AS hurst, round(dfa, 5) AS dfa FROM hi JOIN hu USING (vec_id) JOIN df USING (vec_id)""")
def complexity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scaling.series_of(clips(spark, sf_dir), "vec_id", "x")
    out = scaling.higuchi(s, ["vec_id"]).join(scaling.hurst(s, ["vec_id"]), "vec_id").join(scaling.dfa(s, ["vec_id"]), "vec_id")
    return _round(out, "vec_id", places=5)


@query(f"WITH {V}, c AS (SELECT vec_id, s, list_transform(range(64 // s), lambda k: list_avg(x[k * s + 1:k * s + s])) AS y FROM v, range(1, 4) t(s)), g AS (SELECT vec_id, s, y, len(y) AS n, list_stddev_pop(y) AS sd FROM c), p AS (SELECT vec_id, s, count(*) AS a, count_if(greatest(i, j) <= n - 2 AND abs(y[i + 2] - y[j + 2]) <= 0.2::DOUBLE * sd) AS b FROM g, range(1, 64) u(i), range(1, 64) w(j) WHERE i < j AND j < n AND abs(y[i] - y[j]) <= 0.2::DOUBLE * sd AND abs(y[i + 1] - y[j + 1]) <= 0.2::DOUBLE * sd GROUP BY vec_id, s) SELECT vec_id, s::INT AS scale, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM g LEFT JOIN p USING (vec_id, s)")
def multiscale_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scaling.coarse(scaling.series_of(clips(spark, sf_dir), "vec_id", "x"), ["vec_id"])
    return neighbours.sample_entropy(s, ["vec_id", "scale"], "i", "x").select("vec_id", "scale", "a", "b")


# -- wavelets ------------------------------------------------------------------------------------

_HALF = "list_transform(range(len({x}) // 2), lambda k: ({x}[2 * k + 1] {s} {x}[2 * k + 2]) / sqrt(2))"


@query(f"""WITH {V}, a AS (SELECT vec_id, x, {_HALF.format(x='x', s='-')} AS d1, {_HALF.format(x='x', s='+')} AS a1 FROM v), b AS (SELECT *, {_HALF.format(x='a1', s='-')} AS d2, {_HALF.format(x='a1', s='+')} AS a2 FROM a),
 c AS (SELECT *, {_HALF.format(x='a2', s='-')} AS d3, {_HALF.format(x='a2', s='+')} AS approx FROM b), u AS (SELECT vec_id, list_sum(list_transform(x, lambda q: q * q)) AS e, unnest([{{'n': 'd1', 'c': d1}}, {{'n': 'd2', 'c': d2}}, {{'n': 'd3', 'c': d3}}, {{'n': 'approx', 'c': approx}}]) AS l FROM c),
 w AS (SELECT vec_id, e, l.n AS level, l.c AS c, list_sum(list_transform(l.c, lambda q: q * q)) AS own FROM u)
 SELECT vec_id, level, round(own / e, 6) AS share, round(list_sum(list_transform(c, lambda q: CASE WHEN q <> 0 THEN -(q * q / own) * log2(q * q / own) ELSE 0 END)), 6) AS entropy FROM w""")
def haar_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = wavelets.pyramid(clips(spark, sf_dir), "x", 3, wavelets.HAAR)
    e = wavelets.energies(p, 3)
    levels = [F.struct(F.lit(n).alias("level"), e[f"{n}_share"].alias("share"), e[f"{n}_entropy"].alias("entropy")) for n in ("d1", "d2", "d3", "approx")]
    return p.select("vec_id", F.explode(F.array(*levels)).alias("l")).select("vec_id", "l.level", F.round("l.share", 6).alias("share"), F.round("l.entropy", 6).alias("entropy"))


@query()
def wavelet_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and entropies of four levels under the filter of eight taps."""
    p = wavelets.pyramid(clips(spark, sf_dir), "x", 4)
    return p.select("vec_id", *[F.round(c, 6).alias(n) for n, c in wavelets.energies(p, 4).items()])


# -- perceptual measures: clips as one frame of 64 samples ---------------------------------------


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.transformed(clips(spark, sf_dir), "vec_id", "x", 64, 64)


def _scale(name: str, z: str, count: int) -> str:
    return f"""{name} AS (SELECT vec_id, least(floor({z.format(f='b * 250')} / {z.format(f='8000')} * {count}), {count - 1}) AS k, sum(m * m) AS e FROM d GROUP BY ALL),
 {name}p AS (SELECT vec_id, k, e / (sum(e) OVER (PARTITION BY vec_id) + 1e-10) AS p FROM {name}), {name}c AS (SELECT vec_id, sum(k * p) AS c FROM {name}p GROUP BY vec_id),
 {name}m AS (SELECT vec_id, max(c) AS centroid, sqrt(sum(p * (k - c) ** 2)) AS spread, -sum(p * log2(p + 1e-10)) AS entropy FROM {name}p JOIN {name}c USING (vec_id) GROUP BY vec_id)"""


BARK, ERB = "(13 * atan(0.00076::DOUBLE * {f}) + 3.5::DOUBLE * atan(({f} / 7500.0::DOUBLE) ** 2))", "(21.4::DOUBLE * log10(1 + 0.00437::DOUBLE * {f}))"


@query(f"WITH {DFT64}, {_scale('bark', BARK, 24)}, {_scale('erb', ERB, 40)} SELECT vec_id, " + ", ".join(f"round({n}m.{c}, 5) AS {n}_{c}" for n in ("bark", "erb") for c in ("centroid", "spread", "entropy")) + " FROM barkm JOIN erbm USING (vec_id)")
@shipped
def auditory_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perceptual.band_measures(perceptual.band_measures(_spectra(spark, sf_dir), 64, 16000.0), 64, 16000.0, "erb", 40)
    return _round(out.drop("frame", "m"), "vec_id", places=5)


@query(f"""WITH {DFT64}, z AS (SELECT vec_id, b, m, m * m AS p, {BARK.format(f='b * 250')} AS z FROM d), l AS (SELECT vec_id, avg((p / (mx * mx)) ** 0.3::DOUBLE) AS loudness, 0.11::DOUBLE * sum(p * z * CASE WHEN z > 15.8::DOUBLE THEN 0.066::DOUBLE * exp(0.171::DOUBLE * z) ELSE 1 END) / sum(p) AS sharpness,
 regr_slope(20 * log10(m + 1e-10), b * 250.0::DOUBLE) FILTER (b * 250 BETWEEN 100 AND 8000) AS tilt, sum(p) FILTER (b * 250 <= 500) / (sum(p) + 1e-10) AS low, sum(p) FILTER (b * 250 BETWEEN 500 AND 1000) / (sum(p) + 1e-10) AS mid, sum(p) FILTER (b * 250 > 4000) / (sum(p) + 1e-10) AS high FROM z JOIN t USING (vec_id) GROUP BY vec_id),
 r AS (SELECT x.vec_id, sum(x.m * y.m * exp(-(y.b - x.b) * 2.5::DOUBLE)) AS roughness FROM d x JOIN d y ON y.vec_id = x.vec_id AND y.b > x.b AND y.b <= x.b + 4 GROUP BY x.vec_id)
 SELECT vec_id, round(loudness, 6) AS loudness, round(sharpness, 6) AS sharpness, round(tilt, 8) AS tilt, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high, round(roughness, 6) AS roughness FROM l JOIN r USING (vec_id)""")
@shipped
def loudness_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, out = F.col("m"), perceptual.loudness(_spectra(spark, sf_dir), 64, 16000.0)
    share = perceptual.subbands(m, 64, 16000.0)
    made = {"loudness": F.col("loudness"), "sharpness": F.col("sharpness"), "low": share["band_0_500"], "mid": share["band_500_1000"], "high": share["high_share"], "roughness": perceptual.roughness(m, 64, 16000.0)}
    return out.select("vec_id", F.round(perceptual.tilt(m, 64, 16000.0), 8).alias("tilt"), *[F.round(c, 6).alias(n) for n, c in made.items()])


@query(f"""WITH {DFT64}, n AS (SELECT vec_id, b, m, lag(m) OVER w AS u, lead(m) OVER w AS v, max(m) OVER (PARTITION BY vec_id) AS top, sum(m * m) OVER (PARTITION BY vec_id) AS e FROM d WINDOW w AS (PARTITION BY vec_id ORDER BY b)), k AS (SELECT vec_id, b, m, e, arg_min(b, (-m, b)) OVER (PARTITION BY vec_id) AS f FROM n WHERE m > u AND m > v AND m >= 0.1::DOUBLE * top),
 h AS (SELECT vec_id, sum(m * abs(b / f - greatest(floor(b / f + 0.5), 1))) / sum(m) AS inharmonicity, sum(m * m) / (max(e) + 1e-10) AS tonality FROM k GROUP BY vec_id),
 c AS (SELECT vec_id, (round(12 * log2(b * 250 / 440.0::DOUBLE))::INT + 9 + 120) % 12 AS c, sum(m * m) AS e FROM d WHERE b > 0 GROUP BY ALL), q AS (SELECT vec_id, max(e) FILTER (c = 11) / max(e) AS class_b, max(e) FILTER (c = 9) / max(e) AS class_a FROM c GROUP BY vec_id)
 SELECT vec_id, round(inharmonicity, 6) AS inharmonicity, round(tonality, 6) AS tonality, round(coalesce(class_b, 0), 6) AS class_b, round(coalesce(class_a, 0), 6) AS class_a FROM q JOIN h USING (vec_id)""")
@shipped
def harmonicity_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perceptual.chroma(perceptual.harmonicity(_spectra(spark, sf_dir), 64, 16000.0), 64, 16000.0)
    at = lambda k, n: F.round(F.get("chroma", F.lit(k)), 6).alias(n)
    return out.select("vec_id", F.round("inharmonicity", 6).alias("inharmonicity"), F.round("tonality", 6).alias("tonality"), at(11, "class_b"), at(9, "class_a"))


# -- speech: frames of 8 samples, every 4, at 100 samples a second --------------------------------

SPEECH = f"""{V}, e AS (SELECT vec_id, f, x[f * 4 + 1:f * 4 + 8] AS w FROM v, range(15) t(f)), h AS (SELECT vec_id, f, w, list_transform(range(8), lambda i: w[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 7))) AS g FROM e),
 r AS (SELECT vec_id, f, list_sum(list_transform(w, lambda u: u * u)) AS e, list_transform(range(8), lambda k: list_sum(list_transform(range(8 - k), lambda i: g[i + 1] * g[i + 1 + k]))) AS r FROM h),
 j AS (SELECT vec_id, f, e / 8 > 0.01::DOUBLE AS s, r[1] > 0.001::DOUBLE AND list_max(r[2:]) > 0.3::DOUBLE * r[1] AS v FROM r),
 y AS (SELECT DISTINCT vec_id, unnest(range(f * 4, CASE WHEN f = 14 THEN 64 ELSE f * 4 + 4 END)) AS p FROM j WHERE s), u AS (SELECT DISTINCT vec_id, unnest(range(f * 4, f * 4 + 4)) AS p FROM j WHERE v)"""


@query(f"""WITH {SPEECH}, a AS (SELECT vec_id, unnest(range(64)) AS p FROM v), z AS (SELECT 'speech' AS kind, * FROM y UNION ALL SELECT 'vowel', * FROM u UNION ALL SELECT 'pause', * FROM (SELECT * FROM a EXCEPT SELECT * FROM y) UNION ALL SELECT 'consonant', * FROM (SELECT * FROM y EXCEPT SELECT * FROM u)),
 i AS (SELECT kind, vec_id, p, p - row_number() OVER (PARTITION BY kind, vec_id ORDER BY p) AS k FROM z) SELECT kind, vec_id, min(p) AS start, max(p) + 1 AS "end" FROM i GROUP BY kind, vec_id, k""")
@shipped
def speech_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    out = None
    for kind, of in (("speech", speech.speech), ("pause", speech.pauses), ("vowel", speech.vowels), ("consonant", speech.consonants)):
        found = of(c, "vec_id", "x", 8, 4).select(F.lit(kind).alias("kind"), "vec_id", "start", "end")
        out = found if out is None else out.unionByName(found)
    return out


@query()
@shipped
def speech_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    beats = speech.rhythm(c, "vec_id", "x", 8, 4, 100.0)
    return _round(speech.summary(c, "vec_id", "x", 8, 4, 100.0).join(beats, "vec_id", "left"), "vec_id")


# -- time and frequency: frames of 16 samples, every 8 -------------------------------------------


@query(f"""WITH {DFT}, q AS (SELECT *, sum(m) OVER (PARTITION BY vec_id, f ORDER BY b) AS upto, lag(m) OVER (PARTITION BY vec_id, b ORDER BY f) AS before FROM d), o AS (SELECT vec_id, f, sum(m) AS s, sum(m * m) AS power, sum(b * m) / (sum(m) + 1e-10) AS c FROM d GROUP BY vec_id, f)
 SELECT vec_id, f::INT AS frame, round(max(power), 6) AS power, round(max(c), 6) AS centroid, round(sqrt(sum(m * (b - c) ** 2) / (max(s) + 1e-10)), 6) AS bandwidth, min(b) FILTER (upto >= 0.85::DOUBLE * s)::INT AS rolloff, round(coalesce(sum((m - before) ** 2), 0), 6) AS flux,
 round(-sum(m * m / (power + 1e-10) * ln(m * m / (power + 1e-10) + 1e-10)), 6) AS entropy, round(max(m * m / (power + 1e-10)), 6) AS concentration, round(coalesce(sum(m * m) FILTER (b = 1), 0) / (max(power) + 1e-10), 6) AS octave0, round(coalesce(sum(m * m) FILTER (b BETWEEN 4 AND 7), 0) / (max(power) + 1e-10), 6) AS octave2
 FROM q JOIN o USING (vec_id, f) GROUP BY vec_id, f""")
@shipped
def spectrogram_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fr.transformed(clips(spark, sf_dir), "vec_id", "x", 16, 8)
    out = timefreq.spectrogram(m, "vec_id", 16).withColumn("o_", timefreq.octaves(F.col("m"), 16, 3))
    made = {c: F.col(c) for c in ("power", "centroid", "bandwidth", "flux", "entropy", "concentration")} | {f"octave{k}": F.get("o_", F.lit(k)) for k in (0, 2)}
    return out.select("vec_id", "frame", "rolloff", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query()
@shipped
def instantaneous_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope and instantaneous frequency of clips, and their length at half the rate."""
    out = timefreq.resampled(clips(spark, sf_dir).withColumn("h", timefreq.instantaneous(F.col("x"), 16000.0)), "x", 16000, 8000)
    names = ("envelope_mean", "envelope_std", "frequency_mean", "frequency_std")
    return out.select("vec_id", *[F.round(F.get("h", F.lit(k)), 4).alias(n) for k, n in enumerate(names)], F.size("x").alias("samples"), F.round(a.rms(F.col("x")), 6).alias("rms"))


@query()
@shipped
def line_spectral_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prediction.predicted(clips(spark, sf_dir).withColumnRenamed("x", "w"), 6).select("vec_id", "c")
    # c is an aggregate over lambdas, which no Python function can take: it is written where frames are kept; here it is exploded and gathered
    c = p.select("vec_id", F.posexplode("c").alias("i", "v")).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s")).select("vec_id", F.col("s.v").alias("c"))
    return c.select("vec_id", timefreq.line_spectra(F.col("c")).alias("w")).select("vec_id", F.posexplode("w").alias("number", "radians")).withColumn("radians", F.round("radians", 5))


# -- tabular features, copies --------------------------------------------------------------------


@query(f"WITH {V}, m AS (SELECT vec_id, x, list_avg(x) AS mean, list_var_pop(x) AS m2 FROM v) SELECT vec_id, round(mean, 6) AS mean, round(sqrt(m2), 6) AS std, round(list_avg(list_transform(x, lambda u: (u - mean) ** 3)) / m2 ** 1.5, 6) AS skew, round(list_sum(list_transform(x, lambda u: u * u)), 6) AS energy, round(quantile_cont(u, 0.25), 6) AS q25, round(median(u), 6) AS median, round(quantile_cont(u, 0.75), 6) AS q75 FROM m, unnest(x) AS t(u) GROUP BY vec_id, x, mean, m2")
@shipped
def tabular_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of clips with quartiles of their samples."""
    c = clips(spark, sf_dir)
    x, s = F.col("x"), a.statistics(F.col("x"))
    base = c.select("vec_id", *[s[n].alias(n) for n in ("mean", "std", "skew", "energy")])
    q = c.select("vec_id", F.explode("x").alias("u")).groupBy("vec_id").agg(*[F.percentile("u", F.lit(p)).alias(n) for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))])
    return _round(base.join(q, "vec_id"), "vec_id")


@query()
@shipped
def profile_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of cepstra, their slopes, spectral moments and trivial features: one row of numbers a clip."""
    c = clips(spark, sf_dir)
    m = fr.mfcc(fr.transformed(c, "vec_id", "x", 32, 8, fr.hamming(32)), "vec_id", 32, 16000.0, 6, 8, centred=False)
    d = fr.delta(m, "vec_id", "mfcc")
    at = lambda f, col, k, n: f(F.get(col, F.lit(k))).alias(f"{col}{k}_{n}")
    made = [at(f, col, k, n) for col in ("mfcc", "delta") for k in range(6) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    spectral = fr.summarized(fr.spectral(fr.transformed(c, "vec_id", "x", 16, 8), "vec_id", 16, 16000.0), "vec_id", ["centroid", "spread", "rolloff"])
    out = d.groupBy("vec_id").agg(*made).join(spectral, "vec_id").join(c.select("vec_id", *[v.alias(k) for k, v in audit.features(F.col("x")).items()]), "vec_id")
    return _round(out, "vec_id", places=4)


CODED = "sign(u) * ln(1 + 255 * least(abs(u), 1)) / ln(256)"


@query(f"WITH {V}, k AS (SELECT vec_id, list_transform(x, lambda u: floor(({CODED} + 1) / 2 * 255 + 0.5) / 255 * 2 - 1) AS k FROM v) SELECT vec_id, round(list_sum(list_transform(k, lambda u: sign(u) * (256 ** abs(u) - 1) / 255)), 6) AS total, round(list_max(list_transform(k, lambda u: sign(u) * (256 ** abs(u) - 1) / 255)), 6) AS most, len(list_distinct(k)) AS levels FROM k")
def coded_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = augment.copies(clips(spark, sf_dir), "vec_id", "x", ["code"])
    return c.select("vec_id", F.round(a.total(F.col("x")), 6).alias("total"), F.round(F.array_max("x"), 6).alias("most"), F.size(F.array_distinct("x")).cast("bigint").alias("levels"))


@query()
def altered_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every kind, told by their energy."""
    c = augment.copies(clips(spark, sf_dir), "vec_id", "x")
    return c.select("vec_id", "copy", F.round(a.energy(F.col("x")), 6).alias("energy"))


@query(f"WITH {V}, g AS (SELECT vec_id, x, list_stddev_pop(x) AS sd FROM v), p AS (SELECT vec_id, sd, sqrt((x[i] - x[j]) ** 2 + (x[i + 1] - x[j + 1]) ** 2 + (x[i + 2] - x[j + 2]) ** 2) AS d FROM g, range(1, 63) s(i), range(1, 63) t(j) WHERE i < j), r AS (SELECT 0.1::DOUBLE * pow(10, k / 9.0::DOUBLE) AS r FROM range(10) u(k)), c AS (SELECT vec_id, r, count(*) AS c FROM p, r WHERE d <= sd * r GROUP BY vec_id, r), n AS (SELECT vec_id, count(*) AS pairs FROM p WHERE d <= sd GROUP BY vec_id), o AS (SELECT vec_id, CASE WHEN count(*) > 1 THEN regr_slope(ln(c), ln(r)) END AS dimension FROM c GROUP BY vec_id) SELECT v.vec_id, coalesce(pairs, 0) AS pairs, round(dimension, 5) AS dimension FROM v LEFT JOIN n USING (vec_id) LEFT JOIN o USING (vec_id)")
def correlation_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbours.correlation_dimension(scaling.series_of(clips(spark, sf_dir), "vec_id", "x"), ["vec_id"], "i", "x")
    return out.withColumn("dimension", F.round("dimension", 5))
