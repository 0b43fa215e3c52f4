"""Queries over array columns and strings; embeddings stand in for clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a
from lumisonde.functions import frames as fr
from lumisonde.operators.ranks import cuts_of, ordered
from lumisonde.plans.registry import query
from lumisonde.session import shipped, table

V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def rounded(df: DataFrame, key: str, columns: dict, places: int = 6) -> DataFrame:
    return df.select(key, *[F.round(c, places).alias(n) for n, c in columns.items()])


MOMENTS = "m AS (SELECT vec_id, x, list_avg(x) AS mean, list_var_pop(x) AS m2 FROM v)"


@query(f"WITH {V}, {MOMENTS} SELECT vec_id, round(mean, 6) AS mean, round(sqrt(m2), 6) AS std, round(list_avg(list_transform(x, lambda u: (u - mean) ** 3)) / m2 ** 1.5, 6) AS skew, round(list_avg(list_transform(x, lambda u: (u - mean) ** 4)) / (m2 * m2) - 3, 6) AS kurtosis, round(list_max(list_transform(x, lambda u: abs(u))), 6) AS peak, round(sqrt(list_avg(list_transform(x, lambda u: u * u))), 6) AS rms, round(list_max(list_transform(x, lambda u: abs(u))) / sqrt(list_avg(list_transform(x, lambda u: u * u))), 6) AS crest, round(list_max(x) - list_min(x), 6) AS range, round(list_sum(list_transform(x, lambda u: u * u)), 6) AS energy FROM m")
def time_domain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clips(spark, sf_dir), "vec_id", a.statistics(F.col("x")))


@query(f"WITH {V} SELECT vec_id, round(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN (x[i] < 0) <> (x[i + 1] < 0) THEN 1.0::DOUBLE ELSE 0.0 END)) / 63, 6) AS zcr FROM v")
def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clips(spark, sf_dir), "vec_id", {"zcr": a.sign_changes(F.col("x"))})


@query(f"WITH {V}, s AS (SELECT vec_id, x, list_sort(x) AS o FROM v), d AS (SELECT vec_id, x, (o[32] + o[33]) / 2 AS med FROM s), r AS (SELECT vec_id, x, med, list_sort(list_transform(x, lambda u: abs(u - med))) AS q FROM d) SELECT vec_id, round((x[1] - list_min(x)) / (list_max(x) - list_min(x)), 6) AS minmax, round((x[1] - list_avg(x)) / list_stddev_pop(x), 6) AS zscore, round((x[1] - med) / ((q[32] + q[33]) / 2), 6) AS robust FROM r")
def normalize_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return rounded(clips(spark, sf_dir), "vec_id", {m: F.get(a.normalize(x, m), F.lit(0)) for m in ("minmax", "zscore", "robust")})


@query(f"WITH {V} SELECT vec_id, round(list_sum(x[13:52]), 6) AS cropped, round(list_sum(x) , 6) AS padded, round(list_sum(x) + list_sum(x[1:36]), 6) AS tiled FROM v")
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return rounded(clips(spark, sf_dir), "vec_id", {"cropped": a.total(a.fit(x, 40)), "padded": a.total(a.fit(x, 100)), "tiled": a.total(a.fit(x, 100, tile=True))})


@query(f"WITH {V} SELECT vec_id, i::INT AS segment, len(x[i * 10 + 1:i * 10 + 16]) AS n, round(list_sum(list_transform(x[i * 10 + 1:i * 10 + 16], lambda u: u * u)), 6) AS energy FROM v, range(7) t(i) WHERE len(x[i * 10 + 1:i * 10 + 16]) >= 8")
def segments_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clips(spark, sf_dir).select("vec_id", F.posexplode(a.segments(F.col("x"), 16, 10, 8)).alias("segment", "w"))
    return s.select("vec_id", "segment", F.size("w").cast("long").alias("n"), F.round(a.energy(F.col("w")), 6).alias("energy"))


@query(f"WITH {V}, s AS (SELECT vec_id, unnest([x[1:16], x[17:32], x[33:48], x[49:64]]) AS w FROM v), e AS (SELECT vec_id, sqrt(list_avg(list_transform(w, lambda u: u * u))) AS r FROM s) SELECT vec_id, count(*) AS segments, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS least, round(max(r), 6) AS most, round(median(r), 6) AS middle FROM e GROUP BY vec_id")
def segment_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clips(spark, sf_dir).select("vec_id", F.explode(a.segments(F.col("x"), 16, 16)).alias("w")).select("vec_id", a.rms(F.col("w")).alias("r"))
    out = s.groupBy("vec_id").agg(F.count(F.lit(1)).alias("segments"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("least"), F.max("r").alias("most"), F.median("r").alias("middle"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "least", "most", "middle")})


@query(f"WITH {V}, g AS (SELECT vec_id, x, least((10 ** (-23 / 20.0::DOUBLE)) / sqrt(list_avg(list_transform(x, lambda u: u * u))), 0.95 / list_max(list_transform(x, lambda u: abs(u)))) AS gain FROM v) SELECT vec_id, round(gain * x[1], 6) AS first, round(gain * list_max(x), 6) AS most, sqrt(list_avg(list_transform(x, lambda u: u * u))) < 10 ** (-50 / 20.0::DOUBLE) AS silent FROM g")
def gain_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    y = a.agc(x)
    return clips(spark, sf_dir).select("vec_id", F.round(F.get(y, F.lit(0)), 6).alias("first"), F.round(F.array_max(y), 6).alias("most"), a.silent(x).alias("silent"))


@query("WITH o AS (SELECT user_id, (value <= lead(value) OVER w)::INT * 4 + (lead(value) OVER w <= lead(value, 2) OVER w)::INT * 2 + (value <= lead(value, 2) OVER w)::INT AS pat, lead(value, 2) OVER w IS NOT NULL AS whole FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT user_id, pat, count(*) AS n FROM o WHERE whole GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY user_id")
def permutation_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    cuts = cuts_of(e, "ts")
    e = ordered(e, ["user_id"], ["ts", "event_id"], after={"y": "value"}, cuts=cuts)
    e = ordered(e, ["user_id"], ["ts", "event_id"], after={"z": "y"}, cuts=cuts)
    x, y, z = F.col("value"), F.col("y"), F.col("z")
    bit = lambda c, n: c.cast("int") * n
    seen = e.select("user_id", z.isNotNull().alias("whole"), (bit(x <= y, 4) + bit(y <= z, 2) + bit(x <= z, 1)).alias("pattern"))
    counts = seen.where("whole").groupBy("user_id", "pattern").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    # -sum(p log p) from the counts of at most six patterns
    return counts.groupBy("user_id").agg(F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 6).alias("entropy"))


DFT64 = """s AS (SELECT vec_id, k, embedding[k + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * k / 63)) AS v FROM embeddings, range(64) u(k)),
 d AS (SELECT vec_id, b, sqrt(sum(v * cos(2 * pi() * k * b / 64)) ** 2 + sum(v * sin(2 * pi() * k * b / 64)) ** 2) AS m FROM s, range(33) r(b) GROUP BY ALL),
 t AS (SELECT vec_id, sum(m) AS s, sum(b * 250 * m) / (sum(m) + 1e-10) AS c, sum(m * m) AS power, avg(m) AS mu, max(m) AS mx, exp(avg(ln(m + 1e-10))) AS g FROM d GROUP BY vec_id)"""


@query(f"WITH {DFT64}, u AS (SELECT vec_id, b, sum(m * m) OVER (PARTITION BY vec_id ORDER BY b) AS upto FROM d), o AS (SELECT vec_id, min(b * 250.0::DOUBLE) FILTER (upto >= 0.85::DOUBLE * power) AS rolloff FROM u JOIN t USING (vec_id) GROUP BY vec_id) SELECT vec_id, round(max(c), 3) AS centroid, round(sum((b * 250 - c) ** 2 * m / (s + 1e-10)), 1) AS spread, round(-sum(m / (s + 1e-10) * log2(m / (s + 1e-10) + 1e-10)), 6) AS entropy, max(rolloff) AS rolloff, round(max(g / (mu + 1e-10)), 6) AS flatness, round(max(mx / (mu + 1e-10)), 6) AS crest, round(sum(m * m) FILTER (b > 16) / (max(power) + 1e-10), 6) AS high_share FROM d JOIN t USING (vec_id) JOIN o USING (vec_id) GROUP BY vec_id")
@shipped
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole clips, as one frame each."""
    out = fr.spectral(fr.transformed(clips(spark, sf_dir), "vec_id", "x", 64, 64), "vec_id", 64, 16000.0)
    power = F.transform("m", lambda v: v * v)
    high = a.total(F.slice(power, 18, 64)) / (a.total(power) + 1e-10)
    return out.select("vec_id", F.round("centroid", 3).alias("centroid"), F.round("spread", 1).alias("spread"), F.round("entropy", 6).alias("entropy"), "rolloff", F.round("flatness", 6).alias("flatness"), F.round("crest", 6).alias("crest"), F.round(high, 6).alias("high_share"))


@query(f"WITH {DFT64}, l AS (SELECT j, b, greatest(0, least((b * 250 - j * 8000 / 9.0::DOUBLE) / (8000 / 9.0::DOUBLE), ((j + 2) * 8000 / 9.0::DOUBLE - b * 250) / (8000 / 9.0::DOUBLE))) AS w FROM range(8) t(j), range(33) u(b)), e AS (SELECT vec_id, j, ln(sum(m * m * w) + 1e-6) AS e FROM d JOIN l USING (b) GROUP BY ALL) SELECT vec_id, c::INT AS coefficient, round(sum(e * cos(pi() * c * (2 * j + 1) / 16)) * sqrt(CASE WHEN c = 0 THEN 1 ELSE 2 END / 8.0::DOUBLE), 6) AS value FROM e, range(5) t(c) GROUP BY vec_id, c")
@shipped
def cepstral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear cepstra of whole clips, as one frame each."""
    out = fr.lfcc(fr.transformed(clips(spark, sf_dir), "vec_id", "x", 64, 64), 64, 16000.0, 5, 8)
    return out.select("vec_id", F.posexplode("lfcc").alias("coefficient", "value")).withColumn("value", F.round("value", 6))


@query("SELECT event_type, sum(CAST(props->>'k' AS BIGINT)) AS total, count(props->>'k') AS n FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("n"))


@query("SELECT doc_id, regexp_extract(source, '^[a-z]+', 0) AS source, lower(regexp_replace(concat(lang, '-', source), '[^A-Za-z0-9]', '', 'g')) AS slug, left(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), 20) AS safe, CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0::DOUBLE) ELSE printf('%.1f MB', n_chars / 1048576.0::DOUBLE) END AS size FROM documents")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", a.source_of(F.concat(F.lit("x/"), F.col("source"))).alias("source"), a.slug(F.concat_ws("-", "lang", "source")).alias("slug"), a.safe_name(F.col("text"), 20).alias("safe"), a.human_size(F.col("n_chars").cast("double")).alias("size"))


DFT = """s AS (SELECT vec_id, f, k, embedding[f * 8 + k + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * k / 15)) AS v FROM embeddings, range(7) t(f), range(16) u(k)),
 d AS (SELECT vec_id, f, b, sqrt(sum(v * cos(2 * pi() * k * b / 16)) ** 2 + sum(v * sin(2 * pi() * k * b / 16)) ** 2) AS m FROM s, range(9) r(b) GROUP BY ALL),
 t AS (SELECT vec_id, f, sum(m) AS s, sum(b * 1000 * m) / (sum(m) + 1e-10) AS c, avg(m) AS mu, max(m) AS mx, exp(avg(ln(m + 1e-10))) / (avg(m) + 1e-10) AS flatness, sum(m * m) AS power,
  regr_slope(ln(m + 1e-10), ln(greatest(b, 1) * 1000)) FILTER (b > 0) AS slope, sum(b * (m - m0)) / (36 * max(m0)) AS decrease FROM (SELECT *, first(m) OVER (PARTITION BY vec_id, f ORDER BY b) AS m0 FROM d) GROUP BY vec_id, f),
 g AS (SELECT *, lag(m) OVER (PARTITION BY vec_id, b ORDER BY f) AS before, lag(m) OVER (PARTITION BY vec_id, f ORDER BY b) AS lower, sum(m * m) OVER (PARTITION BY vec_id, f ORDER BY b) AS upto FROM d),
 e AS (SELECT vec_id, f, max(c) AS centroid, sum((b * 1000 - c) ** 2 * m / (s + 1e-10)) AS spread, sum((b * 1000 - c) ** 3 * m / (s + 1e-10)) AS m3, sum((b * 1000 - c) ** 4 * m / (s + 1e-10)) AS m4,
  -sum(m / (s + 1e-10) * log2(m / (s + 1e-10) + 1e-10)) AS entropy, min(b * 1000) FILTER (upto >= 0.85::DOUBLE * power) AS rolloff, max(flatness) AS flatness, max(mx / (mu + 1e-10)) AS crest, max(slope) AS slope, max(decrease) AS decrease,
  sum(abs(m - lower)) / (max(s) + 1e-10) AS irregularity, coalesce(sum(greatest(m - before, 0)), 0) AS flux FROM g JOIN t USING (vec_id, f) GROUP BY vec_id, f)"""
FRAME = ("centroid", "spread", "entropy", "rolloff", "flatness", "crest", "slope", "decrease", "irregularity", "flux")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.spectral(fr.transformed(clips(spark, sf_dir), "vec_id", "x", 16, 8), "vec_id", 16, 16000.0)


@query(f"WITH {DFT} SELECT vec_id, f::INT AS frame, {', '.join(f'CASE WHEN round({c}, 4) = 0 THEN 0.0::DOUBLE ELSE round({c}, 4) END AS {c}' for c in FRAME)}, round(m3 / (sqrt(spread) + 1e-10) ** 3, 4) AS skewness, round(m4 / (sqrt(spread) + 1e-10) ** 4 - 3, 4) AS kurtosis FROM e")
@shipped
def frame_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = lambda c: F.when(F.round(c, 4) == 0, 0.0).otherwise(F.round(c, 4)).alias(c)  # noqa: E731  no negative zero
    return _frames(spark, sf_dir).select("vec_id", "frame", *[plain(c) for c in FRAME], *[F.round(c, 4).alias(c) for c in ("skewness", "kurtosis")])


@query(f"WITH {DFT} SELECT vec_id, {', '.join(f'round({f}({c}), 4) AS {c}_{n}' for c in ('centroid', 'flux') for n, f in (('mean', 'avg'), ('std', 'stddev_pop'), ('min', 'min'), ('max', 'max')))} FROM e GROUP BY vec_id")
@shipped
def frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fr.summarized(_frames(spark, sf_dir), "vec_id", ["centroid", "flux"])
    return out.select("vec_id", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query()
@shipped
def frame_cepstra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame mel bands in dB, liftered and linear cepstra, and the slopes of the first."""
    m = fr.transformed(clips(spark, sf_dir), "vec_id", "x", 32, 8, fr.hamming(32))
    m = m.withColumn("mel", fr.bands(F.col("m"), fr.triangles(fr.mel_edges(8, 80.0, 8000.0), 32, 16000.0)))
    m = fr.lfcc(fr.mfcc(fr.decibels(m, "vec_id", "mel"), "vec_id", 32, 16000.0, 6, 8), 32, 16000.0, 6, 8)
    return fr.delta(m, "vec_id", "mfcc").select("vec_id", "frame", "mel", "mfcc", "lfcc", "delta")
