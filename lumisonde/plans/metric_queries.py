"""Queries over detector metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisonde.functions.arrays import to_places
from lumisonde.operators import metrics as m
from lumisonde.plans.registry import query
from lumisonde.plans.views import REAL_SCORES, SCORES, real_scores, scores
from lumisonde.session import table

BY_SCORE = (
    SCORES
    + """, c AS (SELECT {g}, p, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY {g}, p),
b AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY {g}) AS np, sum(neg) OVER (PARTITION BY {g}) AS nn FROM c
  WINDOW d AS (PARTITION BY {g} ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""
)
VERTICES = (
    BY_SCORE
    + """, o AS (SELECT *, row_number() OVER w AS ord, tp - lag(tp, 1, 0) OVER w AS dt, fp - lag(fp, 1, 0) OVER w AS df, lead(tp) OVER w - tp AS nt, lead(fp) OVER w - fp AS nf
  FROM b WHERE np > 0 AND nn > 0 WINDOW w AS (PARTITION BY {g} ORDER BY p DESC)),
v AS (SELECT {g}, ord, p AS threshold, fp / nn AS fpr, tp / np AS tpr FROM o WHERE nt IS NULL OR dt <> nt OR df <> nf
  UNION ALL SELECT {g}, 0, 'inf'::DOUBLE, 0.0, 0.0 FROM o WHERE ord = 1)"""
)
RATES = """CASE WHEN tp + tn + fp + fn = 0 THEN 0 ELSE (tp + tn)::DOUBLE / (tp + tn + fp + fn) END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END AS f1"""
COUNTS = "count_if(y = 1 AND p >= {t}) AS tp, count_if(y = 0 AND p < {t}) AS tn, count_if(y = 0 AND p >= {t}) AS fp, count_if(y = 1 AND p < {t}) AS fn"


@query(f"WITH {BY_SCORE.format(g='source')} SELECT source, max(np)::BIGINT AS np, max(nn)::BIGINT AS nn, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN round(sum(pos * (nn - fp) + 0.5 * pos * neg)::DOUBLE / (max(np) * max(nn)), 6) ELSE 'nan'::DOUBLE END AS auc FROM b GROUP BY source")
def auc_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.roc_auc(scores(spark, sf_dir), ["source"]).withColumn("auc", to_places("auc", 6))


@query(f"WITH {BY_SCORE.format(g='lang')}, t AS (SELECT lang, p, np, nn, tp / greatest(np, 1) AS r, tp / (tp + fp) AS q FROM b), s AS (SELECT *, (r - lag(r, 1, 0.0) OVER w) * (q + lag(q, 1, 1.0) OVER w) / 2 AS piece FROM t WINDOW w AS (PARTITION BY lang ORDER BY p DESC)) SELECT lang, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN round(sum(piece), 6) ELSE 'nan'::DOUBLE END AS pr_auc FROM s GROUP BY lang")
def pr_auc_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.pr_auc(scores(spark, sf_dir), ["lang"]).withColumn("pr_auc", to_places("pr_auc", 6))


@query(f"WITH {VERTICES.format(g='lang')} SELECT lang, ord::INTEGER AS ord, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM v")
def roc_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.roc_points(scores(spark, sf_dir), ["lang"]).withColumns({"fpr": to_places("fpr", 6), "tpr": to_places("tpr", 6)})


@query(f"WITH {VERTICES.format(g='lang')}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(abs(fpr - (1 - tpr)), 12), ord) AS k FROM v) SELECT lang, round((fpr + 1 - tpr) / 2, 6) AS eer, threshold AS eer_threshold FROM r WHERE k = 1")
def eer_vertex_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.eer(scores(spark, sf_dir), ["lang"]).withColumn("eer", to_places("eer", 6))


@query(f"WITH {VERTICES.format(g='lang')}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(abs(fpr - (1 - tpr)), 12), ord) AS k FROM v) SELECT s.lang, round(avg(CASE WHEN (s.p >= r.threshold) = (s.y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy_at_eer FROM scores s JOIN r ON r.lang = s.lang AND k = 1 GROUP BY s.lang")
def accuracy_at_eer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.accuracy_at_eer(scores(spark, sf_dir), ["lang"]).withColumn("accuracy_at_eer", to_places("accuracy_at_eer", 6))


DET = (
    SCORES
    + """, a AS (SELECT source, count(*) OVER w AS ord, sum((y = 0)::INT) OVER w AS missed, sum((y = 1)::INT) OVER w AS caught, sum((y = 0)::INT) OVER (PARTITION BY source) AS nb,
  sum((y = 1)::INT) OVER (PARTITION BY source) AS ns, p FROM scores WINDOW w AS (PARTITION BY source ORDER BY p DESC, y, id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT source, ord, p AS threshold, missed / nb AS pmiss, (ns - caught) / ns AS pfa FROM a WHERE nb > 0 AND ns > 0
  UNION ALL SELECT source, 0, p + 1e-3, 0.0, 1.0 FROM a WHERE ord = 1 AND nb > 0 AND ns > 0)"""
)


@query(f"WITH {DET} SELECT source, ord, round(threshold, 6) AS threshold, round(pmiss, 6) AS pmiss, round(pfa, 6) AS pfa FROM d")
def det_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.det_curve(scores(spark, sf_dir), ["source"]).withColumns({c: to_places(c, 6) for c in ("threshold", "pmiss", "pfa")})


@query(f"WITH {DET}, t AS (SELECT source, min(({m.C1!r} * pmiss + {m.C2!r} * pfa) / {min(m.C1, m.C2)!r}) AS x FROM d GROUP BY source) SELECT s.source, round(coalesce(x, 1.0), 6) AS min_tdcf FROM (SELECT DISTINCT source FROM scores) s LEFT JOIN t USING (source)")
def min_tdcf_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.min_tdcf(scores(spark, sf_dir), ["source"]).withColumn("min_tdcf", to_places("min_tdcf", 6))


@query(f"WITH {SCORES}, c AS (SELECT lang, {COUNTS.format(t='0.5')} FROM scores GROUP BY lang) SELECT lang, tp, tn, fp, fn, {RATES}, CASE WHEN tn + fp = 0 THEN 0 ELSE tn::DOUBLE / (tn + fp) END AS specificity, CASE WHEN fp + tn = 0 THEN 0 ELSE fp::DOUBLE / (fp + tn) END AS fpr, CASE WHEN fn + tp = 0 THEN 0 ELSE fn::DOUBLE / (fn + tp) END AS fnr, CASE WHEN tn + fn = 0 THEN 0 ELSE tn::DOUBLE / (tn + fn) END AS npv FROM c")
def confusion_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.rates(m.confusion(scores(spark, sf_dir), ["lang"]))


CLASS = (
    SCORES
    + """, e AS (SELECT lang, label, count_if(y = label AND (p >= 0.5)::INT = label) AS tp, count_if(y <> label AND (p >= 0.5)::INT = label) AS fp,
  count_if(y = label AND (p >= 0.5)::INT <> label) AS fn, count_if(y = label) AS support FROM scores, (VALUES (0), (1)) t(label) GROUP BY lang, label),
k AS (SELECT lang, label, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END AS f1, support FROM e)"""
)


@query(f"WITH {CLASS} SELECT lang, label::VARCHAR AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM k UNION ALL SELECT lang, 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM k GROUP BY lang UNION ALL SELECT lang, 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM k GROUP BY lang")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.report(scores(spark, sf_dir), ["lang"]).withColumns({c: to_places(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {SCORES}, c AS (SELECT lang, threshold, {COUNTS.format(t='threshold')} FROM scores, (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) t(threshold) GROUP BY lang, threshold) SELECT lang, threshold, tp, tn, fp, fn, {RATES} FROM c")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.sweep(scores(spark, sf_dir), ["lang"]).drop("specificity", "fpr", "fnr", "npv")


@query(f"WITH {SCORES}, z AS (SELECT lang, y, ln(greatest(1e-7, least(1 - 1e-7, p)) / (1 - greatest(1e-7, least(1 - 1e-7, p)))) AS z FROM scores), g AS (SELECT lang, k, avg(CASE WHEN y = 1 THEN -ln(greatest(1e-12, least(1 - 1e-12, 1 / (1 + exp(-z / (k / 10.0::DOUBLE)))))) ELSE -ln(1 - greatest(1e-12, least(1 - 1e-12, 1 / (1 + exp(-z / (k / 10.0::DOUBLE)))))) END) AS nll FROM z, range(5, 50) t(k) GROUP BY lang, k), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(nll, 9), k) AS o FROM g) SELECT lang, k / 10.0::DOUBLE AS temperature, round(nll, 6) AS nll FROM r WHERE o = 1")
def temperature_grid_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.temperature_grid(scores(spark, sf_dir), ["lang"]).withColumn("nll", to_places("nll", 6))


@query(f"WITH {SCORES}, n AS (SELECT lang, y, CASE WHEN c = 'snr30' THEN p WHEN c = 'snr20' THEN CASE WHEN id % 5 = 0 THEN 1 - p ELSE p END ELSE CASE WHEN id % 2 = 0 THEN 1 - p ELSE p END END AS p, c FROM scores, (VALUES ('snr30'), ('snr20'), ('snr10')) t(c)), a AS (SELECT lang, c, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS a FROM n GROUP BY lang, c) SELECT lang, max(a) FILTER (c = 'snr30') AS snr30, max(a) FILTER (c = 'snr20') AS snr20, max(a) FILTER (c = 'snr10') AS snr10 FROM a GROUP BY lang")
def robustness_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).withColumn("condition", F.explode(F.array(F.lit("snr30"), F.lit("snr20"), F.lit("snr10"))))
    flip = ((F.col("condition") == "snr20") & (F.col("id") % 5 == 0)) | ((F.col("condition") == "snr10") & (F.col("id") % 2 == 0))
    return m.robustness(s.withColumn("p", F.when(flip, 1 - F.col("p")).otherwise(F.col("p"))), ["lang"], "condition", ["snr30", "snr20", "snr10"])


@query(f"WITH {BY_SCORE.format(g='lang')}, u AS (SELECT lang, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(pos * (nn - fp) + 0.5 * pos * neg)::DOUBLE / (max(np) * max(nn)) ELSE 'nan'::DOUBLE END AS auc FROM b GROUP BY lang), k AS (SELECT lang, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM scores GROUP BY lang) SELECT lang, round(accuracy, 6) AS accuracy, round(auc, 6) AS auc, NOT isnan(auc) AND auc >= 0.6 AND accuracy >= 0.55 AS converged FROM u JOIN k USING (lang)")
def convergence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.evaluate(scores(spark, sf_dir), ["lang"]).select("lang", to_places("accuracy", 6).alias("accuracy"), to_places("auc", 6).alias("auc"), "converged")


@query("WITH s AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value / 100.0::DOUBLE END AS p FROM events) SELECT event_id, CASE WHEN isnan(p) THEN 0.5 ELSE greatest(0.0, least(1.0, p)) END AS p FROM s")
def score_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("event_id") % 7
    p = F.when(r == 0, float("nan")).when(r == 1, float("inf")).when(r == 2, float("-inf")).otherwise(F.col("value") / 100.0)
    return table(spark, sf_dir, "events").select("event_id", m.sanitize(p).alias("p"))


# -- scores that are nearly all different --------------------------------------------------------

REAL_BY_SCORE = BY_SCORE.format(g="source").replace(SCORES, REAL_SCORES)
REAL_VERTICES = VERTICES.format(g="source").replace(SCORES, REAL_SCORES)


@query(f"WITH {REAL_BY_SCORE}, t AS (SELECT *, tp / greatest(np, 1) AS r, tp / (tp + fp) AS q FROM b), s AS (SELECT *, (r - lag(r, 1, 0.0) OVER w) * (q + lag(q, 1, 1.0) OVER w) / 2 AS piece FROM t WINDOW w AS (PARTITION BY source ORDER BY p DESC)) SELECT source, round(sum(pos * (nn - fp) + 0.5 * pos * neg)::DOUBLE / (max(np) * max(nn)), 6) AS auc, round(sum(piece), 6) AS pr_auc, count(*) AS scores FROM s GROUP BY source")
def areas_of_real_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = real_scores(spark, sf_dir)
    out = m.roc_auc(s, ["source"]).join(m.pr_auc(s, ["source"]), "source").join(s.groupBy("source").agg(F.count_distinct("p").alias("scores")), "source")
    return out.select("source", to_places("auc", 6).alias("auc"), to_places("pr_auc", 6).alias("pr_auc"), "scores")


@query(f"WITH {REAL_VERTICES} SELECT source, ord::INTEGER AS ord, round(threshold, 9) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM v")
def roc_of_real_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.roc_points(real_scores(spark, sf_dir), ["source"]).withColumns({c: to_places(c, n) for c, n in (("threshold", 9), ("fpr", 6), ("tpr", 6))})


@query(f"WITH {REAL_VERTICES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(abs(fpr - (1 - tpr)), 12), ord) AS k FROM v) SELECT source, round((fpr + 1 - tpr) / 2, 6) AS eer, round(threshold, 9) AS eer_threshold FROM r WHERE k = 1")
def eer_of_real_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.eer(real_scores(spark, sf_dir), ["source"]).withColumns({"eer": to_places("eer", 6), "eer_threshold": to_places("eer_threshold", 9)})


@query(f"WITH {REAL_BY_SCORE} SELECT source, round(least(min(({m.C1!r}::DOUBLE * fp / nn + {m.C2!r}::DOUBLE * (np - tp) / np) / {min(m.C1, m.C2)!r}::DOUBLE), {m.C2 / min(m.C1, m.C2)!r}::DOUBLE), 6) AS min_tdcf FROM b GROUP BY source")
def tdcf_of_real_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.min_tdcf(real_scores(spark, sf_dir), ["source"]).withColumn("min_tdcf", to_places("min_tdcf", 6))
