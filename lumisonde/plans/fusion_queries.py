"""Queries over fused and post-processed scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisonde.operators import fusion as f
from lumisonde.plans.registry import query
from lumisonde.plans.views import SCORES, scores
from lumisonde.session import table

MODELS = "m AS (SELECT id, 'a' AS model, p, 0.5::DOUBLE AS w FROM scores UNION ALL SELECT id, 'b', 1 - p, 0.3::DOUBLE FROM scores WHERE id % 3 > 0 UNION ALL SELECT id, 'c', (id % 101) / 100.0::DOUBLE, 0.2::DOUBLE FROM scores)"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' scores of each sample; one of them lacks every third."""
    s = scores(spark, sf_dir).select("id", "p")
    a = s.select("id", F.lit("a").alias("model"), "p", F.lit(0.5).alias("w"))
    b = s.where("id % 3 > 0").select("id", F.lit("b").alias("model"), (1 - F.col("p")).alias("p"), F.lit(0.3).alias("w"))
    c = s.select("id", F.lit("c").alias("model"), ((F.col("id") % 101) / 100.0).alias("p"), F.lit(0.2).alias("w"))
    return a.unionByName(b).unionByName(c)


@query(f"WITH {SCORES}, {MODELS}, g AS (SELECT id, sum(p * w) / sum(w) AS weighted, avg(p) AS soft, count_if(p > 0.5) AS votes, count(*) AS models, arg_max(p, (round(abs(p - 0.5), 9), model)) AS max_conf FROM m GROUP BY id) SELECT id, round(weighted, 6) AS weighted, round(soft, 6) AS soft, votes, models, round(max_conf, 6) AS max_conf, round(CASE WHEN soft > 0.4 AND soft < 0.6 THEN soft WHEN 2 * votes > models THEN 1.0 ELSE 0.0 END, 6) AS majority, round(greatest(votes, models - votes)::DOUBLE / models, 6) AS agreement FROM g")
def fuse_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.fuse(models(spark, sf_dir), "id").withColumns({c: F.round(c, 6) for c in ("weighted", "soft", "max_conf", "majority", "agreement")})


@query(f"WITH {SCORES}, {MODELS}, c AS (SELECT id, model, (p > 0.5)::INT AS label, round(CASE WHEN p > 0.5 THEN p ELSE 1 - p END, 9) AS conf FROM m), g AS (SELECT id, count(DISTINCT label) AS k, arg_max(label, (conf, model)) AS label, avg(conf) AS mean, max(conf) AS best FROM c GROUP BY id) SELECT id, label, k = 1 AS agreed, round(CASE WHEN k = 1 THEN mean ELSE 0.8 * best END, 6) AS confidence FROM g")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.consensus(models(spark, sf_dir), "id").withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {SCORES}, z AS (SELECT id, 1 / (1 + exp(-ln(greatest(1e-7, least(1 - 1e-7, p)) / (1 - greatest(1e-7, least(1 - 1e-7, p)))) / 2.5::DOUBLE)) AS p FROM scores), r AS (SELECT id, round(p, 6) AS p FROM z) SELECT id, p, p > 0.55 AS is_fake, round(CASE WHEN p > 0.55 THEN p ELSE 1 - p END, 6) AS confidence FROM r")
def decide_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    out = f.decide(s.select("id", f.temperature(F.col("p"), 2.5).alias("p")), 0.55)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("WITH g AS (SELECT user_id, avg(value / (value + 50)) AS mean, var_pop(value / (value + 50)) AS variance FROM events GROUP BY user_id), h AS (SELECT *, -(mean * ln(mean) + (1 - mean) * ln(1 - mean)) AS entropy FROM g) SELECT user_id, round(mean, 6) AS mean, round(variance, 6) AS variance, round(entropy, 6) AS entropy, variance > 0.05 OR entropy > ln(2.0) / 2 AS uncertain FROM h")
def mc_dropout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") / (F.col("value") + 50)).alias("p"))
    return f.dropout_summary(e, "user_id").withColumns({c: F.round(c, 6) for c in ("mean", "variance", "entropy")})


@query("SELECT user_id, round(avg(value / (value + 50)), 6) AS p, count(*) AS windows, avg(value / (value + 50)) > 0.5 AS is_fake FROM events GROUP BY user_id")
def segment_soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") / (F.col("value") + 50)).alias("p"))
    return f.segments(e, "user_id").withColumn("p", F.round("p", 6))


@query(f"WITH {SCORES} SELECT d.doc_id, CASE WHEN s.p IS NULL THEN 'no prediction' END AS error, coalesce(s.p, 0.0) AS p FROM documents d LEFT JOIN scores s ON s.id = d.doc_id")
def batch_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scores(spark, sf_dir).select(F.col("id").alias("doc_id"), "p")
    return f.with_errors(table(spark, sf_dir, "documents").select("doc_id"), p, "doc_id")


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, round(avg(value), 6) AS mean FROM r WHERE rn <= 5 GROUP BY user_id")
def last_n_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("p"))
    return f.last_mean(e, "user_id", ["ts", "event_id"]).withColumn("mean", F.round("mean", 6))


SOFT = "s AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE * 10 - list_max(embedding)::DOUBLE * 10)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s)"


@query(f"WITH {SOFT} SELECT vec_id, round(list_max(p), 6) AS top, round(ln(len(p)) + list_sum(list_transform(p, lambda x: x * ln(x))), 6) AS ood FROM p")
def ood_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(1).alias("batch"), F.transform("embedding", lambda x: x.cast("double") * 10).alias("z"))
    v = f.as_probabilities(v, "z", "batch")
    return v.select("vec_id", F.round(F.array_max("z"), 6).alias("top"), F.round(f.ood_score(F.col("z")), 6).alias("ood"))
