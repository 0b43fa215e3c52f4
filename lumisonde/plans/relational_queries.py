"""Queries over logs, lookups, balancing, audits and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisonde.operators import tables as t
from lumisonde.plans.registry import query
from lumisonde.plans.views import HISTORY, SCORES, history, scores
from lumisonde.session import table

KEY = "(id * 2654435761) % 4294967296"


def key(c: str = "id"):
    """A portable order that looks random: multiplication by a large odd number, modulo 2 to the 32."""
    return (F.col(c) * F.lit(2654435761)) % F.lit(4294967296)


@query("SELECT event_type AS model_name, count(event_id) AS n FROM events GROUP BY 1")
def history_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).groupBy("model_name").agg(F.count("id").alias("n"))


@query(f"WITH {HISTORY} SELECT id, filename, is_fake, round(confidence, 6) AS confidence, model_name, created_at FROM history ORDER BY created_at DESC, id LIMIT 50 OFFSET 20")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.page(history(spark, sf_dir), 50, 20).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {HISTORY} SELECT id, filename, model_name, created_at FROM history WHERE model_name = 'click' AND is_fake AND filename ILIKE '%CLIP_1%' ORDER BY created_at DESC, id LIMIT 500")
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.search(history(spark, sf_dir), "click", True, "CLIP_1").select("id", "filename", "model_name", "created_at")


@query(f"WITH {HISTORY} SELECT id, filename, CASE WHEN is_fake THEN 'FAKE' ELSE 'REAL' END AS verdict, format('{{:.1f}}%', confidence * 100) AS confidence, model_name FROM history")
def history_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.display(history(spark, sf_dir))


@query("SELECT choice, (row_number() OVER (ORDER BY choice))::INT AS ord FROM (SELECT DISTINCT event_type AS choice FROM events WHERE event_type <> '') UNION ALL SELECT 'All', 0")
def history_distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.choices(history(spark, sf_dir), "model_name", "All")


@query("SELECT count(*) AS n, count_if(value > 50) AS fakes FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def recent_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    now = h.agg(F.max("created_at").alias("now"))
    return t.recent(h.join(F.broadcast(now), F.lit(True)), F.col("now")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_fake").alias("fakes"))


@query("WITH n AS (SELECT event_id, date_diff('second', ts, max(ts) OVER ()) AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'min') WHEN s < 86400 THEN concat(s // 3600, 'h') ELSE concat(s // 86400, 'd') END AS age FROM n")
def history_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now), F.lit(True)).select("event_id", t.age(F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))).alias("age"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    return t.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.without(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 11")
def either_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_name = 'Customer#000000007' OR c_custkey = 11").select("c_custkey", "c_name")


@query("WITH k AS (SELECT p_brand, CASE WHEN rank() OVER (PARTITION BY p_brand ORDER BY p_size) = 1 THEN 'default' ELSE p_type END AS p_type, max(p_size) AS p_size FROM (SELECT p_brand, p_type, max(p_size) AS p_size FROM part GROUP BY ALL) GROUP BY p_brand, p_type, p_size), d AS (SELECT p_brand, p_type, max(p_size) AS p_size FROM k GROUP BY ALL), w AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT w.p_brand, w.p_type, coalesce(o.p_size, b.p_size) AS p_size FROM w LEFT JOIN d o ON o.p_brand = w.p_brand AND o.p_type = w.p_type LEFT JOIN d b ON b.p_brand = w.p_brand AND b.p_type = 'default'")
def default_variant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").alias("p_size"))
    first = F.rank().over(Window.partitionBy("p_brand").orderBy("p_size")) == 1
    known = p.withColumn("p_type", F.when(first, "default").otherwise(F.col("p_type"))).groupBy("p_brand", "p_type").agg(F.max("p_size").alias("p_size"))
    return t.variant(p.select("p_brand", "p_type"), known, "p_brand", "p_type", "p_size")


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def exact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return t.first_copies(d, F.col("text"), ["doc_id"]).select("digest", "doc_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE concat(d.source, ':', l.toxic) END AS speaker_key, CASE WHEN l.doc_id IS NULL THEN 'fallback_source' ELSE 'real_id' END AS id_status FROM documents d LEFT JOIN labels l USING (doc_id)")
def speaker_key_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("speaker"))
    j = d.join(m, "doc_id", "left")
    known = F.col("speaker").isNotNull()
    return j.select("doc_id", F.when(known, F.concat_ws(":", "source", "speaker")).otherwise(F.col("source")).alias("speaker_key"), F.when(known, "real_id").otherwise("fallback_source").alias("id_status"))


@query("SELECT s.s_suppkey, coalesce(n.n_name, 'Outros') AS dataset FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n.n_nationkey = s.s_nationkey")
def catalog_default_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dataset"))
    return t.lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), n, "s_nationkey", {"dataset": F.lit("Outros")}).select("s_suppkey", "dataset")


@query(f"WITH {SCORES}, g AS (SELECT source FROM scores GROUP BY source HAVING count_if(y = 0) = 0 OR count_if(y = 1) = 0) SELECT id, source FROM scores WHERE source IN (SELECT source FROM g)")
def pure_source_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.pure_rows(scores(spark, sf_dir), "source", "y").select("id", "source")


@query(f"WITH {SCORES}, g AS (SELECT source FROM scores GROUP BY source HAVING count_if(y = 0) = 0 OR count_if(y = 1) = 0) SELECT round(avg(CASE WHEN g.source IS NULL THEN 0.0 ELSE 1.0 END), 6) AS trivial FROM scores LEFT JOIN g USING (source)")
def trivially_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    c = t.contingency(s, "source", "y")
    pure = (F.col("n0") == 0) | (F.col("n1") == 0)
    return c.agg(F.round(F.sum(F.when(pure, F.col("n0") + F.col("n1")).otherwise(0)) / F.sum(F.col("n0") + F.col("n1")), 6).alias("trivial"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.without(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("WITH o AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS block FROM (SELECT DISTINCT event_type FROM events)) SELECT e.event_id, o.event_type AS owner FROM events e LEFT JOIN o ON o.block = e.event_id // 1500")
def block_bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return t.blocks(e.select("event_id"), "event_id", 1500, e.select(F.col("event_type").alias("owner")), "owner").select("event_id", "owner")


@query("SELECT d.doc_id, c.code::INT AS code FROM documents d JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents)) c USING (lang)")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.encode(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").select("doc_id", "code")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 're') THEN 0.9 WHEN contains(lower(p_name), 'la') THEN 0.8 WHEN contains(lower(p_name), 'o') THEN 0.7 ELSE 0.6 END::DOUBLE AS weight FROM part")
def substring_prior_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.first_match(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", [("re", 0.9), ("la", 0.8), ("o", 0.7)]).select("p_partkey", "weight")


@query(f"WITH {SCORES} SELECT source, count_if(y = 0) AS n0, count_if(y = 1) AS n1 FROM scores GROUP BY source")
def source_class_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.contingency(scores(spark, sf_dir), "source", "y")


COVER = "SELECT {g}, count(*) AS files, count(l.toxic) AS identified, count(DISTINCT l.toxic) AS keys, round(count(l.toxic)::DOUBLE / count(*), 6) AS ratio FROM documents d LEFT JOIN labels l USING (doc_id) {by}"


@query(COVER.format(g="source", by="GROUP BY ROLLUP (source)"))
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return t.coverage(j, "source", "toxic")


@query("WITH d AS (SELECT *, regexp_extract(source, '^[a-z]+', 0) AS prefix FROM documents) SELECT prefix, count(*) AS files, count(l.doc_id) AS identified, count(*) - count(l.doc_id) AS missing, count(DISTINCT source) AS speakers FROM d LEFT JOIN labels l USING (doc_id) GROUP BY prefix")
def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("prefix", F.regexp_extract("source", "^[a-z]+", 0))
    j = d.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return j.groupBy("prefix").agg(F.count(F.lit(1)).alias("files"), F.count("l").alias("identified"), F.count_if(F.col("l").isNull()).alias("missing"), F.count_distinct("source").alias("speakers"))


@query("WITH s AS (SELECT source, CASE WHEN doc_id % 10 < 7 THEN 1 WHEN doc_id % 10 < 8 THEN 2 ELSE 4 END AS b FROM documents), m AS (SELECT source, bit_or(b) AS m FROM s GROUP BY source) SELECT count_if(m & 5 = 5) AS train_and_test, count_if(m = 4) AS test_only, count_if(m & 6 = 6) AS val_and_test, count(*) AS groups FROM m")
def split_overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("doc_id") % 10
    d = table(spark, sf_dir, "documents").select("source", F.when(r < 7, "train").when(r < 8, "val").otherwise("test").alias("split"))
    return t.overlap(d, "split", "source")


RUNS = "runs AS (SELECT event_type AS model, user_id AS run, round(avg(value) / 100, 2) AS auc FROM events GROUP BY ALL)"


@query(f"WITH {RUNS} SELECT model, run, auc FROM runs QUALIFY row_number() OVER (PARTITION BY model ORDER BY auc DESC, run DESC) = 1")
def best_run_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("run")).agg(F.round(F.avg("value") / 100, 2).alias("auc"))
    return t.best_run(r, "model", "auc", "run")


EPOCHS = "e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS loss, value / (value + 10) AS accuracy FROM events)"


@query(f"WITH {EPOCHS} SELECT run, arg_min(epoch, (loss, epoch)) AS best_epoch, round(max(accuracy), 6) AS peak, round(arg_max(accuracy, epoch), 6) AS final, round(max(accuracy) - arg_max(accuracy, epoch), 6) AS drop FROM e GROUP BY run")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.select(F.col("user_id").alias("run"), n.alias("epoch"), F.col("value").alias("loss"), (F.col("value") / (F.col("value") + 10)).alias("accuracy"))
    return t.best_epoch(e, "run").withColumns({c: F.round(c, 6) for c in ("peak", "final", "drop")}).withColumn("best_epoch", F.col("best_epoch").cast("long"))


FOLDS = "f AS (SELECT event_type AS model, dayofyear(ts) AS fold, avg(value) / 100 AS accuracy FROM events GROUP BY ALL)"


@query(f"WITH {FOLDS} SELECT model, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std, round(min(accuracy), 6) AS least, round(max(accuracy), 6) AS most, round(regr_slope(accuracy, fold), 6) AS slope, round(greatest(0, 1 - stddev_pop(accuracy) / avg(accuracy)), 6) AS stability, regr_slope(accuracy, fold) < -0.01 AS degrading, round(max(accuracy) - min(accuracy), 6) AS drop FROM f GROUP BY model")
def fold_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), F.dayofyear("ts").alias("fold")).agg((F.avg("value") / 100).alias("accuracy"))
    return t.stability(f, "model", "accuracy", "fold").withColumns({c: F.round(c, 6) for c in ("mean", "std", "least", "most", "slope", "stability", "drop")})


@query("SELECT event_type AS model, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(1000 / avg(value), 6) AS per_second FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.latency(table(spark, sf_dir, "events").withColumnRenamed("event_type", "model"), "model", "value").withColumns({c: F.round(c, 6) for c in ("mean", "std", "p50", "p95", "per_second")})


@query("SELECT quality, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY quality")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.class_weights(table(spark, sf_dir, "labels"), "quality").withColumn("weight", F.round("weight", 6))


@query("WITH g AS (SELECT source, CASE WHEN source LIKE '%1%' THEN 'both' ELSE 'real' END AS kind, count(*) AS have FROM documents GROUP BY source), s AS (SELECT *, greatest(0, 5000000 - sum(have) OVER ()) AS gap, count(*) OVER () AS n FROM g) SELECT source, CASE WHEN gap = 0 THEN 0 ELSE greatest(1, gap // n) * CASE WHEN kind = 'both' THEN 2 ELSE 1 END END::BIGINT AS plan FROM s")
def gap_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("have")).withColumn("kind", F.when(F.contains("source", F.lit("1")), "both").otherwise("real"))
    return t.gap_plan(g, "source", "have", 5_000_000).select("source", F.col("plan").cast("long").alias("plan"))


@query("SELECT count(*) AS total, count_if(value > 50) AS fakes, round(100.0 * count_if(value > 50) / count(*), 6) AS fake_percent, round(avg(value / (value + 50)), 6) AS mean, round(stddev_pop(value / (value + 50)), 6) AS std, count_if(value / (value + 50) > 0.9) AS sure, count_if(value / (value + 50) < 0.6) AS unsure FROM events")
def forensic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    c = F.col("confidence")
    n = F.count(F.lit(1))
    return h.agg(n.alias("total"), F.count_if("is_fake").alias("fakes"), F.round(100 * F.count_if("is_fake") / n, 6).alias("fake_percent"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), F.count_if(c > 0.9).alias("sure"), F.count_if(c < 0.6).alias("unsure"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) ORDER BY rn, source LIMIT 333")
def round_robin_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 333).select("doc_id", "source")


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY y, source ORDER BY id) AS turn FROM scores), o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY turn, source) AS place FROM r), q AS (SELECT least(min(c), 100000) AS q, count(*) AS k FROM (SELECT count(*) AS c FROM scores GROUP BY y)) SELECT id, y, k > 1 AND place <= q AS kept FROM o, q")
def balanced_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.balanced(scores(spark, sf_dir), "y", "source", "id", 100_000).select("id", "y", "kept")


@query(f"WITH {SCORES} SELECT id, y FROM scores QUALIFY row_number() OVER (PARTITION BY y ORDER BY {KEY}, id) <= 40")
def balanced_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.subsample(scores(spark, sf_dir).select("id", "y"), "y", [key(), F.col("id")], 40)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey, r_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def multi_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, n, r = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("n_regionkey", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
