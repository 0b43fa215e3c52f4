"""Queries over preparation, checks, splits' safety, more metrics and the log's writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a
from lumisonde.operators import audit, fusion, splits
from lumisonde.operators import metrics as m
from lumisonde.operators import preparation as prep
from lumisonde.operators import tables as t
from lumisonde.plans.fusion_queries import MODELS, models
from lumisonde.plans.registry import query
from lumisonde.plans.views import HISTORY, SCORES, history, scores
from lumisonde.session import table
from lumisonde.sources import files

# clips with faults: values that are not finite in some, silence in others, labels 0 and 1
CLIPS = """clips AS (SELECT vec_id, label, list_transform(embedding, lambda v, i: CASE WHEN vec_id % 11 = 0 AND i % 5 < 3 THEN 'nan'::DOUBLE WHEN vec_id % 7 = 0 AND i = 3 THEN 'inf'::DOUBLE
  WHEN vec_id % 13 = 0 THEN v::DOUBLE / 100000 ELSE v::DOUBLE END) AS x FROM embeddings)"""


def faulty_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    broken = lambda e, i: F.when((v % 11 == 0) & ((i + 1) % 5 < 3), float("nan")).when((v % 7 == 0) & (i == 2), float("inf")).when(v % 13 == 0, e.cast("double") / 100000).otherwise(e.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", broken).alias("x"))


PREPARED = f"""{CLIPS}, c AS (SELECT vec_id, len(list_filter(x, lambda v: NOT isfinite(v))) / len(x) AS odd, list_transform(x, lambda v: CASE WHEN isfinite(v) THEN v ELSE 0 END) AS x FROM clips),
 s AS (SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v))) AS top, CASE WHEN odd > 0.5 THEN 'non_finite' WHEN len(x) / 16000.0::DOUBLE < 0.001 THEN 'short' WHEN list_max(list_transform(x, lambda v: abs(v))) > 100 THEN 'loud'
 WHEN sqrt(list_avg(list_transform(x, lambda v: v * v))) < 10 ** (-50 / 20.0::DOUBLE) THEN 'silent' ELSE 'ok' END AS state FROM c)"""


@query(f"WITH {PREPARED} SELECT vec_id, state, CASE WHEN state = 'ok' THEN list_transform(x, lambda v: round(v * 0.95::DOUBLE / top, 6)) END AS x FROM s")
def prepare_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prep.prepared(faulty_clips(spark, sf_dir), "x", 16_000, least=0.001, most=30.0, tallest=100.0)
    return out.select("vec_id", "state", F.transform("x", lambda v: a.to_places(v, 6)).alias("x"))


@query(f"WITH {CLIPS} SELECT count(*) AS n, min(len(x)) = max(len(x)) AS one_shape, count_if(len(list_filter(x, lambda v: NOT isfinite(v))) > 0) = 0 AS finite, count_if(label NOT IN (0, 1)) = 0 AS binary, least(count_if(label = 0), count_if(label = 1)) >= 2 AS enough FROM clips")
def dataset_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.invariants(faulty_clips(spark, sf_dir), "x", "label")


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END), ''), nullif(trim(c_name), '')) AS speaker FROM customer")
def first_filled_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("speaker_id", F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", prep.first_filled(["client_id", "speaker_id", "c_name"], c).alias("speaker"))


@query("SELECT CASE WHEN p_type LIKE 'PROMO%' THEN 'promo' WHEN p_type LIKE 'P%' THEN 'p' WHEN p_type LIKE 'S%' THEN 's' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def prefix_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = prep.by_prefix(F.col("p_type"), [("PROMO", "promo"), ("P", "p"), ("S", "s")], "other")
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size BETWEEN 3 AND 48 ORDER BY p_name, p_partkey")
def registry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    least = p.agg(F.min("p_brand").alias("p_brand"))  # one row
    return p.join(F.broadcast(least), "p_brand").where("p_size between 3 and 48").orderBy("p_name", "p_partkey").select("p_partkey", "p_name")


COUNTS = f"{SCORES}, c AS (SELECT source, count_if(y = 0) AS n0, count_if(y = 1) AS n1 FROM scores GROUP BY source)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.contingency(scores(spark, sf_dir), "source", "y")


@query(f"WITH {COUNTS} SELECT source, list_filter([CASE WHEN n0 + n1 < 5 THEN 'too few samples' END, CASE WHEN least(n0, n1) = 0 THEN 'one class only' END], lambda e: e IS NOT NULL) AS errors, list_filter([CASE WHEN n0 + n1 >= 5 AND n0 + n1 < 50 THEN 'fewer samples than recommended' END, CASE WHEN least(n0, n1) > 0 AND greatest(n0, n1) > 2 * least(n0, n1) THEN 'classes differ by more than two to one' END], lambda e: e IS NOT NULL) AS warnings, n0 + n1 >= 5 AND least(n0, n1) > 0 AS valid FROM c")
def minimum_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.requirements(_counts(spark, sf_dir), "n0", "n1", 5, 50).select("source", "errors", "warnings", "valid")


TIERS = [("smoke", 1), ("light", 4), ("medium", 16), ("large", 100)]


@query(f"WITH {COUNTS} SELECT source, tier, CASE WHEN least(n0, n1) >= need THEN 'ready' WHEN 2 * least(n0, n1) >= need THEN 'partial' ELSE 'no' END AS status, CASE WHEN n0 = 0 OR n1 / n0 < 0.5 OR n1 / n0 > 2 THEN 'severe' WHEN n1 / n0 BETWEEN 0.8 AND 1.25 THEN 'ideal' ELSE 'fair' END AS balance FROM c, (VALUES {', '.join(map(str, TIERS))}) AS v(tier, need)")
def training_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.readiness(_counts(spark, sf_dir), "n0", "n1", spark.createDataFrame(TIERS, "tier string, need long")).select("source", "tier", "status", "balance")


@query("SELECT event_id, value / 100 AS seconds, CASE WHEN value / 100 < 0.3 THEN 'shorter than 0.3 s' END AS error FROM events")
def minimum_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", seconds.alias("seconds"), F.when(seconds < 0.3, "shorter than 0.3 s").alias("error"))


@query("WITH a AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents SEMI JOIN labels USING (doc_id) WHERE doc_id % 3 = 0), b AS (SELECT source, toxic, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 = 1) SELECT source, a.k AS place, n_chars, toxic FROM a JOIN b USING (source, k, n)")
def scores_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sequences of a source put together by place; sources whose sequences differ in length go."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    one = d.join(labels, "doc_id", "left_semi").where("doc_id % 3 = 0")
    two = d.join(labels, "doc_id").where("doc_id % 3 = 1").select("source", "doc_id", "toxic")
    return prep.zipped(one, two, ["source"], ["doc_id"]).select("source", "place", "n_chars", "toxic")


@query("WITH a AS (SELECT source, count(*) AS left_rows FROM documents WHERE doc_id % 2 = 0 GROUP BY source), b AS (SELECT source, count(*) AS right_rows FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 > 0 GROUP BY source) SELECT source, coalesce(left_rows, 0) AS left_rows, coalesce(right_rows, 0) AS right_rows FROM a FULL JOIN b USING (source) WHERE left_rows IS DISTINCT FROM right_rows")
def lengths_that_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return prep.unequal(d.where("doc_id % 2 = 0"), d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").where("doc_id % 3 > 0"), ["source"])


CODES = {"de": 3, "en": 1, "es": 4, "fr": 2}


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS code FROM documents")
def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.encoded(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", CODES).select("doc_id", "code")


@query("WITH p AS (SELECT user_id AS id, [round(avg(value), 6), round(max(value), 6)] AS f FROM events WHERE event_type = 'purchase' GROUP BY 1), c AS (SELECT user_id AS id, [count(*)::DOUBLE] AS f FROM events WHERE event_type = 'click' GROUP BY 1), k AS (SELECT c_custkey AS id, [c_acctbal] AS f FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(p.id, c.id, k.id) AS id, list_concat(list_concat(coalesce(p.f, []), coalesce(c.f, [])), coalesce(k.f, [])) AS features FROM p FULL JOIN c ON p.id = c.id FULL JOIN k ON k.id = coalesce(p.id, c.id)")
def feature_types_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "id")
    bought = e.where("event_type = 'purchase'").groupBy("id").agg(F.array(F.round(F.avg("value"), 6), F.round(F.max("value"), 6)).alias("features"))
    clicks = e.where("event_type = 'click'").groupBy("id").agg(F.array(F.count(F.lit(1)).cast("double")).alias("features"))
    money = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.array("c_acctbal").alias("features"))
    return prep.together([("bought", bought), ("clicks", clicks), ("money", money)], "id")


GROUPS = [("promo", "PROMO"), ("promo", "SMALL"), ("plated", "SMALL"), ("plated", "STANDARD")]


@query(f"WITH g(grp, feature) AS (VALUES {', '.join(map(str, GROUPS))}), o AS (SELECT feature, arg_min(grp, i) AS grp FROM (SELECT *, row_number() OVER () AS i FROM g) GROUP BY feature), s AS (SELECT coalesce(grp, 'Outros') AS grp, sum(p_retailprice) AS v FROM (SELECT split_part(p_type, ' ', 1) AS feature, p_retailprice FROM part) LEFT JOIN o USING (feature) GROUP BY 1) SELECT grp, round(v, 2) AS total, round(v / sum(v) OVER (), 6) AS share FROM s")
def importance_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    first: dict[str, str] = {}
    for group, feature in GROUPS:
        first.setdefault(feature, group)
    owner = spark.createDataFrame([(f, g) for f, g in first.items()], "feature string, grp string")
    parts = table(spark, sf_dir, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("feature"), "p_retailprice")
    out = t.lookup(parts, owner, "feature", {"grp": F.lit("Outros")}).groupBy("grp").agg(F.sum("p_retailprice").alias("v"))
    whole = out.agg(F.sum("v").alias("whole"))  # one row
    return out.join(F.broadcast(whole), F.lit(True)).select("grp", F.round("v", 2).alias("total"), F.round(F.col("v") / F.col("whole"), 6).alias("share"))


SEG = "s AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS q, l_discount AS d FROM lineitem)"


@query(f"WITH {SEG}, a AS (SELECT k, [coalesce(avg(q), 0), avg(d)] AS mean, [coalesce(median(q), 0), median(d)] AS median, [coalesce(stddev_samp(q), 0), coalesce(stddev_samp(d), 0)] AS std, [coalesce(min(q), 0), min(d), coalesce(max(q), 0), max(d)] AS ends FROM s GROUP BY k) SELECT k AS l_orderkey, list_transform(mean, lambda v: round(v, 6)) AS mean, list_transform(median, lambda v: round(v, 6)) AS median, list_transform(std, lambda v: round(v, 6)) AS std, list_transform(list_concat(list_concat(mean, std), ends), lambda v: round(v, 6)) AS all FROM a")
def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", quantity.alias("q"), "l_discount", F.lit(float("nan")).alias("none"))
    out = prep.segment_features(rows, "l_orderkey", ["q", "none", "l_discount"])
    return out.select("l_orderkey", *[F.transform(c, lambda v: F.round(v, 6)).alias(c) for c in ("mean", "median", "std", "all")])


@query("SELECT count(*) AS segments, round(sum(value), 3) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS sources FROM events")
def segment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("user_id").alias("sources"))


@query("WITH p AS (SELECT lang, quality, CASE WHEN n_chars % 3 = 0 THEN 0 WHEN n_chars % 3 = 1 THEN 1 END AS told FROM documents JOIN labels USING (doc_id)) SELECT lang, count(told) AS told, round(avg((quality <> told)::INT), 6) AS mismatch, avg((quality <> told)::INT) > 0.01 AS warn FROM p GROUP BY lang")
def label_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against what the folders of paths say; a path that says nothing does not count."""
    folder = F.when(F.col("n_chars") % 3 == 0, "real").when(F.col("n_chars") % 3 == 1, "fake").otherwise("other")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws("/", F.lit("/data"), folder, F.concat("doc_id", F.lit(".wav"))).alias("path"))
    out = prep.label_mismatch(d.join(table(spark, sf_dir, "labels"), "doc_id"), ["lang"], "path", "quality")
    return out.withColumn("mismatch", F.round("mismatch", 6))


@query(f"WITH {SCORES}, {MODELS}, c AS (SELECT id, model, (p > 0.5)::INT AS label, round(CASE WHEN p > 0.5 THEN p ELSE 1 - p END, 9) AS conf FROM m), g AS (SELECT id, count(DISTINCT label) AS k, arg_max(label, (conf, model)) AS label, avg(conf) AS mean, max(conf) AS best FROM c GROUP BY id), o AS (SELECT id, label, k = 1 AS agreed, CASE WHEN k = 1 THEN mean ELSE 0.8 * best END AS confidence FROM g) SELECT s.source, count(*) AS total, count_if(label = 1) AS fakes, round(count_if(label = 1) / count(*), 6) AS ratio, round(avg(agreed::INT), 6) AS agreement, round(avg(confidence) FILTER (label = 1), 5) AS fake_confidence, round(avg(confidence) FILTER (label = 0), 5) AS real_confidence, count_if(confidence >= 0.7) AS sure FROM o JOIN scores s USING (id) GROUP BY s.source")
def consensus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the consensus of several models, by source."""
    each = fusion.consensus(models(spark, sf_dir), "id").join(scores(spark, sf_dir).select("id", "source"), "id")
    c, fake = F.col("confidence"), F.col("label") == 1
    return each.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(fake).alias("fakes"), F.round(F.count_if(fake) / F.count(F.lit(1)), 6).alias("ratio"), F.round(F.avg(F.col("agreed").cast("int")), 6).alias("agreement"),
        F.round(F.avg(F.when(fake, c)), 5).alias("fake_confidence"), F.round(F.avg(F.when(~fake, c)), 5).alias("real_confidence"), F.count_if(c >= 0.7).alias("sure"),
    )


@query(f"WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY created_at DESC, id DESC) AS k FROM history) SELECT filename, count(*) AS n, count_if(is_fake) AS fakes, round(count_if(is_fake) / count(*), 6) AS ratio, round(avg(confidence) FILTER (k <= 5), 6) AS last FROM r GROUP BY filename")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumisonde.operators.ranks import ranked

    h = ranked(history(spark, sf_dir).select("filename", "is_fake", "confidence", "created_at", "id"), ["filename"], ["created_at", "id"])
    last = F.avg(F.when(F.col("rn") > F.col("n") - 5, F.col("confidence")))
    return h.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_fake").alias("fakes"), F.round(F.count_if("is_fake") / F.count(F.lit(1)), 6).alias("ratio"), F.round(last, 6).alias("last"))


@query("WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, round(avg(n_chars) FILTER (rn <= 150) * max(n) / 3600, 6) AS hours FROM r GROUP BY source")
def extrapolated_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prep.hours(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")
    return out.withColumn("hours", F.round("hours", 6))


@query("SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END::INT AS place FROM customer")
def explicit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = prep.in_order(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"])
    return table(spark, sf_dir, "customer").orderBy(*keys, "c_custkey").select("c_custkey", "c_mktsegment", keys[0].cast("int").alias("place"))


@query("WITH s AS (SELECT coalesce(text, '') AS text, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM documents), d AS (SELECT text, list_sort(list_distinct(list(split))) AS s, count(*) AS n FROM s GROUP BY text), p AS (SELECT n, a, b FROM d, (VALUES ('test', 'train'), ('test', 'val'), ('train', 'val')) AS v(a, b) WHERE list_contains(s, a) AND list_contains(s, b)) SELECT a, b, count(*) AS contents, sum(n)::BIGINT AS rows FROM p GROUP BY a, b")
def leaks_between_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("doc_id") % 10
    d = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"), F.when(r < 7, "train").when(r < 8, "val").otherwise("test").alias("split"))
    return prep.leaks(d, "split", F.col("text"))


@query("WITH a AS (SELECT avg(l_quantity) FILTER (l_orderkey % 5 > 0) AS t, avg(l_quantity) AS w, avg(l_tax) FILTER (l_orderkey % 5 > 0) AS t2, avg(l_tax) AS w2 FROM lineitem) SELECT \"column\", round(t, 6) AS train, round(w, 6) AS whole, abs(t - w) <= 0.01::DOUBLE * abs(t) AS near FROM (SELECT 'l_quantity' AS \"column\", t, w FROM a UNION ALL SELECT 'l_tax', t2, w2 FROM a)")
def scaler_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prep.scaler_fits(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], F.col("l_orderkey") % 5 > 0)
    return out.withColumns({c: F.round(c, 6) for c in ("train", "whole")})


@query(f"WITH {SCORES}, m AS (SELECT *, lower(source) = 'src1' AS own FROM scores), n AS (SELECT greatest(1, count_if(own)) AS n FROM m), r AS (SELECT id, y, own, CASE WHEN NOT own AND y = 0 THEN row_number() OVER (PARTITION BY NOT own AND y = 0 ORDER BY id) END AS rn FROM m), t AS (SELECT id, y, own OR coalesce(rn <= n, false) AS test FROM r, n), f AS (SELECT *, row_number() OVER (PARTITION BY test, y ORDER BY id) AS k FROM t) SELECT id, y, CASE WHEN test THEN 'test' WHEN (k - 1) % 6 = 0 THEN 'val' ELSE 'train' END AS split, 'holdout_speaker' AS mode FROM f")
def split_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A speaker held out goes before a generator held out and before groups."""
    s = scores(spark, sf_dir).select("id", "y", "source", "lang")
    return splits.by_mode(s, "y", ["id"], group="source", speaker="source", generator="lang", hold_speaker="SRC1", hold_generator="en").select("id", "y", "split", "mode")


@query(f"WITH {SCORES}, r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM scores) SELECT id, y, CASE WHEN rn <= floor(n * 0.15::DOUBLE) THEN 'test' WHEN rn <= floor(n * 0.15::DOUBLE) * 2 THEN 'val' ELSE 'train' END AS split, 'stratified' AS mode FROM r")
def split_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of one label each are too few to split by: rows are shared out by label."""
    s = scores(spark, sf_dir).select("id", "y", F.concat(F.lit("g"), "y").alias("g"))
    return splits.by_mode(s, "y", ["id"], group="g").select("id", "y", "split", "mode")


@query()
def grouped_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources on one side each, with labels in like shares."""
    s = scores(spark, sf_dir).select("id", "y", "source")
    return splits.by_mode(s, "y", ["id"], group="source").select("id", "y", "source", "split", "mode")


@query()
def shortcut_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the parity of an embedding's label shows in trivial features of it; groups of ten neighbours stay together."""
    clips = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("y"), F.floor(F.col("vec_id") / 10).alias("g"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    rows = clips.select("y", "g", *[c.alias(n) for n, c in audit.features(F.col("x")).items()])
    out = audit.shortcuts(rows, "y", "g")
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "drop")})


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda u: u::DOUBLE) AS x FROM embeddings), s AS (SELECT vec_id, list_sum(list_transform(x, lambda u: u * u)) / 64 AS e, list_sum(x) / 64 AS m, list_max(list_transform(x, lambda u: abs(u))) AS p, x FROM v) SELECT vec_id, round(sqrt(e), 6) AS rms, round(m, 6) AS offset, round(list_sum(list_transform(x, lambda u: abs(u))) / 64, 6) AS abs_mean, round(list_stddev_pop(x), 6) AS std, round(p, 6) AS largest, round(p / sqrt(e), 6) AS crest, round(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN (x[i] < 0) <> (x[i + 1] < 0) THEN 1 ELSE 0 END)) / 63, 6) AS zero_crossings, round(len(list_filter(x, lambda u: abs(u) < 1e-3)) / 64, 6) AS silent_share, round(len(list_filter(x, lambda u: abs(u) >= 0.99)) / 64, 6) AS clipped_share, round(e * 64, 6) AS energy, 64.0::DOUBLE AS length, round(list_sum(list_transform(range(1, 64), lambda i: abs(x[i + 1] - x[i]))) / 63, 6) AS first_difference FROM s")
def shortcut_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for n, c in audit.features(x).items()])


@query("WITH e AS (SELECT vec_id, CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM embeddings) SELECT vec_id, split AS origin, NULL::DOUBLE AS snr FROM e WHERE split <> 'test' UNION ALL SELECT vec_id, 'noisy', s::DOUBLE FROM e, (VALUES (30), (20), (10)) AS v(s) WHERE split <> 'test'")
def fit_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation rows, and a noisy copy of each for each ratio."""
    k = F.col("vec_id") % 10
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.when(k < 7, "train").when(k < 8, "val").otherwise("test").alias("split"))
    return prep.fit_set(e, "split", "vec_id", "x", [30, 20, 10]).select("vec_id", "origin", "snr")


@query()
def noisy_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio that each copy has; the noise comes from a hash that SQL lacks, so tests hold its distribution."""
    clean = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    noisy = prep.with_noise(clean.withColumn("clean", F.col("x")), "vec_id", "x", [30, 20, 10])
    noise = a.energy(F.zip_with("x", "clean", lambda p, q: p - q))
    return noisy.select("vec_id", "snr", F.round(10 * F.log10(a.energy(F.col("clean")) / noise), 6).alias("measured"))


EERS = f"""WITH {SCORES}, c AS (SELECT lang, p, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scores GROUP BY ALL),
 w AS (SELECT lang, p, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY lang) AS np, sum(neg) OVER (PARTITION BY lang) AS nn FROM c WINDOW d AS (PARTITION BY lang ORDER BY p DESC)),
 r AS (SELECT lang, p, tp / np AS tpr, fp / nn AS fpr FROM w WHERE np > 0 AND nn > 0 UNION ALL SELECT DISTINCT lang, 2.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM w WHERE np > 0 AND nn > 0),
 g AS (SELECT lang, p, fpr, 1 - fpr - tpr AS gap, lag(fpr) OVER o AS f0, lag(1 - fpr - tpr) OVER o AS g0 FROM r WINDOW o AS (PARTITION BY lang ORDER BY p DESC))
 SELECT lang, round(arg_max(f0 + CASE WHEN g0 = gap THEN 0 ELSE g0 / (g0 - gap) END * (fpr - f0), p), 6) AS eer FROM g WHERE g0 >= 0 AND gap <= 0 GROUP BY lang"""


@query(EERS)
def eer_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.eer_by_interpolation(scores(spark, sf_dir), ["lang"]).select("lang", F.round("eer", 6).alias("eer"))


MANY = "v AS (SELECT vec_id AS id, label % 3 AS label, cls, round(embedding[cls + 1]::DOUBLE, 1) AS p FROM embeddings, range(3) c(cls))"
PAIRS = "pos.p > neg.p THEN 1 WHEN pos.p = neg.p THEN 0.5 ELSE 0 END"


@query(f"WITH {MANY}, r AS (SELECT pos.cls, avg(CASE WHEN {PAIRS}) AS auc, count(DISTINCT pos.id) AS np FROM v pos JOIN v neg ON pos.cls = neg.cls AND pos.label = pos.cls AND neg.label <> neg.cls GROUP BY 1), o AS (SELECT pos.label AS a, neg.label AS b, avg(CASE WHEN {PAIRS}) AS auc, count(DISTINCT pos.id) + count(DISTINCT neg.id) AS n FROM v pos JOIN v neg ON pos.cls = neg.cls AND pos.label = pos.cls AND neg.label <> neg.cls GROUP BY 1, 2) SELECT round((SELECT sum(auc * np) / sum(np) FROM r), 6) AS ovr, round((SELECT sum(auc * n) / sum(n) FROM o), 6) AS ovo")
def auc_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("label"), F.posexplode(F.slice("embedding", 1, 3)).alias("cls", "p"))
    out = m.multiclass_auc(v.withColumn("p", F.round(F.col("p").cast("double"), 1)), [])
    return out.select(F.round("ovr", 6).alias("ovr"), F.round("ovo", 6).alias("ovo"))


@query(f"WITH {SCORES}, f AS (SELECT *, id % 5 AS fold FROM scores), c AS (SELECT fold, avg(((p >= 0.5)::INT = y)::INT) AS accuracy, count_if(y = 1 AND p >= 0.5) AS tp, count_if(y = 0 AND p >= 0.5) AS fp, count_if(y = 1 AND p < 0.5) AS fn FROM f GROUP BY fold), u AS (SELECT fold, avg(CASE WHEN {PAIRS}) AS auc FROM f pos JOIN f neg USING (fold) WHERE pos.y = 1 AND neg.y = 0 GROUP BY fold) SELECT fold, round(accuracy, 6) AS accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(auc, 0), 6) AS auc FROM c LEFT JOIN u USING (fold)")
def metrics_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.fold_metrics(scores(spark, sf_dir).withColumn("fold", F.col("id") % 5), ["fold"])
    return out.select("fold", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "auc")])


# -- the log's reads and writes -----------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='lumisonde-')}/log-{uuid.uuid4().hex}"


@query(f"WITH {HISTORY} SELECT w.id, h.filename, h.id IS NOT NULL AS found FROM (VALUES (1::BIGINT), (7), (999999999)) AS w(id) LEFT JOIN history h ON h.id = w.id")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.by_id(history(spark, sf_dir).select("id", "filename"), [1, 7, 999999999])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sorted_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query(f"WITH {HISTORY} SELECT id, filename, model_name FROM history WHERE model_name IN ('click', 'purchase')")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, path = history(spark, sf_dir).select("id", "filename", "model_name"), _folder(spark)
    for name in ("click", "purchase"):
        files.append(h.where(F.col("model_name") == name), path)
    return spark.read.schema(h.schema).parquet(path)


@query(f"WITH {HISTORY} SELECT id, filename, model_name FROM history WHERE model_name = 'purchase'")
def all_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows go, then others come: only these are read."""
    h, path = history(spark, sf_dir).select("id", "filename", "model_name"), _folder(spark)
    files.append(h, path)
    files.delete_all(spark, path)
    files.append(h.where("model_name = 'purchase'"), path)
    return spark.read.schema(h.schema).parquet(path)


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'seeded'")
def seeded_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    one = spark.createDataFrame([(99, "seeded")], region.schema)
    return files.seeded(region, one).unionByName(files.seeded(region.where("false"), one))


@query(f"WITH {HISTORY} SELECT id, filename, is_fake, round(confidence, 6) AS confidence, created_at FROM history")
def exported_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, path = history(spark, sf_dir).select("id", "filename", "is_fake", F.round("confidence", 6).alias("confidence"), "created_at"), _folder(spark)
    files.export_csv(h, path, [F.desc("created_at"), F.col("id")])
    return spark.read.schema(h.schema).csv(path, header=True)


# -- shapes and formats ---------------------------------------------------------------------------


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings), z AS (SELECT vec_id, x, list_avg(x) AS mu, greatest(list_stddev_pop(x), 1e-6) AS sd FROM v) SELECT vec_id, list_transform(x, lambda v: round((v - mu) / sd, 6)) AS z, list_transform(list_concat(x, list_transform(range(6), lambda i: x[64])), lambda v: round(v, 6)) AS edge, list_transform(list_concat(x[1:(vec_id % 64 + 1)::INT], list_transform(range((63 - vec_id % 64)::INT), lambda i: 0.0::DOUBLE)), lambda v: round(v, 6)) AS aligned FROM z")
def array_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    ragged = x.withColumn("r", F.slice("x", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")))
    out = a.aligned(ragged, "r").select("vec_id", a.standardized(F.col("x")).alias("z"), a.edge_fit(F.col("x"), 70).alias("edge"), F.col("r").alias("aligned"))
    return out.select("vec_id", *[F.transform(c, lambda v: a.to_places(v, 6)).alias(c) for c in ("z", "edge", "aligned")])


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings), p AS (SELECT vec_id, i, list_concat(x[i * 8 + 1:i * 8 + 16], list_transform(range(16 - len(x[i * 8 + 1:i * 8 + 16])), lambda k: 0.0::DOUBLE)) AS w FROM v, range(8) t(i)) SELECT vec_id, i::INT AS segment, list_transform(w, lambda v: round(v, 6)) AS w FROM p")
def padded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    s = x.select("vec_id", F.posexplode(a.segments(F.col("x"), 16, 8, pad=True)).alias("segment", "w"))
    return s.withColumn("w", F.transform("w", lambda v: a.to_places(v, 6)))


@query("SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS money, translate(format('{:.1f}', o_totalprice / 10000), '.', ',') || '%' AS share, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strptime(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') = date_trunc('second', o_orderdate) AS back FROM orders")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, at = F.col("o_totalprice"), F.col("o_orderdate").cast("timestamp")
    iso = a.iso_time(at)
    return table(spark, sf_dir, "orders").select("o_orderkey", a.decimal_comma(F.format_number(price, 2)).alias("money"), F.concat(a.decimal_comma(a.fixed(price / 10000, 1)), F.lit("%")).alias("share"), iso.alias("iso"), (F.to_timestamp(iso) == F.date_trunc("second", at)).alias("back"))


@query("SELECT event_id, json_object('value', CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END IS NULL, 'kind', event_type) AS plain, event_type || '.' || (props->>'k') AS flat FROM events")
def plain_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value"))
    k = F.from_json("props", "k string")["k"]
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(a.finite_or_null(value).isNull().alias("value"), F.col("event_type").alias("kind")).alias("s"), k.alias("k"))
    return rows.select("event_id", F.to_json("s").alias("plain"), F.concat_ws(".", "s.kind", "k").alias("flat"))
