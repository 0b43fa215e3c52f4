"""Queries over splits, folds and ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisonde.operators import splits as s
from lumisonde.operators.ranks import cuts_of, ordered, percentiles, ranked
from lumisonde.plans.registry import query
from lumisonde.plans.relational_queries import KEY, key
from lumisonde.plans.views import SCORES, scores
from lumisonde.session import table


def _order():
    return [key(), F.col("id")]


R = f"r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {KEY}, id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM scores)"


@query(f"WITH {SCORES}, {R} SELECT id, y, CASE WHEN rn <= floor(n * 0.15::DOUBLE) THEN 'test' WHEN rn <= floor(n * 0.15::DOUBLE) * 2 THEN 'val' ELSE 'train' END AS split FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.stratified(scores(spark, sf_dir).select("id", "y"), "y", _order())


@query(f"WITH {SCORES}, {R} SELECT id, y, ((rn - 1) % 5)::INT AS fold FROM r")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.folds(scores(spark, sf_dir).select("id", "y"), "y", _order(), 5)


@query("WITH g AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS r FROM documents GROUP BY source) SELECT doc_id, source, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END::INT AS fold FROM documents JOIN g USING (source)")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.grouped(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5)


@query(f"WITH {SCORES}, m AS (SELECT *, lower(source) = 'src3' AS own FROM scores), n AS (SELECT greatest(1, count_if(own)) AS n FROM m), r AS (SELECT id, source, y, own, CASE WHEN NOT own AND y = 0 THEN row_number() OVER (PARTITION BY NOT own AND y = 0 ORDER BY {KEY}, id) END AS rn FROM m) SELECT id, source, CASE WHEN own OR coalesce(rn <= n, false) THEN 'test' ELSE 'train' END AS split FROM r, n")
def leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.leave_one_out(scores(spark, sf_dir).select("id", "source", "y"), "source", "SRC3", "y", _order()).select("id", "source", "split")


@query("WITH r AS (SELECT event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) SELECT event_id, CASE WHEN rn <= floor(floor(n * 0.8::DOUBLE) * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.temporal(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"]).select("event_id", "split")


@query("WITH r AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn FROM events), f AS (SELECT *, n // 6 AS size, n - (5 - fold) * (n // 6) AS start FROM r, range(5) t(fold)) SELECT event_id, event_type, fold::INT AS fold, CASE WHEN rn >= start AND rn < start + size THEN 'test' ELSE 'train' END AS role FROM f WHERE (rn >= start AND rn < start + size) OR rn < start - 10")
def time_series_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.time_series(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"], 5, 10).drop("ts")


@query("WITH a AS (SELECT avg(l_quantity) FILTER (l_orderkey % 5 > 0) AS m, stddev_pop(l_quantity) FILTER (l_orderkey % 5 > 0) AS s FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg((l_quantity - m) / s), 6) AS mean, round(max((l_quantity - m) / s), 6) AS most FROM lineitem, a GROUP BY l_returnflag")
def train_only_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    out = s.scale(l, ["l_quantity"], F.col("l_orderkey") % 5 > 0)
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.max("l_quantity"), 6).alias("most"))


@query("WITH a AS (SELECT min(l_quantity) FILTER (l_orderkey % 5 > 0) AS m, max(l_quantity) FILTER (l_orderkey % 5 > 0) - min(l_quantity) FILTER (l_orderkey % 5 > 0) AS s FROM lineitem) SELECT l_returnflag, round(avg((l_quantity - m) / s), 6) AS mean, round(max((l_quantity - m) / s), 6) AS most FROM lineitem, a GROUP BY l_returnflag")
def minmax_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    out = s.scale(l, ["l_quantity"], F.col("l_orderkey") % 5 > 0, "minmax")
    return out.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.max("l_quantity"), 6).alias("most"))


# -- ordered rows ---------------------------------------------------------------------------


TIME = ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


@query("SELECT event_id, round(value - lag(value) OVER w, 6) AS diff, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ordered(_events(spark, sf_dir), ["user_id"], TIME, sums={"total": "value"}, before={"last": "value"})
    return e.select("event_id", F.round(F.col("value") - F.col("last"), 6).alias("diff"), F.round("total", 4).alias("total"))


@query("WITH m AS (SELECT user_id, value, avg(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m3, avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(avg(abs(value - m3)) FILTER (rn > 1 AND rn < n) / avg(value), 6) AS rap, round(avg(abs(value - m5)) FILTER (rn > 2 AND rn < n - 1) / avg(value), 6) AS ppq FROM m GROUP BY user_id")
def perturbation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    cuts = cuts_of(e, "ts")
    m = ordered(e, ["user_id"], TIME, before={"a": "value"}, after={"b": "value"}, cuts=cuts)
    m = ordered(m, ["user_id"], TIME, before={"aa": "a"}, after={"bb": "b"}, cuts=cuts)
    v = F.col("value")
    three, five = (F.col("a") + v + F.col("b")) / 3, (F.col("aa") + F.col("a") + v + F.col("b") + F.col("bb")) / 5  # null at the ends
    return m.groupBy("user_id").agg(F.round(F.avg(F.abs(v - three)) / F.avg(v), 6).alias("rap"), F.round(F.avg(F.abs(v - five)) / F.avg(v), 6).alias("ppq"))


@query("WITH f AS (SELECT *, value > 20 AS voiced FROM events), c AS (SELECT *, CASE WHEN voiced IS DISTINCT FROM lag(voiced) OVER w THEN 1 ELSE 0 END AS change FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c) SELECT user_id, island::BIGINT AS island, count(*) AS frames, min(ts) AS started, max(ts) AS ended FROM i WHERE voiced GROUP BY user_id, island HAVING count(*) >= 3")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    cuts = cuts_of(e, "ts")
    e = ordered(e.withColumn("voiced", F.col("value") > 20), ["user_id"], TIME, before={"last": "voiced"}, cuts=cuts)
    e = ordered(e.withColumn("change", (~F.col("voiced").eqNullSafe(F.col("last"))).cast("int")), ["user_id"], TIME, sums={"island": "change"}, cuts=cuts)
    return e.where("voiced").groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("frames"), F.min("ts").alias("started"), F.max("ts").alias("ended")).where("frames >= 3")


@query("WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(v, lambda s, x: 0.3::DOUBLE * x + 0.7::DOUBLE * s), 6) AS ema FROM a")
def ema_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each value's weight in the last average, so no group is one array
    e = ranked(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    weight = F.pow(F.lit(0.7), F.col("n") - F.col("rn")) * F.when(F.col("rn") == 1, 1.0).otherwise(0.3)
    return e.groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight), 6).alias("ema"))


@query("SELECT event_type, arg_max(event_id, (value, -event_id)) AS peak_at, round(max(value), 6) AS peak FROM events GROUP BY event_type")
def peak_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("peak_at"), F.round(F.max("value"), 6).alias("peak"))


@query("SELECT source, max(doc_id) + 1 AS next FROM documents GROUP BY source")
def next_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg((F.max("doc_id") + 1).alias("next"))


@query("WITH g AS (SELECT user_id, round(avg(value), 3) AS score FROM events GROUP BY user_id) SELECT user_id, score, rank() OVER (ORDER BY score DESC)::INT AS rank FROM g ORDER BY rank, user_id LIMIT 5")
def grid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 3).alias("score"))
    first = g.orderBy(F.desc("score"), "user_id").limit(5)  # a rank needs none of the rows below
    return first.withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"))))


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q / 100}), 6) AS p{q}" for q in (10, 25, 75, 90, 95)) + " FROM events GROUP BY event_type")
def frame_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = percentiles(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", {f"p{q}": q / 100 for q in (10, 25, 75, 90, 95)})
    return out.withColumns({c: F.round(c, 6) for c in out.columns[1:]})
