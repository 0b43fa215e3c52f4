"""Stand-ins for audio tables over the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisonde.session import table


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p, lang, source): quality as label, and a score from the text's length, with many ties at 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    p = F.least(F.lit(1.0), F.floor(F.col("n_chars") / 40) / 100.0)
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), p.alias("p"), "lang", "source")


SCORES = """scores AS (SELECT d.doc_id AS id, l.quality AS y, least(1.0::DOUBLE, floor(d.n_chars / 40) / 100.0::DOUBLE) AS p, d.lang, d.source
  FROM documents d JOIN labels l USING (doc_id))"""


def real_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p, source): a score for each line item, nearly all of them different numbers."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    p = (F.col("l_extendedprice") / 200000.0) * 0.9 + ((key * 7919) % 1000003) / 20000060.0
    return items.select(key.alias("id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), p.alias("p"), F.col("l_linestatus").alias("source"))


REAL_SCORES = """scores AS (SELECT l_orderkey * 8 + l_linenumber AS id, (l_returnflag = 'R')::INT AS y,
  (l_extendedprice / 200000.0::DOUBLE) * 0.9::DOUBLE + ((l_orderkey * 8 + l_linenumber) * 7919 % 1000003) / 20000060.0::DOUBLE AS p, l_linestatus AS source FROM lineitem)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, filename, is_fake, confidence, model_name, created_at): a log of analyses, from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("clip_"), F.col("user_id")).alias("filename"),
        (F.col("value") > 50).alias("is_fake"),
        (F.col("value") / (F.col("value") + 50)).alias("confidence"),
        F.col("event_type").alias("model_name"),
        F.col("ts").alias("created_at"),
    )


HISTORY = """history AS (SELECT event_id AS id, concat('clip_', user_id) AS filename, value > 50 AS is_fake, value / (value + 50) AS confidence,
  event_type AS model_name, ts AS created_at FROM events)"""
