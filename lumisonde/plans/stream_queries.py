"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisonde.plans.registry import query
from lumisonde.session import shipped, table
from lumisonde.streaming import detector


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one, or a local one where none is set and Spark runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='lumisonde-')}/stream-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs all that is there now, each batch to Parquet (complete results replace the last), and reads it back."""
    spark = stream.sparkSession
    out = _folder(spark)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data" if mode == "complete" else f"{out}/data/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data").select(*stream.columns)


@query("WITH w AS (SELECT event_type, value, ts, time_bucket(INTERVAL 30 MINUTES, ts) - o * INTERVAL 30 MINUTES AS start FROM events, range(2) t(o)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events) GROUP BY ALL")
def watermark_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed, each written once; their state is freed."""
    return drained(detector.windowed(events_stream(spark, sf_dir)), "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH w AS (SELECT event_type, value, ts, time_bucket(INTERVAL 30 MINUTES, ts) - o * INTERVAL 30 MINUTES AS start FROM events, range(2) t(o)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def batch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return detector.windowed(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
@shipped
def stream_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(detector.detect(events_stream(spark, sf_dir), "user_id", ["ts", "event_id"], "value"), "append")
