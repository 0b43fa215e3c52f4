"""Session settings and table access shared by every part of the library."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "lumisonde", cores: int | None = None, memory: str = "6g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings a session of its own."""
    n = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; columns are pruned by the queries, not here."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lumisonde_shipped", False):
        return
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="lumisonde-")) / "lumisonde.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(out))
    sc._lumisonde_shipped = True


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, run after the package is sent to the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
