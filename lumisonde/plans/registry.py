"""All queries of the library but the text operators, and the SQL that checks each."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


for _part in ("metric_queries", "relational_queries", "split_queries", "fusion_queries", "array_queries", "stream_queries", "preparation_queries", "voice_queries"):
    importlib.import_module(f"lumisonde.plans.{_part}")
