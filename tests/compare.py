"""Rows of a query against rows of SQL, both as sorted text."""

from __future__ import annotations

import datetime

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v) -> str:
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def of_spark(df) -> tuple[list[str], list[tuple[str, ...]]]:
    cols = sorted(df.columns)
    return cols, sorted(tuple(text(r[c]) for c in cols) for r in df.collect())


def of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple[str, ...]]]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(tuple(text(r[i]) for i in at) for r in got.fetchall())
