from __future__ import annotations

import pytest

DOCS = "doc_id long, text string"

#: Texts that every operator must take: none, empty, blank, ties, repeats, a null identifier, odd characters.
ODD = [(1, None), (2, ""), (3, "   \n "), (4, "same words here"), (5, "same words here"), (5, "same words here"), (None, "no number"), (6, "é漢😀 ½\x00 a"), (7, "x" * 3000)]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with more columns whose names clash with those that operators add."""
    rows = [(i, t, "a", 1, 0.5, i) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS + ", host string, kept int, score double, gone_id long")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS + ", host string, kept int, score double, gone_id long")


@pytest.fixture(scope="session")
def docs(spark):
    from compare import SF

    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
