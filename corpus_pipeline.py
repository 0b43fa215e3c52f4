"""The corpus pipeline: quality, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and
returns such documents, the last one pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumisonde.llm import ffd_packing, line_winnow, pii, rule_quality, simhash_trie
from lumisonde.llm.common import written
from lumisonde.session import shipped, table


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return rule_quality.keep_good(docs, table(spark, sf_dir, "labels"))


@shipped
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go."""
    return line_winnow.dedup_lines(docs)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash_trie.drop_near_copies(docs)


@shipped
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked."""
    return pii.redact(docs)


@shipped
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences."""
    return ffd_packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [(f.__name__, f) for f in (quality, line_dedup, near_dedup, personal_data, packing)]

#: Learning, fingerprints and tokenization have no counterpart in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written before the next reads it."""
    out = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out, name)
    return out
