"""The corpus pipeline against plain versions of its stages, and on odd tables."""

from __future__ import annotations

import math
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumisonde.llm import pii, rule_quality

SMALL = "/root/testdata/sf0.001"


def plain_quality(spark, docs):
    """The rules of the fitted model, applied one by one to a text's statistics."""
    model = rule_quality.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet").where(~rule_quality.held_out()))
    out = {}
    for i, t in docs.items():
        at = dict(zip(rule_quality.STATISTICS, rule_quality.statistics(t)))
        z = model.intercept + sum(w for rule, w in model.rules if all(at[s] <= c if below else at[s] > c for s, below, c in rule))
        out[i] = 1 / (1 + math.exp(-z))
    return out


def plain_near(docs):
    """Identifiers that stay: the smallest of each component of sets of five-word shingles with similarity 0.8."""
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            x, y = sets[i], sets[j]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {find(i) for i in ids}


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_are_plain_ones(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "personal_data", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    was = texts(docs)
    out = corpus_pipeline.written(stage["quality"](spark, docs, SMALL), "t")
    score = plain_quality(spark, was)
    assert texts(out) == {i: t for i, t in was.items() if score[i] >= rule_quality.KEEP} and out.columns == docs.columns
    was = texts(out)
    out = corpus_pipeline.written(stage["line_dedup"](spark, out, SMALL), "t")
    now = texts(out)
    assert set(now) == set(was) and out.columns == docs.columns
    for i, t in now.items():
        rest = iter((was[i] or "").split("\n"))
        assert all(x in rest for x in t.split("\n")) or t == ""  # lines in their order
    was = now
    out = corpus_pipeline.written(stage["near_dedup"](spark, out, SMALL), "t")
    assert set(texts(out)) == plain_near(was) and out.columns == docs.columns
    was = texts(out)
    out = corpus_pipeline.written(stage["personal_data"](spark, out, SMALL), "t")
    assert texts(out) == {i: pii.mask(t) for i, t in was.items()} and out.columns == docs.columns
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]", t or "") for t in texts(out).values())
    was = texts(out)
    rows = stage["packing"](spark, out, SMALL).collect()

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in was.items()}
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {i: sum(n for _, n in v) for i, v in got.items()} == want
    assert all(sorted(v)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:])) for v in got.values())
    whole = corpus_pipeline.run(spark, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in whole} == want


def test_near_stage_finds_pairs_at_every_similarity(spark):
    """Pairs of about 400 words: all pairs at 0.8 or more are found, none below."""
    from lumisonde.llm import simhash_trie

    rng = np.random.default_rng(5)
    docs = {}
    for k in range(120):
        w = [f"w{x}" for x in rng.integers(0, 10**9, 400)]
        v = list(w)
        for at in rng.choice(400, rng.integers(1, 14), replace=False):
            v[at] = f"x{rng.integers(10**9)}"
        docs[2 * k], docs[2 * k + 1] = " ".join(w), " ".join(v)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash_trie.drop_near_copies(frame).collect()}
    assert kept == plain_near(docs) and 0 < sum(2 * k + 1 in kept for k in range(120)) < 120


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_tables(spark, tmp_path, rows):
    made = [] if rows == "none" else [(1, None), (2, ""), (3, "  \n"), (4, "same words here"), (5, "same words here"), (5, "same words here"), (None, "no number"), (None, None), (6, "a@b.com " * 3), (7, "long " * 100_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long, stats string, score int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {i for i, _ in made} and (bool(out) == bool(made))
