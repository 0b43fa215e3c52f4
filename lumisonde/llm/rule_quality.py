"""Quality classifier: a sparse ensemble of rules over text statistics.

A small forest is grown on the statistics of labelled texts. Each path from a root is a
conjunction of thresholds, that is, a rule; a logistic regression with an L1 penalty over
all rules keeps the few that matter. These are compiled into one Spark column
expression, so scoring is a projection over the statistics.

The forest and the weights are fitted by Spark on at most ``sample`` labelled rows, taken
in the order of a hash of the identifier; statistics and scores cover whole texts of all rows.

Defined cases: a null text counts as empty and both get a score; repeated rows get equal
scores; labels that are null are ignored, and a doc_id labelled more than once has the
majority's label (a tie counts as 1); without labels of both classes the score is the
smoothed share of label 1; an empty table gives an empty table; other columns are
carried by ``score_with`` and clashing names get fresh ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisonde.llm.common import fresh, written

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, PENALTY = 16, 4, 0.002
#: A document is kept from this score on.
KEEP = 0.3

STATISTICS = (
    "chars", "words", "mean_word", "longest_word", "upper", "digits", "symbols", "exclaims", "bars", "high_bytes",
    "distinct_words", "repeated_next", "odd_ends", "lines", "repeated_lines", "stops", "spaces",
)
_UPPER, _DIGIT, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_STOP[[44, 46, 58, 59, 63]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#$%&*<>=@^_{}[]~\\/"]] = True
_SOUND_END = np.ones(256, bool)
_SOUND_END[[*b"#$%&*<>=@^_{}[]~\\/|!"]] = False


def statistics(text: str | None) -> tuple[float, ...]:
    """The numbers of STATISTICS: logarithms of sizes, and shares."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = raw.split()
    n, k = max(1, len(raw)), max(1, len(w))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = [len(x) for x in w]
    rows = [x for x in raw.split(b"\n") if x]
    return (
        np.log1p(len(raw)), np.log1p(len(w)), sum(lengths) / k, np.log1p(max(lengths, default=0)),
        count[_UPPER].sum() / n, count[_DIGIT].sum() / n, count[_SYMBOL].sum() / n, count[33] / n, count[124] / n, count[128:].sum() / n,
        len(set(w)) / k, sum(a == b for a, b in zip(w, w[1:])) / k, sum(not _SOUND_END[x[-1]] for x in w) / k,
        np.log1p(len(rows)), 1 - len(set(rows)) / max(1, len(rows)), count[_STOP].sum() / n, (count[32] + count[10]) / n,
    )


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=list(STATISTICS), dtype=float)


#: Declared nondeterministic so that no plan computes it twice for one row.
statistics_of = _statistics.asNondeterministic()

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most?, threshold), all of which hold


def paths(debug: str) -> list[Rule]:
    """All rules of a forest printed by Spark: every node's path from its root."""
    found, stack = [], []
    for line in debug.splitlines():
        if "Tree " in line and "weight" in line or line.lstrip().startswith("Tree"):
            stack = []
        elif m := re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            stack = [x for x in stack if x[0] < depth] + [(depth, (STATISTICS[int(m[3])], m[4] == "<=", float(m[5])))]
            found.append(tuple(x[1] for x in stack))
    return list(dict.fromkeys(tidy(r) for r in found))


def tidy(rule: Rule) -> Rule:
    """One threshold for each statistic and direction: the tightest."""
    best: dict[tuple[str, bool], float] = {}
    for s, below, t in rule:
        best[s, below] = t if (s, below) not in best else (min if below else max)(best[s, below], t)
    return tuple((s, below, t) for (s, below), t in sorted(best.items()))


def holds(rule: Rule, at: Column | None = None) -> Column:
    """The rule as a column over statistics."""
    get = (lambda s: at[s]) if at is not None else F.col
    return reduce(Column.__and__, [get(s) <= t if below else get(s) > t for s, below, t in rule])


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; ``column`` is the score."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, at: Column | None = None) -> Column:
        terms = [F.when(holds(r, at), w).otherwise(0.0) for r, w in self.rules]
        return 1 / (1 + F.exp(-reduce(Column.__add__, terms, F.lit(self.intercept))))


def majority(labels: DataFrame, label: str) -> DataFrame:
    """One (doc_id, y) for each labelled document."""
    return labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether the identifier's fold is the one kept from learning."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = 7) -> RuleModel:
    """Learns from the documents of labels, of which no more than sample are used."""
    y = majority(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("y", statistics_of("text").alias("s")).select("y", "s.*")
    rows = written(rows, "labelled")
    n, ones = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < ones < n:
        p = (ones + 1) / (n + 2)
        return RuleModel(float(np.log(p / (1 - p))), ())
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=max(2, n // 400), seed=seed).fit(data)
    rules = paths(forest.toDebugString)
    if not rules:
        p = (ones + 1) / (n + 2)
        return RuleModel(float(np.log(p / (1 - p))), ())
    marks = rows.select("y", F.array(*[holds(r).cast("double") for r in rules]).alias("m"))
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=PENALTY, maxIter=60)
    model = lasso.fit(written(marks, "rules").select("y", array_to_vector("m").alias("x")))
    w = model.coefficients.toArray()
    return RuleModel(float(model.intercept), tuple((r, float(x)) for r, x in zip(rules, w, strict=True) if abs(x) > 1e-6))


def score_with(model: RuleModel, docs: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the model's score of each text."""
    stats, into = fresh(docs, "stats", into)
    return docs.withColumn(stats, statistics_of(F.col(text))).withColumn(into, model.column(F.col(stats))).drop(stats)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP, folds: int = 5) -> DataFrame:
    """The documents whose score reaches the threshold; learns from labels outside the held-out fold."""
    model = fit(docs, labels.where(~held_out(folds=folds)))
    (s,) = fresh(docs, "score")
    return score_with(model, docs, into=s).where(F.col(s) >= threshold).drop(s)
