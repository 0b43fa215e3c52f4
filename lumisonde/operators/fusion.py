"""Post-processing of scores and fusion of several models' scores for one sample.

Rows are (sample, model, p) with p the probability of the positive class. Scores are always
matched by model, and what is averaged is p itself, never the confidence in the
predicted class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisonde.functions.arrays import let, total


def temperature(p: Column, t: float | None) -> Column:
    """p at another temperature; None, 1 and values up to 0 change nothing."""
    if t is None or t == 1 or t <= 0:
        return p
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return 1 / (1 + F.exp(-F.log(q / (1 - q)) / t))


def softmax(z: Column) -> Column:
    """Of an array, stable for large values."""
    shares = lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t))
    return let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp(x - top)), shares))


def entropy(p: Column) -> Column:
    """Natural entropy of an array of probabilities, zeros counting nothing."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def as_probabilities(rows: DataFrame, values: str, batch: str) -> DataFrame:
    """Arrays of a batch are softmaxed if any of the batch looks like logits: outside [0, 1] or not summing to about 1."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    odd = (F.array_min(values) < -0.001) | (F.array_max(values) > 1.001) | (total < 0.9) | (total > 1.1)
    any_odd = rows.groupBy(batch).agg(F.bool_or(odd).alias("logits"))
    return rows.join(any_odd, batch).withColumn(values, F.when(F.col("logits"), softmax(F.col(values))).otherwise(F.col(values)))


def ood_score(p: Column) -> Column:
    """ln K less the entropy: low where no class stands out."""
    return F.log(F.size(p)) - entropy(p)


def decide(rows: DataFrame, threshold: Column | float = 0.5) -> DataFrame:
    """is_fake (p rounded to 6 places, strictly over the threshold) and the confidence in the decision."""
    p = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p"))), 6)
    fake = p > threshold
    return rows.withColumn("p", p).withColumn("is_fake", fake).withColumn("confidence", F.when(fake, p).otherwise(1 - p))


def dropout_summary(rows: DataFrame, sample: str) -> DataFrame:
    """Mean, population variance and binary entropy over repeated scores; uncertain if either is large."""
    out = rows.groupBy(sample).agg(F.avg("p").alias("mean"), F.var_pop("p").alias("variance"))
    m = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("mean")))
    h = -(m * F.log(m) + (1 - m) * F.log(1 - m))
    return out.withColumn("entropy", h).withColumn("uncertain", (F.col("variance") > 0.05) | (F.col("entropy") > F.log(F.lit(2.0)) / 2))


def fuse(rows: DataFrame, sample: str, weight: str = "w") -> DataFrame:
    """Per sample: weighted, soft, majority and most-confident fusion, with the share of models that agree.

    majority is the vote (a tie counts as 0) unless the mean is between 0.4 and 0.6, where the mean decides.
    """
    vote = F.col("p") > 0.5
    n = F.count(F.lit(1))
    rows = rows.withColumns({"p": F.col("p").cast("double"), weight: F.col(weight).cast("double")})
    out = rows.groupBy(sample).agg(
        F.sort_array(F.collect_list(F.struct("model", "p", F.col(weight).alias("w")))).alias("parts_"),  # a row for each model
        F.count("p").alias("scored_"),
        F.count_if(vote).alias("votes"),
        n.alias("models"),
        F.max_by("p", F.struct(F.round(F.abs(F.col("p") - 0.5), 9), F.col("model"))).alias("max_conf"),
    )
    # the last digit of a sum depends on its order, and majority on whether a mean is 0.4 or just above: sums go by model, however rows arrive
    summed = lambda of: F.aggregate("parts_", F.lit(0.0), lambda s, m: s + F.coalesce(of(m), F.lit(0.0)))
    any_ = F.col("scored_") > 0
    soft = F.when(any_, summed(lambda m: m["p"]) / F.col("scored_"))
    weighted = F.when(any_, summed(lambda m: m["p"] * m["w"]) / summed(lambda m: m["w"]))
    out = out.select(sample, weighted.alias("weighted"), soft.alias("soft"), "votes", "models", "max_conf")
    unsure = (F.col("soft") > 0.4) & (F.col("soft") < 0.6)
    out = out.withColumn("majority", F.when(unsure, F.col("soft")).otherwise((2 * F.col("votes") > F.col("models")).cast("double")))
    return out.withColumn("agreement", F.greatest("votes", F.col("models") - F.col("votes")) / F.col("models"))


def consensus(rows: DataFrame, sample: str) -> DataFrame:
    """One label with its mean confidence if all models agree, else the surest model's label at 0.8 of its confidence."""
    label = (F.col("p") > 0.5).cast("int")
    confidence = F.round(F.when(F.col("p") > 0.5, F.col("p")).otherwise(1 - F.col("p")), 9)
    out = rows.groupBy(sample).agg(F.count_distinct(label).alias("kinds"), F.max_by(label, F.struct(confidence, F.col("model"))).alias("label"), F.avg(confidence).alias("mean"), F.max(confidence).alias("best"))
    return out.select(sample, "label", (F.col("kinds") == 1).alias("agreed"), F.when(F.col("kinds") == 1, F.col("mean")).otherwise(0.8 * F.col("best")).alias("confidence"))


def segments(rows: DataFrame, clip: str) -> DataFrame:
    """Per clip the mean of its windows' p and whether it is strictly over one half."""
    return rows.groupBy(clip).agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("windows")).withColumn("is_fake", F.col("p") > 0.5)


def with_errors(inputs: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every input with its prediction, or p 0 and an error where there is none."""
    return inputs.join(predictions.select(key, "p"), key, "left").withColumn("error", F.when(F.col("p").isNull(), "no prediction")).withColumn("p", F.coalesce("p", F.lit(0.0)))


def last_mean(rows: DataFrame, by: str, order: list[str], n: int = 5) -> DataFrame:
    """Mean of the last n scores of each stream."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("rn", rn).where(F.col("rn") <= n).groupBy(by).agg(F.avg("p").alias("mean"))
