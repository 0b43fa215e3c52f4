"""Shortcut audit: whether a classifier of a few trivial features of clips already tells the labels apart.

Features are expressions over a clip's samples, groups of clips stay on one side of the split,
and a logistic regression is fitted by Spark. A balanced accuracy far above one half on the held-out
side means that labels leak through loudness, offset, silence or the like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.functions import arrays as a
from lumisonde.operators import splits
from lumisonde.operators.ranks import RANGES, ordered

FEATURES = ("rms", "offset", "abs_mean", "std", "largest", "crest", "zero_crossings", "silent_share", "clipped_share", "energy", "length", "first_difference")

#: Cuts of 64-bit hashes into even ranges, which no job has to find.
EVEN = [-(2.0**63) + k * 2.0**64 / RANGES for k in range(1, RANGES)]


def features(x: Column) -> dict[str, Column]:
    """The twelve global features of an array of samples; 0 where one is undefined."""
    size = F.size(x)
    share = lambda keep: F.when(size > 0, F.size(F.filter(x, keep)) / size)
    peak, level = a.peak(x), a.rms(x)
    made = {
        "rms": level, "offset": a.mean(x), "abs_mean": a.mean(F.transform(x, lambda v: F.abs(v))), "std": a.std(x), "largest": peak,
        "crest": F.when(level > 0, peak / level), "zero_crossings": F.when(size > 1, a.sign_changes(x)), "silent_share": share(lambda v: F.abs(v) < 1e-3), "clipped_share": share(lambda v: F.abs(v) >= 0.99),
        "energy": a.energy(x), "length": size.cast("double"), "first_difference": F.when(size > 1, a.mean(F.transform(a.differences(x), lambda v: F.abs(v)))),
    }
    return {k: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)) for k, v in made.items()}


def balanced_accuracy(scored: DataFrame, label: str, predicted: str) -> Column:
    """The mean of both classes' recalls; a class that does not occur counts for nothing."""
    hit = (F.col(label) == F.col(predicted)).cast("double")
    one, zero = F.avg(F.when(F.col(label) == 1, hit)), F.avg(F.when(F.col(label) == 0, hit))
    return F.coalesce((one + zero) / 2, one, zero)


def shortcuts(rows: DataFrame, label: str, group: str, names: Sequence[str] = FEATURES, parts: int = 4, least: float = 0.65, seed: int = 7) -> DataFrame:
    """(feature, accuracy, drop, shortcut): the balanced accuracy on the held-out groups of all features together (feature null), and for each feature how much of it is lost when its values are dealt to other rows.

    Rows (label, group, features) are split so that groups are whole and labels alike on both sides. shortcut says whether the accuracy, or the
    loss, is more than chance explains: at least ``least``, or a fifth of what lies between one half and the accuracy.
    """
    dealt = splits.stratified_groups(rows, label, group, parts)
    train, test = dealt.where("fold > 0"), dealt.where("fold = 0")
    assembled = VectorAssembler(inputCols=list(names), outputCol="raw_")
    scaler = StandardScaler(inputCol="raw_", outputCol="x_", withMean=True).fit(assembled.transform(train))
    ready = lambda df: scaler.transform(assembled.transform(df))
    n = train.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"] or 0.5
    weights = F.when(F.col(label) == 1, 0.5 / max(n, 1e-9)).otherwise(0.5 / max(1 - n, 1e-9))
    model = LogisticRegression(labelCol=label, featuresCol="x_", weightCol="w_", maxIter=50, regParam=1e-3).fit(ready(train).withColumn("w_", weights))
    score = lambda df: model.transform(ready(df)).agg(balanced_accuracy(df, label, "prediction").alias("accuracy"))
    test = test.withColumn("id_", F.monotonically_increasing_id())
    out = score(test).select(F.lit(None).cast("string").alias("feature"), "accuracy")
    for name in names:
        # a feature's values in an order of their own: row k gets the value of the k-th row by a hash
        own, other = (ordered(test.withColumn("h_", F.xxhash64("id_", F.lit(s))), [], ["h_", "id_"], number="k_", size="n_", cuts=EVEN) for s in (f"{name}{seed}", f"{seed}{name}"))
        mixed = own.drop(name, "h_", "n_").join(other.select("k_", name), "k_")
        out = out.unionByName(score(mixed).select(F.lit(name).alias("feature"), "accuracy"))
    whole = F.max(F.when(F.col("feature").isNull(), F.col("accuracy")))
    top = out.agg(whole.alias("whole"))
    out = out.join(F.broadcast(top), F.lit(True)).withColumn("drop", F.col("whole") - F.col("accuracy"))
    flagged = F.when(F.col("feature").isNull(), F.col("accuracy") >= least).otherwise((F.col("whole") >= least) & (F.col("drop") >= 0.2 * (F.col("whole") - 0.5)))
    return out.select("feature", "accuracy", "drop", flagged.alias("shortcut"))
