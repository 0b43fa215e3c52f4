"""Evaluation of binary detectors, grouped by any columns: a score p in [0, 1], a label y in {0, 1}, decision p >= threshold.

Curves are built over distinct scores: rows are counted by (group, score) first, with
partial sums. Real scores are nearly all distinct, so the order of a group's scores is then cut
into ranges (``ranks``) and no window has a group alone for its key.
Where a group lacks a class, metrics of ranking are NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisonde.operators.ranks import cuts_of, fresh, ordered, ranked

#: Cost model of the normalised minimum t-DCF for a fixed verification system. Fixed values.
P_SPOOF, C_MISS_ASV, C_FA_ASV, C_MISS_CM, C_FA_CM = 0.05, 1.0, 10.0, 1.0, 10.0
P_TARGET, P_NONTARGET = 0.9405, 0.0095
PMISS_ASV, PFA_ASV, PMISS_SPOOF_ASV = 0.0104, 0.0524, 0.0058
C1 = P_TARGET * (C_MISS_CM - C_MISS_ASV * PMISS_ASV) - P_NONTARGET * C_FA_ASV * PFA_ASV
C2 = C_FA_CM * P_SPOOF * (1 - PMISS_SPOOF_ASV)


#: Scores in a range of a curve.
ROWS = 200_000


def nan() -> Column:
    return F.lit(float("nan"))


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b as double, or a fixed value where b is 0."""
    return F.when(b == 0, F.lit(otherwise)).otherwise(a.cast("double") / b)


def sanitize(p: Column) -> Column:
    """NaN to 0.5, infinities to 1 and 0, then clipped to [0, 1]."""
    return F.when(F.isnan(p), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def confusion(scores: DataFrame, by: Sequence[str], threshold: float | Column = 0.5) -> DataFrame:
    """tp, tn, fp, fn per group."""
    hit = F.col("p") >= threshold
    return scores.groupBy(*by).agg(
        F.count_if((F.col("y") == 1) & hit).alias("tp"),
        F.count_if((F.col("y") == 0) & ~hit).alias("tn"),
        F.count_if((F.col("y") == 0) & hit).alias("fp"),
        F.count_if((F.col("y") == 1) & ~hit).alias("fn"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, specificity, fpr, fnr, npv from confusion counts; 0 where undefined."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "specificity": ratio(tn, tn + fp),
            "fpr": ratio(fp, fp + tn),
            "fnr": ratio(fn, fn + tp),
            "npv": ratio(tn, tn + fn),
        }
    )


def per_class(scores: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """One-against-rest precision, recall, f1 and support of either class."""
    pred = (F.col("p") >= threshold).cast("int")
    each = scores.withColumn("pred", pred).withColumn("label", F.explode(F.array(F.lit(0), F.lit(1))))
    own, said = F.col("y") == F.col("label"), F.col("pred") == F.col("label")
    counts = each.groupBy(*by, "label").agg(F.count_if(own & said).alias("tp"), F.count_if(~own & said).alias("fp"), F.count_if(own & ~said).alias("fn"), F.count_if(own).alias("support"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*by, "label", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "support")


def report(scores: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Rows for each class, then their plain (macro) and support-weighted means."""
    each = per_class(scores, by, threshold)
    names = ("precision", "recall", "f1")
    rows = each.withColumn("label", F.col("label").cast("string"))
    macro = each.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).withColumn("label", F.lit("macro"))
    weighted = each.groupBy(*by).agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).withColumn("label", F.lit("weighted"))
    return rows.unionByName(macro).unionByName(weighted)


def sweep(scores: DataFrame, by: Sequence[str], thresholds: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7)) -> DataFrame:
    """Rates at each of a few thresholds, in one pass."""
    each = scores.select(*by, "y", "p", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return rates(confusion(each, [*by, "threshold"], F.col("threshold")))


def falling(p: Column) -> Column:
    """A number that ascends as p descends in SQL: NaN first, as the greatest, and nulls last."""
    return F.when(p.isNull(), nan()).when(~F.isnan(p), -p)


def by_score(scores: DataFrame, by: Sequence[str], number: str | None = None, after: dict[str, str] | None = None) -> DataFrame:
    """Per distinct score: its positives and negatives, those at or above it (tp, fp), and the group's (np, nn); if asked its number from the highest, and values of the next lower one."""
    each = scores.groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    (down,) = fresh(each, "down")
    each = each.withColumn(down, falling(F.col("p")))
    return ordered(each, by, [down], cuts=cuts_of(scores, falling(F.col("p")), each=ROWS), number=number, sums={"tp": "pos", "fp": "neg"}, totals={"np": "pos", "nn": "neg"}, after=after).drop(down)


def roc_auc(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve, ties counted half."""
    area = F.sum(F.col("pos") * (F.col("nn") - F.col("fp")) + 0.5 * F.col("pos") * F.col("neg"))
    out = by_score(scores, by).groupBy(*by).agg(area.alias("a"), F.max("np").alias("np"), F.max("nn").alias("nn"))
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return out.select(*by, "np", "nn", F.when(both, F.col("a") / (F.col("np") * F.col("nn"))).otherwise(nan()).alias("auc"))


def pr_auc(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under precision over recall by trapezoids, from (0, 1)."""
    at, tp, fp = by_score(scores, by), F.col("tp"), F.col("fp")
    t0, f0 = tp - F.col("pos"), fp - F.col("neg")  # at the score before
    at = at.withColumn("piece", (ratio(tp, F.col("np")) - ratio(t0, F.col("np"))) * (ratio(tp, tp + fp) + ratio(t0, t0 + f0, 1.0)) / 2)
    out = at.groupBy(*by).agg(F.sum("piece").alias("a"), F.max("np").alias("np"), F.max("nn").alias("nn"))
    return out.select(*by, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("a")).otherwise(nan()).alias("pr_auc"))


def roc_points(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Vertices of the ROC curve: points where the slope changes, and both ends. ord counts from the highest score.

    Samples without a label count for nothing. Scores above the first label are points without rates, and where
    the curve starts from such it has no slope, so that label's own point is none unless it is the last.
    """
    at = by_score(scores, by, "ord", {"on_pos": "pos", "on_neg": "neg"}).where("np > 0 and nn > 0")
    told, turns = F.col("tp") + F.col("fp"), (F.col("on_pos") != F.col("pos")) | (F.col("on_neg") != F.col("neg"))
    turns = F.when(told == 0, True).when((told == F.col("pos") + F.col("neg")) & (F.col("ord") > 1), False).otherwise(turns)
    at = at.withColumn("ord", F.col("ord").cast("int")).withColumn("vertex", F.col("on_pos").isNull() | turns)
    rate = lambda n, of: F.when(told > 0, F.col(n) / F.col(of))
    points = at.where("vertex").select(*by, "ord", F.col("p").alias("threshold"), rate("fp", "nn").alias("fpr"), rate("tp", "np").alias("tpr"))
    start = at.where("ord = 1").select(*by, F.lit(0).alias("ord"), F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def eer(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Equal error rate at the vertex where |FPR - FNR| is least (the first such), and its threshold."""
    gap = F.abs(F.col("fpr") - (1 - F.col("tpr")))
    best = F.min_by(F.struct("threshold", ((F.col("fpr") + 1 - F.col("tpr")) / 2).alias("eer")), F.struct(F.round(gap, 12), F.col("ord")))
    return roc_points(scores, by).where("fpr is not null").groupBy(*by).agg(best.alias("b")).select(*by, "b.eer", F.col("b.threshold").alias("eer_threshold"))


def eer_by_interpolation(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Equal error rate where the ROC polyline meets 1 - FPR = TPR, and the threshold interpolated between the two vertices around."""
    gap = 1 - F.col("fpr") - F.col("tpr")
    points = roc_points(scores, by).where("fpr is not null").withColumn("gap", gap)
    at = ordered(points, by, [falling(F.col("threshold")), "ord"], cuts=cuts_of(scores, falling(F.col("p")), each=ROWS), before={"f0": "fpr", "t0": "threshold", "g0": "gap"})
    share = F.when(F.col("g0") == F.col("gap"), 0.0).otherwise(F.col("g0") / (F.col("g0") - F.col("gap")))
    root = F.col("f0") + share * (F.col("fpr") - F.col("f0"))
    cut = F.when(F.col("t0") == float("inf"), F.col("threshold")).otherwise(F.col("t0") + share * (F.col("threshold") - F.col("t0")))
    crossing = at.where((F.col("g0") >= 0) & (F.col("gap") <= 0))
    return crossing.groupBy(*by).agg(F.min_by(F.struct(root.alias("eer"), cut.alias("threshold")), "ord").alias("b")).select(*by, "b.eer", F.col("b.threshold").alias("eer_threshold"))


def multiclass_auc(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Areas of many classes from rows (id, label, cls, p), one for each class of each sample: each class against the rest, weighted by its samples; and each pair of classes, weighted by both's.

    A class without samples, or with all of them, counts for nothing.
    """
    keys = list(by)
    rest = roc_auc(scores.withColumn("y", (F.col("label") == F.col("cls")).cast("int")), [*keys, "cls"]).where("np > 0 and nn > 0")
    ovr = rest.groupBy(*keys).agg((F.sum(F.col("auc") * F.col("np")) / F.sum("np")).alias("ovr"))
    # a sample of class a with the score of class b is a negative of the pair's side b, and a positive of side a by its own
    own = F.max(F.when(F.col("label") == F.col("cls"), F.col("p"))).over(Window.partitionBy(*keys, "id"))  # a row for each class
    pos = scores.withColumn("own", own).where("label <> cls").select(*keys, F.col("label").alias("one"), F.col("cls").alias("other"), "id", F.col("own").alias("p"), F.lit(1).alias("y"))
    neg = scores.where("label <> cls").select(*keys, F.col("cls").alias("one"), F.col("label").alias("other"), "id", "p", F.lit(0).alias("y"))
    pair = roc_auc(pos.unionByName(neg), [*keys, "one", "other"]).where("np > 0 and nn > 0")
    ovo = pair.groupBy(*keys).agg((F.sum(F.col("auc") * (F.col("np") + F.col("nn"))) / F.sum(F.col("np") + F.col("nn"))).alias("ovo"))
    return ovr.join(ovo, keys, "left") if keys else ovr.join(F.broadcast(ovo), F.lit(True))  # one row each


def fold_metrics(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy, precision, recall, f1 and area of each fold; the area of a fold with one class is 0."""
    out = rates(confusion(scores, by)).join(roc_auc(scores, by).select(*by, "auc"), list(by))
    return out.withColumn("auc", F.nanvl("auc", F.lit(0.0))).select(*by, "accuracy", "precision", "recall", "f1", "auc")


def accuracy_at_eer(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy at the threshold of the equal error rate."""
    at = scores.join(eer(scores, by), list(by))
    right = (F.col("p") >= F.col("eer_threshold")).cast("int") == F.col("y")
    return at.groupBy(*by).agg(F.avg(right.cast("double")).alias("accuracy_at_eer"))


def det_curve(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Miss and false-alarm rates when all samples up to a place in the order of scores are rejected; ties keep bona fide (y = 0) first.

    Bona fide samples have high values of 1 - p, so samples are rejected from the highest
    p down to the lowest. Windows see distinct scores; samples of one score are ranked.
    """
    at = by_score(scores, by).where("nn > 0 and np > 0").alias("s")
    own = ranked(scores.select(*by, "p", "y", "id"), [*by, "p", "y"], ["id"], "k", "same").alias("o")
    at = own.join(at, [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "p")])
    bona = F.col("o.y") == 0
    missed = F.when(bona, F.col("s.fp") - F.col("s.neg") + F.col("k")).otherwise(F.col("s.fp"))
    caught = F.when(bona, F.col("s.tp") - F.col("s.pos")).otherwise(F.col("s.tp") - F.col("s.pos") + F.col("k"))
    at = at.select(*[f"o.{c}" for c in by], (missed + caught).alias("ord"), missed.alias("missed"), caught.alias("caught"), F.col("s.nn").alias("nb"), F.col("s.np").alias("ns"), F.col("o.p").alias("p"))
    curve = at.select(*by, "ord", F.col("p").alias("threshold"), (F.col("missed") / F.col("nb")).alias("pmiss"), ((F.col("ns") - F.col("caught")) / F.col("ns")).alias("pfa"))
    start = at.where("ord = 1").select(*by, F.lit(0).cast("long").alias("ord"), (F.col("p") + 1e-3).alias("threshold"), F.lit(0.0).alias("pmiss"), F.lit(1.0).alias("pfa"))
    return curve.unionByName(start)


def min_tdcf(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Normalised minimum t-DCF of the countermeasure; 1 where a class is missing.

    Within samples of one score the cost first rises, then falls, so the least lies at a distinct
    score or at the start, where nothing is rejected.
    """
    cost = (C1 * F.col("fp") / F.col("nn") + C2 * (F.col("np") - F.col("tp")) / F.col("np")) / min(C1, C2)
    found = by_score(scores, by).where("nn > 0 and np > 0").groupBy(*by).agg(F.least(F.min(cost), F.lit(C2 / min(C1, C2))).alias("m"))
    groups = scores.select(*by).distinct()
    return groups.join(found, list(by), "left").select(*by, F.coalesce("m", F.lit(1.0)).alias("min_tdcf"))


def temperature_grid(scores: DataFrame, by: Sequence[str], low: int = 5, high: int = 49) -> DataFrame:
    """The temperature of the grid (tenths from low to high) with the least mean negative log-likelihood, the first of equals."""
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("p")))
    each = scores.select(*by, "y", F.log(q / (1 - q)).alias("z"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("k"))
    s = 1 / (1 + F.exp(-F.col("z") / (F.col("k") / 10.0)))
    s = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), s))
    nll = each.groupBy(*by, "k").agg(F.avg(F.when(F.col("y") == 1, -F.log(s)).otherwise(-F.log(1 - s))).alias("nll"))
    return nll.groupBy(*by).agg(F.min_by(F.struct("k", "nll"), F.struct(F.round("nll", 9), F.col("k"))).alias("b")).select(*by, (F.col("b.k") / 10.0).alias("temperature"), "b.nll")


def evaluate(scores: DataFrame, by: Sequence[str], least_auc: float = 0.6, least_accuracy: float = 0.55) -> DataFrame:
    """Rates, ranking metrics and whether a detector has converged, per group."""
    keys = list(by)
    out = rates(confusion(scores, by)).join(roc_auc(scores, by), keys).join(eer(scores, by), keys, "left").join(min_tdcf(scores, by), keys)
    good = (~F.isnan("auc")) & (F.col("auc") >= least_auc) & (F.col("accuracy") >= least_accuracy)
    return out.withColumn("converged", good)


def robustness(scores: DataFrame, by: Sequence[str], condition: str, values: Sequence[str]) -> DataFrame:
    """Accuracy of each group under each condition, a column for each."""
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
    return scores.withColumn("right", right).groupBy(*by).pivot(condition, list(values)).agg(F.round(F.avg("right"), 6))
