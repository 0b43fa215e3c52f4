"""Table operators: logs of analyses, lookups with fallbacks, balancing, audits, consolidation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisonde.functions.arrays import fixed
from lumisonde.operators.ranks import percentiles, ranked

# -- logs ---------------------------------------------------------------------------------


def page(log: DataFrame, limit: int, offset: int = 0, at: str = "created_at", key: str = "id") -> DataFrame:
    """The rows from offset on, latest first; a top-k, not a full sort, as limit and offset bound it."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset at least 0")
    return log.orderBy(F.desc(at), key).offset(offset).limit(limit)


def search(log: DataFrame, model: str | None = None, fake: bool | None = None, text: str | None = None, limit: int = 500) -> DataFrame:
    """Latest rows that meet every condition given; text is matched in the file name, whatever its case."""
    out = log
    if model is not None:
        out = out.where(F.col("model_name") == model)
    if fake is not None:
        out = out.where(F.col("is_fake") == fake)
    if text:
        out = out.where(F.contains(F.lower("filename"), F.lit(text.lower())))
    return page(out, limit)


def display(log: DataFrame) -> DataFrame:
    """A log's rows as text: verdict, confidence in percent, N/A for what is missing."""
    percent = F.concat(fixed(F.col("confidence") * 100, 1), F.lit("%"))
    return log.select(
        "id",
        F.coalesce("filename", F.lit("N/A")).alias("filename"),
        F.when(F.col("is_fake").isNull(), "N/A").when(F.col("is_fake"), "FAKE").otherwise("REAL").alias("verdict"),
        F.when(F.col("confidence").isNull(), "N/A").otherwise(percent).alias("confidence"),
        F.coalesce("model_name", F.lit("N/A")).alias("model_name"),
    )


def choices(log: DataFrame, column: str, first: str) -> DataFrame:
    """Distinct non-empty values in order, after a fixed first one."""
    found = log.select(F.col(column).alias("choice")).where(F.col("choice").isNotNull() & (F.col("choice") != "")).distinct()
    out = found.withColumn("ord", F.row_number().over(Window.orderBy("choice")))  # as many rows as there are values
    return out.unionByName(log.sparkSession.createDataFrame([(first, 0)], "choice string, ord int"))


def recent(log: DataFrame, now: Column, hours: int = 24, at: str = "created_at") -> DataFrame:
    """Rows not older than so many hours."""
    return log.where(F.col(at) >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def age(seconds: Column) -> Column:
    """An age in words: seconds, minutes, hours or days."""
    n = lambda by: F.floor(seconds / by).cast("string")
    return F.when(seconds < 60, F.concat(n(1), F.lit("s"))).when(seconds < 3600, F.concat(n(60), F.lit("min"))).when(seconds < 86400, F.concat(n(3600), F.lit("h"))).otherwise(F.concat(n(86400), F.lit("d")))


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: what an update by key leaves. One aggregate, no window."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *[f"r.{c}" for c in rest])


def without(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """Deletion by key."""
    return rows.join(gone.select(*key).distinct(), list(key), "left_anti")


# -- lookups ------------------------------------------------------------------------------


def lookup(rows: DataFrame, small: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """rows with columns of a lookup table, or the given defaults where it has no such key. Spark broadcasts the table if it is small enough."""
    out = rows.join(small.dropDuplicates([key]), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in values.items()})


def variant(wanted: DataFrame, known: DataFrame, key: str, kind: str, value: str, default: str = "default") -> DataFrame:
    """value for (key, kind), or else that of the key's default kind."""
    own = known.select(key, kind, F.col(value).alias("own"))
    base = known.where(F.col(kind) == default).select(key, F.col(value).alias("base"))
    return wanted.join(own, [key, kind], "left").join(base, key, "left").select(*wanted.columns, F.coalesce("own", "base").alias(value))


def numbered(values: DataFrame, column: str, into: str) -> DataFrame:
    """Distinct values numbered from 0 in order, in ranges of the bytes they begin with or of the numbers they are."""
    first = F.col(column)
    if dict(values.dtypes)[column] == "string":
        first = F.conv(F.rpad(F.hex(F.substring(first.cast("binary"), 1, 6)), 12, "0"), 16, 10)
    return ranked(values.select(column).distinct().withColumn("first_", first.cast("double")), [], ["first_", column], into, "n_").select(column, (F.col(into) - 1).cast("int").alias(into))


def encode(rows: DataFrame, column: str, into: str = "code") -> DataFrame:
    """Values numbered from 0 in order."""
    return rows.join(numbered(rows, column, into), column)


def blocks(rows: DataFrame, index: str, size: int, owners: DataFrame, owner: str) -> DataFrame:
    """Each row's owner: rows index // size belong to the owner of that rank; beyond the last, null."""
    return rows.withColumn("block", F.floor(F.col(index) / size).cast("int")).join(numbered(owners, owner, "block"), "block", "left")


def first_match(names: DataFrame, name: str, priors: Sequence[tuple[str, float]], default: float = 0.6) -> DataFrame:
    """Weight of the first prior whose key is part of the name: an expression over a short list, not a join."""
    weight = F.lit(default)
    for part, w in reversed(priors):
        weight = F.when(F.contains(F.lower(name), F.lit(part)), w).otherwise(weight)
    return names.withColumn("weight", weight)


# -- dedup and balance ----------------------------------------------------------------------


def first_copies(rows: DataFrame, content: Column, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each content by its digest."""
    digest = rows.withColumn("digest", F.md5(content))
    firsts = digest.groupBy("digest").agg(F.min(F.struct(*order)).alias("first"))
    return digest.join(firsts, "digest").where(F.struct(*order) == F.col("first")).drop("first")


def round_robin(rows: DataFrame, group: str, order: str, keep: int) -> DataFrame:
    """The first keep rows when groups take turns, each in its own order."""
    return ranked(rows, [group], [order], "turn", "n").drop("n").where(F.col("turn") <= keep).orderBy("turn", group).limit(keep)


def balanced(rows: DataFrame, label: str, group: str, order: str, target: int) -> DataFrame:
    """Equal numbers of both labels, at most target, each chosen by turns among groups; kept tells who stays."""
    counts = rows.groupBy(label).count()
    quota = counts.agg(F.least(F.min("count"), F.lit(target)).alias("quota"), F.count(F.lit(1)).alias("labels"))
    each = ranked(rows, [label, group], [order], "turn", "n").drop("n")
    # place of a row when groups take turns: all rows of earlier turns, then the groups before it in its own turn
    turns = each.groupBy(label, "turn").count()
    before = F.sum("count").over(Window.partitionBy(label).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.select(label, "turn", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(label, "turn").orderBy(group))
    each = each.withColumn("place", place).join(turns, [label, "turn"])
    return each.join(F.broadcast(quota), F.lit(True)).withColumn("kept", (F.col("labels") > 1) & (F.col("before") + F.col("place") <= F.col("quota"))).drop("turn", "place", "before", "quota", "labels")


def subsample(rows: DataFrame, label: str, key: Sequence[Column | str], n: int) -> DataFrame:
    """n rows of each label in the order of a key, whose first column is a number or a time."""
    return ranked(rows, [label], key, size="all_").where(F.col("rn") <= n).drop("rn", "all_")


# -- audits -----------------------------------------------------------------------------------


def contingency(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Rows of each group with label 0 and 1."""
    return rows.groupBy(group).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))


def pure_rows(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Rows of groups that have one label only."""
    pure = contingency(rows, group, label).where((F.col("n0") == 0) | (F.col("n1") == 0))
    return rows.join(pure.select(group), group, "left_semi")


def coverage(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Per group and in total: rows, rows with a key, share of these, distinct keys."""
    out = rows.rollup(group).agg(F.count(F.lit(1)).alias("files"), F.count(key).alias("identified"), F.count_distinct(F.col(key)).alias("keys"))
    return out.withColumn("ratio", F.round(F.col("identified") / F.col("files"), 6))


def overlap(rows: DataFrame, split: str, group: str) -> DataFrame:
    """Groups in both train and test, and groups of test alone, from one bit mask per group."""
    bits = F.when(F.col(split) == "train", 1).when(F.col(split) == "val", 2).when(F.col(split) == "test", 4).otherwise(0)
    masks = rows.groupBy(group).agg(F.bit_or(bits).alias("m"))
    m = F.col("m")
    return masks.agg(F.count_if(m.bitwiseAND(5) == 5).alias("train_and_test"), F.count_if(m == 4).alias("test_only"), F.count_if(m.bitwiseAND(6) == 6).alias("val_and_test"), F.count(F.lit(1)).alias("groups"))


def gap_plan(groups: DataFrame, group: str, have: str, target: int, both: str = "both") -> DataFrame:
    """What each source is to add to reach the target: an equal part, at least 1, twice that for sources of both kinds."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    gap = F.greatest(F.lit(0), F.lit(target) - F.sum(have).over(Window.partitionBy(F.lit(1))))
    part = F.greatest(F.lit(1), F.floor(gap / n))
    return groups.withColumn("plan", F.when(gap == 0, 0).otherwise(part * F.when(F.col("kind") == both, 2).otherwise(1)))


# -- runs and folds -----------------------------------------------------------------------------


def best_run(runs: DataFrame, model: str, score: str, order: str) -> DataFrame:
    """The run with the best score of each model; of equal ones the later."""
    rest = [c for c in runs.columns if c != model]
    return runs.groupBy(model).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(score, F.lit(0.0)), F.col(order))).alias("r")).select(model, *[f"r.{c}" for c in rest])


def best_epoch(epochs: DataFrame, run: str) -> DataFrame:
    """Epoch with the least loss (the first such), the peak and last accuracy, and the drop between."""
    return epochs.groupBy(run).agg(
        F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"), F.max("accuracy").alias("peak"), F.max_by("accuracy", "epoch").alias("final")
    ).withColumn("drop", F.col("peak") - F.col("final"))


def stability(folds: DataFrame, model: str, score: str, fold: str) -> DataFrame:
    """Mean, spread (population), range, stability 1 - cv, and slope over folds with a flag for decline."""
    out = folds.groupBy(model).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("least"), F.max(score).alias("most"), F.regr_slope(score, fold).alias("slope"))
    cv = F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.col("mean"))
    return out.withColumns({"stability": F.greatest(F.lit(0.0), 1 - cv), "degrading": F.col("slope") < -0.01, "drop": F.col("most") - F.col("least")})


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) for each of k classes."""
    counts = rows.groupBy(label).count()
    whole = Window.partitionBy(F.lit(1))  # a row for each class
    return counts.select(label, (F.sum("count").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("count"))).alias("weight"))


def latency(rows: DataFrame, model: str, ms: str) -> DataFrame:
    """Mean, spread, least, exact median and 95th percentile, and calls a second."""
    out = rows.groupBy(model).agg(F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("std"), F.min(ms).alias("least"))
    return out.join(percentiles(rows, [model], ms, {"p50": 0.5, "p95": 0.95}), model).withColumn("per_second", 1000 / F.col("mean"))
