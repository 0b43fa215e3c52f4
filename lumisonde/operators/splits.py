"""Splits and folds without leakage. Order comes from a key column, never from a random generator, so they are the same on every run.

Ranks within a class are exact and cut into ranges of the key, so no class is one task. A key
is a list of columns, the first of which is a number or a time. Group splits decide over a row for each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.operators import preparation
from lumisonde.operators.ranks import ranked

Key = Sequence[Column | str]


def stratified(rows: DataFrame, label: str, key: Key, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """split is test, val or train, with each label's rows shared out in these proportions (floors)."""
    t, v = F.floor(F.col("n") * test), F.floor(F.col("n") * val)
    split = F.when(F.col("rn") <= t, "test").when(F.col("rn") <= t + v, "val").otherwise("train")
    return ranked(rows, [label], key).withColumn("split", split).drop("rn", "n")


def secure(rows: DataFrame, label: str, key: Key, test: float = 0.2, val: float = 0.2) -> DataFrame:
    """Test first, then val as the share val / (1 - test) of what is left."""
    t = F.floor(F.col("n") * test)
    v = F.floor((F.col("n") - t) * (val / (1 - test)))
    split = F.when(F.col("rn") <= t, "test").when(F.col("rn") <= t + v, "val").otherwise("train")
    return ranked(rows, [label], key).withColumn("split", split).drop("rn", "n")


def folds(rows: DataFrame, label: str, key: Key, k: int) -> DataFrame:
    """fold from 0 to k - 1, dealt in turn within each label."""
    return ranked(rows, [label], key).withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn", "n")


def grouped(rows: DataFrame, group: str, parts: int) -> DataFrame:
    """fold such that a group is in one fold only: groups by falling size are dealt forth and back over the folds."""
    sizes = rows.groupBy(group).count()
    rank = F.col("rn") - 1
    turn, at = F.floor(rank / parts), rank % parts
    placed = ranked(sizes, [], [-F.col("count"), group]).select(group, F.when(turn % 2 == 0, at).otherwise(parts - 1 - at).cast("int").alias("fold"))
    return rows.join(placed, group)


#: Groups that one fold over groups deals, on average.
DEALT = 4_096


def stratified_groups(rows: DataFrame, label: str, group: str, parts: int, dealt: int = DEALT) -> DataFrame:
    """fold such that a group is in one fold only and the labels' shares are alike in all.

    Groups are taken by falling size, each into the fold whose counts, relative to even ones, it raises least: a fold over a row
    for each group. Where there are many groups, a hash deals them into lots of about ``dealt`` groups that are settled on their own, so
    that no task sees all.
    """
    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n_"))
    labels = [r[0] for r in counts.select(label).distinct().orderBy(label).limit(1_000).collect()]  # classes are few
    each = counts.groupBy(group).agg(F.array(*[F.coalesce(F.sum(F.when(F.col(label).eqNullSafe(F.lit(v)), F.col("n_"))), F.lit(0)).cast("double") for v in labels]).alias("c_"))
    lots = max(1, -(-each.count() // dealt))
    spread = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    each = each.withColumns({"size_": spread(F.col("c_")), "lot_": F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(lots))})
    row = F.struct((-F.col("size_")).alias("size"), F.xxhash64(F.col(group).cast("string")).alias("h"), F.col(group).alias("g"), F.col("c_").alias("c"))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), len(labels)), parts)
    total = lambda rs: F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda i: F.aggregate(rs, F.lit(0.0), lambda s, r: s + F.get(r["c"], i)))
    lot = each.groupBy("lot_").agg(F.sort_array(F.collect_list(row)).alias("rows_"))  # about ``dealt`` groups
    lot = lot.withColumn("even_", F.transform(total(F.col("rows_")), lambda v: F.greatest(v / parts, F.lit(1e-9))))
    # how far a fold's counts would be above the even share, over all labels
    excess = lambda have, c: F.aggregate(F.zip_with(F.zip_with(have, c, lambda u, v: u + v), "even_", lambda u, e: u / e), F.lit(0.0), lambda s, v: s + v * v) - F.aggregate(F.zip_with(have, "even_", lambda u, e: u / e), F.lit(0.0), lambda s, v: s + v * v)
    kind = rows.schema[group].dataType.simpleString()
    state = f"struct<have: array<array<double>>, out: array<struct<g: {kind}, f: int>>>"
    start = F.struct(zeros.alias("have"), F.array().alias("out")).cast(state)

    def step(s: Column, r: Column) -> Column:
        best = F.array_min(F.transform(s["have"], lambda h, f: F.struct(F.round(excess(h, r["c"]), 9).alias("e"), f.alias("f"))))["f"]
        have = F.transform(s["have"], lambda h, f: F.when(f == best, F.zip_with(h, r["c"], lambda u, v: u + v)).otherwise(h))
        return F.struct(have.alias("have"), F.concat(s["out"], F.array(F.struct(r["g"].alias("g"), best.alias("f")))).alias("out")).cast(state)

    placed = lot.select(F.explode(F.aggregate("rows_", start, step, lambda s: s["out"])).alias("p")).select(F.col("p.g").alias("g_"), F.col("p.f").alias("fold"))
    return rows.join(placed, F.col(group).eqNullSafe(F.col("g_"))).drop("g_")


def by_mode(rows: DataFrame, label: str, key: Key, group: str | None = None, speaker: str | None = None, generator: str | None = None, hold_speaker: str | None = None, hold_generator: str | None = None, parts: int = 6) -> DataFrame:
    """rows with split (train, val, test) and the mode that made it, the first that is asked for and possible: a speaker held out, a generator held out, by speaker, by group, or stratified.

    A held-out name's rows are the test side, with as many others of label 0; of the rest a part of each label validates. Grouped modes put whole groups into the folds of
    ``stratified_groups``: the first tests, the second validates.
    """
    mode = preparation.split_strategy(rows, label, group, speaker, generator, hold_speaker, hold_generator)
    if mode.startswith("holdout"):
        column, held = (speaker, hold_speaker) if mode == "holdout_speaker" else (generator, hold_generator)
        out = leave_one_out(rows, column, held, label, key)
        rest = folds(out.where("split = 'train'"), label, key, parts)
        out = out.where("split = 'test'").unionByName(rest.withColumn("split", F.when(F.col("fold") == 0, "val").otherwise("train")).drop("fold"))
    elif mode in ("speaker_split", "group_split"):
        out = stratified_groups(rows, label, speaker if mode == "speaker_split" else group, parts)
        out = out.withColumn("split", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train")).drop("fold")
    else:
        out = stratified(rows, label, key)
    return out.withColumn("mode", F.lit(mode))


def leave_one_out(rows: DataFrame, group: str, held: str, label: str, key: Key) -> DataFrame:
    """Test: all rows of one group (whatever the case of its name) and as many others of label 0; the rest trains."""
    own = F.lower(F.col(group)) == held.lower()
    marked = rows.withColumn("own", own)
    n = marked.agg(F.greatest(F.lit(1), F.count_if("own")).alias("n"))
    real = (~F.col("own")) & (F.col(label) == 0)
    out = ranked(marked.withColumn("real_", real), ["real_"], key, size="all_").withColumn("rn", F.when(F.col("real_"), F.col("rn"))).drop("all_", "real_").join(F.broadcast(n), F.lit(True))
    return out.withColumn("split", F.when(F.col("own") | (F.coalesce(F.col("rn") <= F.col("n"), F.lit(False))), "test").otherwise("train")).drop("own", "rn", "n")


def temporal(rows: DataFrame, by: Sequence[str], at: Sequence[str], test: float = 0.2, val: float = 0.2) -> DataFrame:
    """Per partition in order of time: the last share is test, the last share of the remainder val."""
    rest = F.floor(F.col("n") * (1 - test))
    train = F.floor(rest * (1 - val))
    return ranked(rows, by, at).withColumn("split", F.when(F.col("rn") <= train, "train").when(F.col("rn") <= rest, "val").otherwise("test")).drop("rn", "n")


def time_series(rows: DataFrame, by: Sequence[str], at: Sequence[str], k: int, gap: int = 0, most: int | None = None) -> DataFrame:
    """(fold, role) for each row and fold it is in: test blocks follow one another, training is all before, less a gap, at most so many rows."""
    each = ranked(rows, by, at).withColumn("rn", F.col("rn") - 1)
    size = F.floor(F.col("n") / (k + 1))
    each = each.withColumn("size", size).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.col("n") - (k - F.col("fold")) * F.col("size")
    role = F.when((F.col("rn") >= start) & (F.col("rn") < start + F.col("size")), "test").when((F.col("rn") < start - gap) & (F.col("rn") >= (start - gap - most if most is not None else 0)), "train")
    return each.withColumn("role", role).where("role is not null").drop("n", "rn", "size")


def scale(rows: DataFrame, columns: Sequence[str], train: Column, method: str = "standard") -> DataFrame:
    """Columns scaled by statistics of training rows only: standard (population) or minmax; zero spread gives 0."""
    if method not in ("standard", "minmax"):
        raise ValueError("method is standard or minmax")
    made = []
    for c in columns:
        x = F.when(train, F.col(c))
        low, spread = (F.avg(x), F.stddev_pop(x)) if method == "standard" else (F.min(x), F.max(x) - F.min(x))
        made += [low.alias(f"{c}__low"), spread.alias(f"{c}__spread")]
    out = rows.join(F.broadcast(rows.agg(*made)), F.lit(True))  # one row
    out = out.withColumns({c: F.when(F.col(f"{c}__spread") == 0, 0.0).otherwise((F.col(c) - F.col(f"{c}__low")) / F.col(f"{c}__spread")) for c in columns})
    return out.drop(*[f"{c}__{s}" for c in columns for s in ("low", "spread")])
