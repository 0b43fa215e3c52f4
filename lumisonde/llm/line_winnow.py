"""Line dedup by winnowing: repeated runs of lines are found by guaranteed fingerprints and their later copies deleted.

DataFrame operations only. Lines are trimmed of spaces; blank ones do not count. All
sizes below are in words, so a passage is caught whether it is one line or many.

*Grams.* At each line stands the gram of the lines that begin within ``noise`` words from
its start (if that many words follow); its hash is taken over the lines' hashes.
*Winnowing.* In each window of ``guarantee - noise`` words that begins at a line, the
smallest gram hash is selected, the rightmost of equal ones. Two documents that share a
run of at least ``guarantee`` words have a window in common inside it, so they select
the same gram.
*Join.* Each selected gram is joined to its first place in the corpus, by (doc_id, hash of
the text, line): as many rows as selected grams, however often one occurs.
*Extension.* From such a pair the match grows both ways while lines agree: lines are compared in
blocks around each pair, and only the matches that reach the border of these go on, by twice as many blocks each time.
*Deletion.* The lines of every match go, but for its first place.

Defined cases: null and empty texts come back as they are; rows with the same doc_id and
text are one document and lose the same lines; a null doc_id counts as the smallest; a
run that repeats within a document keeps its first copy; a document all of whose lines
go has the empty text; an empty table gives an empty table; other columns are carried
unchanged, and n_chars, where present, follows the text; a column of the name of the count
stays, and the count gets a fresh name. A text of very many lines is as many rows; a very
long line is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisonde.llm.common import filter_of, fresh, split_by, written

#: Words of a run that is found for certain, words of a gram, and lines that are compared at once around a seed.
GUARANTEE, NOISE, EXTEND = 50, 25, 64


def _id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))


def once(docs: DataFrame, text: str) -> DataFrame:
    """(id, h, text) of each different document with a text. Only rows that repeat are shuffled, after one of each was picked on the map side."""
    slim = docs.where(F.col(text) != "").select(_id(docs).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    key = F.xxhash64("id", "h")
    twice = written(slim.groupBy("id", "h").count().where("count > 1").select(key.alias("k")), "repeats")
    again, single = split_by(slim, key, filter_of(twice, F.col("k")))
    return single.unionByName(again.groupBy("id", "h").agg(F.first("text").alias("text")))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, h, i, pos, lh, n): the non-blank lines of each different document; i counts them, pos counts all lines."""
    parts = F.transform(F.split("text", "\n", -1), lambda x, p: F.struct(p.alias("pos"), F.trim(x).alias("line")))
    each = once(docs, text).select("id", "h", F.posexplode(F.filter(parts, lambda x: x["line"] != "")).alias("i", "x"))
    return each.select("id", "h", "i", "x.pos", F.unhex(F.md5("x.line")).alias("lh"), F.size(F.split("x.line", " +")).alias("n"))


def selected(found: DataFrame, guarantee: int = GUARANTEE, noise: int = NOISE) -> DataFrame:
    """(id, h, i, gram): the grams that winnowing selects."""
    doc = Window.partitionBy("id", "h")
    begun = found.withColumn("s", F.sum("n").over(doc.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    near = doc.orderBy("s").rangeBetween(0, noise - 1)
    grams = begun.select("id", "h", "i", "s", F.sum("n").over(near).alias("size"), F.collect_list("lh").over(near).alias("g")).where(F.col("size") >= noise)
    grams = grams.select("id", "h", "i", "s", F.unhex(F.md5(F.array_join(F.transform("g", F.hex), ","))).alias("gram"))
    least = F.min(F.struct("gram", (-F.col("i")).alias("back"))).over(doc.orderBy("s").rangeBetween(0, guarantee - noise - 1))
    return grams.select("id", "h", least.alias("m")).select("id", "h", (-F.col("m.back")).alias("i"), "m.gram").distinct()


def repeated(found: DataFrame, guarantee: int = GUARANTEE, noise: int = NOISE) -> DataFrame:
    """(id, h, pos) of the lines to delete."""
    found = written(found, "lines")
    grams = written(selected(found, guarantee, noise), "grams")
    firsts = grams.groupBy("gram").agg(F.min(F.struct("id", "h", "i")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("gram", "f")
    seeds = grams.join(firsts, "gram").where(F.struct("id", "h", "i") > F.col("f"))
    seeds = seeds.select("id", "h", "i", F.col("f.id").alias("fid"), F.col("f.h").alias("fh"), (F.col("i") - F.col("f.i")).alias("diag"))
    seeds = written(seeds, "seeds")
    pair = ["id", "h", "fid", "fh", "diag"]
    block = F.floor(F.col("i") / EXTEND)
    twice = written(found.groupBy("lh").count().where("count > 1").select(F.xxhash64("lh").alias("k")), "twice")
    common, _ = split_by(found, F.xxhash64("lh"), filter_of(twice, F.col("k")))  # other lines cannot be part of a match
    ours = common.select("id", "h", block.alias("block"), "i", "pos", "lh")
    theirs = common.select(F.col("id").alias("fid"), F.col("h").alias("fh"), F.col("i").alias("fi"), F.col("lh").alias("flh"))
    near = written(seeds.select(*pair, F.explode(F.array(*[block + F.lit(k) for k in (-1, 0, 1)])).alias("block")).distinct(), "blocks")
    equal = _equal(near, ours, theirs).join(seeds.select(*pair, "i", F.lit(1).alias("seed")), [*pair, "i"], "left")
    equal = equal.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*pair).orderBy("i")))
    hit = F.max("seed").over(Window.partitionBy(*pair, "run"))
    hits = written(equal.withColumn("hit", hit).where("hit = 1").select(*pair, "run", "i", "pos"), "hits")
    ends = hits.groupBy(*pair, "run").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    below = F.when((F.col("lo") % EXTEND == 0) & (F.col("lo") > 0), F.struct(F.lit(-1).alias("way"), F.col("lo").alias("at"), (F.floor(F.col("lo") / EXTEND) - 1).alias("block")))
    above = F.when(F.col("hi") % EXTEND == EXTEND - 1, F.struct(F.lit(1).alias("way"), F.col("hi").alias("at"), (F.floor(F.col("hi") / EXTEND) + 1).alias("block")))
    open_ = ends.select(*pair, F.explode(F.array_compact(F.array(below, above))).alias("x")).select(*pair, "x.*").distinct()
    open_ = written(open_.join(near, [*pair, "block"], "left_anti").drop("block"), "open")  # only where the next block has not been compared
    found, blocks = hits.select("id", "h", "pos"), 1
    while not open_.isEmpty():
        more = written(_continued(open_, ours, theirs, blocks), "further")
        found = found.unionByName(more.select("id", "h", "pos"))
        whole = more.groupBy(*pair, "way", "at").agg(F.max("k").alias("k")).where(F.col("k") == blocks * EXTEND)
        open_, blocks = written(whole.select(*pair, "way", (F.col("at") + F.col("way") * F.col("k")).alias("at")), "open"), 2 * blocks
    return found.distinct()


def _equal(asked: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The lines of the blocks asked for that are those of the other document."""
    lines = asked.join(ours, ["id", "h", "block"]).withColumn("fi", F.col("i") - F.col("diag"))
    return lines.join(theirs, ["fid", "fh", "fi"]).where("lh = flh")


def _continued(open_: DataFrame, ours: DataFrame, theirs: DataFrame, blocks: int) -> DataFrame:
    """open_ (ends of matches at a block's border) with each line (pos, k-th from there) by which they go on within so many blocks.

    Only lines of the blocks and documents asked for, as filters tell, are shuffled.
    """
    next_ = F.floor(F.col("at") / EXTEND) + F.col("way")
    reach = F.sequence(next_, F.greatest(next_ + F.col("way") * (blocks - 1), F.lit(0).cast("long")))
    asked = open_.withColumn("block", F.explode(F.when(next_ >= 0, reach)))
    here, there = F.xxhash64("id", "h", "block"), F.xxhash64("fid", "fh")
    ours, _ = split_by(ours, here, filter_of(asked.select("id", "h", "block").distinct(), here))
    theirs, _ = split_by(theirs, there, filter_of(open_.select("fid", "fh").distinct(), there))
    ordered = Window.partitionBy("id", "h", "fid", "fh", "diag", "way", "at").orderBy("k")
    equal = _equal(asked, ours, theirs).withColumn("k", F.col("way") * (F.col("i") - F.col("at")))
    return equal.withColumn("rn", F.row_number().over(ordered)).where("rn = k").drop("rn")


def dedup_lines(docs: DataFrame, text: str = "text", guarantee: int = GUARANTEE, noise: int = NOISE, count_into: str | None = None) -> DataFrame:
    """docs without later copies of repeated runs; count_into names a column for the number of lines deleted."""
    gone = repeated(lines(docs, text), guarantee, noise).groupBy("id", "h").agg(F.collect_list("pos").alias("gone"))
    gone = written(gone, "gone")
    i, h, g = fresh(docs, "gone_id", "gone_h", "gone_lines")
    touched, untouched = split_by(docs, F.xxhash64(_id(docs), F.xxhash64(docs[text])), filter_of(gone, F.xxhash64("id", "h")))
    gone = gone.toDF(i, h, g)
    out = touched.join(gone, (_id(touched) == F.col(i)) & (F.xxhash64(touched[text]) == F.col(h)), "left")
    stay = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, p: ~F.array_contains(F.col(g), p)), "\n")
    out = out.withColumn(text, F.when(F.col(g).isNull(), F.col(text)).otherwise(stay))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(g).isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType)))
    if count_into:
        (name,) = fresh(docs, count_into)
        out = out.withColumn(name, F.coalesce(F.size(g), F.lit(0)).cast("long"))
        untouched = untouched.withColumn(name, F.lit(0).cast("long"))
    return out.drop(i, h, g).unionByName(untouched)
