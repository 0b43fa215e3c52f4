"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, and each segment has a table from its value to the codes
that have it. A search probes, in all tables, the values at distance 0 from its own,
then 1, then 2, and so on. After radius r, every code within
``segments * (r + 1) - 1`` bits has been met, since a farther one differs by more than r
bits in each segment at least. A query is done when its k-th verified distance is
within that bound; the others go on. A query whose k-th distance exceeds the bound of the
radius before by less than the number of segments probes only as many tables as it is short of.

Probes meet the tables in a shuffled, sorted join: neither side is small, and what Spark
takes for the size of the probes is that of the codes they come from.

Equal codes are one entry of the index, with the smallest identifiers of their group
(one more than k: a query does not find itself), so a vector that a third of all rows
share is one entry. Equal query codes are searched once.

Defined cases: rows with a null vector or identifier are not indexed; a null element
counts as not positive; vectors may be of any length but all of one; ties in distance
go to the smaller identifier; a repeated identifier is one neighbour, at its smallest
distance; with fewer than k other rows a query has that many neighbours; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisonde.llm.common import written

SEGMENT = 16
LANE = 64
#: Probes that a task makes; codes that ask are dealt out for that, as a few small files hold them all.
PROBES = 250_000


def sign_codes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, code): one bit for each element, set if it is positive, 64 to a long."""
    v = F.col(vector)
    lanes = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(v) - 1) / LANE).cast("int")),
        lambda lane: F.aggregate(
            F.transform(F.slice(v, lane * LANE + 1, LANE), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"),
            lambda a, b: a.bitwiseOR(b),
        ),
    )
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0)).select(F.col(key).cast("long").alias("id"), lanes.alias("code"))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two codes differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def _segments(code: Column, count: int) -> Column:
    """(seg, part) for each segment of a code."""
    per = LANE // SEGMENT
    part = lambda s: F.shiftrightunsigned(F.element_at(code, s // per + 1), SEGMENT * (s % per)).bitwiseAND(F.lit(2**SEGMENT - 1)).cast("int")
    return F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), part(s).alias("part")) for s in range(count)]))


def _masks(r: int) -> Column:
    """All values of a segment with r bits set, as one constant."""
    return F.split(F.lit(",".join(str(sum(1 << b for b in c)) for c in combinations(range(SEGMENT), r))), ",").cast("array<int>")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", bits: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest other rows of each query by Hamming distance of sign codes of so many bits."""
    codes = sign_codes(vectors, key, vector).distinct()
    first = Window.partitionBy("code").orderBy("id")
    groups = codes.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    groups = written(groups.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    wanted = written(sign_codes(queries, key, vector).distinct(), "queries")
    count = -(-bits // SEGMENT)
    entries = groups.select("code", "ids", _segments(F.col("code"), count).alias("s")).select(F.col("s.seg").alias("seg"), F.col("s.part").alias("key"), F.col("code").alias("near"), "ids")
    entries = written(entries, "segments")
    open_ = wanted.select("code").distinct().select("code", F.lit(None).cast("int").alias("worst"))
    found, done, left = None, None, open_.count()
    for r in range(SEGMENT + 1):
        parts = max(1, -(-left * count * comb(SEGMENT, r) // PROBES))
        own = open_.repartition(parts, "code").select("code", "worst", _segments(F.col("code"), count).alias("s"))
        own = own.where(F.col("worst").isNull() | (F.col("s.seg") <= F.col("worst") - count * r))
        probes = own.select("code", "worst", F.col("s.seg").alias("seg"), F.explode(F.transform(_masks(r), lambda m: m.bitwiseXOR(F.col("s.part")))).alias("key"))
        met = probes.join(entries.hint("merge"), ["seg", "key"])
        met = met.withColumn("d", distance(F.col("code"), F.col("near"))).where(F.col("worst").isNull() | (F.col("d") <= F.col("worst")))
        met = met.select("code", "d", F.explode("ids").alias("id"))
        if found is not None:
            met = met.unionByName(found)
        met = met.groupBy("code", "id").agg(F.min("d").alias("d"))
        met = met.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy("d", "id"))).where(F.col("rn") <= k + 1).drop("rn")
        found = written(met, "found")
        state = found.groupBy("code").agg(F.count("id").alias("n"), F.max("d").alias("worst")).select("code", F.when(F.col("n") == k + 1, F.col("worst")).alias("worst"))
        state = written(open_.select("code").join(state, "code", "left"), "state")
        covered = F.coalesce(F.col("worst") <= count * (r + 1) - 1, F.lit(r == SEGMENT))
        ready = found.join(state.where(covered).select("code"), "code", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        open_ = state.where(~covered)
        left = open_.count()
        if not left:
            break
        found = found.join(open_.select("code"), "code", "left_semi")
    pairs = wanted.toDF("query_id", "code").join(done, "code").where("query_id <> id").groupBy("query_id", "id").agg(F.min("d").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")
