"""Exact deduplication by a log-structured index of digests, in DataFrame operations only.

*Flush.* Each input partition is a memtable: its (digest, identifier) rows are sorted
by digest within the partition and written as one run of level 0, a Parquet file with a
bloom filter on the digest, so a lookup of a few digests skips runs without them.
*Compaction.* When a level has ``FANOUT`` folders of runs, or at the end, they are merged
into the next level: per digest the identifier that stays (smallest or largest) and the number
of rows. Merging groups by digest, with partial sums on the map side, so a digest that a third of all rows
share is one row per task in the shuffle; the merged runs are sorted and have filters again.
*Probing.* Digests with more than one row are hits. A bloom filter of all hits, built by
``bit_or``, tells which rows of the runs can be copies: the others are settled where they
are, and only possible copies meet the hits in a shuffle.
*Verification.* The texts of possible copies are grouped by digest and bytes. Only where
one digest stands for several texts does the answer come from the bytes.

Defined cases: a null text counts as the empty text, and all empty texts are equal;
repeated rows (same doc_id and text) are copies like any other; a null doc_id ranks
below all others when the largest stays and above all when the smallest stays; a
group of null identifiers only keeps null; very long texts are compared whole; an empty
table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisonde.llm.common import filter_of, shared_dir, split_by, written

#: Folders of runs that a level holds before they are merged into the next one.
FANOUT = 8


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


@dataclass
class Index:
    """An index over batches of documents: levels of folders, each with sorted runs of (digest, id, n)."""

    spark: SparkSession
    schema: str
    keep: str = "largest"
    path: str = ""
    levels: list[list[str]] = field(default_factory=lambda: [[]])

    def __post_init__(self) -> None:
        if self.keep not in ("largest", "smallest"):
            raise ValueError("keep is largest or smallest")
        self.path = self.path or f"{shared_dir(self.spark)}/index-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame, level: int) -> None:
        folder = f"{self.path}/level-{level}-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(folder)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(folder)

    def flush(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> None:
        """Adds a batch: a run per partition. Full levels are merged."""
        self._write(docs.select(_digest(text).alias("digest"), F.col(key).alias("id"), F.lit(1).cast("long").alias("n")), 0)
        for level, folders in enumerate(self.levels):
            if len(folders) >= FANOUT:
                self.compact(level)

    def read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def merged(self, folders: list[str]) -> DataFrame:
        """One row per digest: the identifier that stays (both functions skip nulls) and the number of rows."""
        best = F.max if self.keep == "largest" else F.min
        return self.read(folders).groupBy("digest").agg(best("id").alias("id"), F.sum("n").alias("n"))

    def compact(self, upto: int) -> None:
        """Merges the runs of all levels up to this one into a folder of the next."""
        folders = [f for level in self.levels[: upto + 1] for f in level]
        self._write(self.merged(folders), upto + 1)
        for level in self.levels[: upto + 1]:
            level.clear()

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """One row for each of a few digests that the index has; sorted runs and their filters let the scan skip the rest."""
        wanted = F.col("digest").isin([bytearray(d) for d in digests])
        best = F.max if self.keep == "largest" else F.min
        return self.read([f for level in self.levels for f in level]).where(wanted).groupBy("digest").agg(best("id").alias("id"), F.sum("n").alias("n"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "largest") -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of several rows with the identifier that stays, all count as kept rows of one
    document.
    """
    ids = docs.schema[key].dataType.simpleString()
    index = Index(docs.sparkSession, f"digest binary, id {ids}, n bigint", keep)
    index.flush(docs, text, key)
    runs = index.read(index.levels[0])
    index.compact(0)
    hits = index.read(index.levels[1]).where("n > 1").select("digest", F.col("id").alias("keep"), "n")
    hashed = F.xxhash64("digest")
    bloom = filter_of(hits, hashed)
    copies, single = split_by(runs.select("digest", "id"), hashed, bloom)
    own = docs.select(_digest(text).alias("digest"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("bytes"))
    candidates, _ = split_by(own, hashed, bloom)
    best = F.max if keep == "largest" else F.min
    verified = candidates.groupBy("digest", "bytes").agg(best("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    texts = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    clashing = written(texts.where("texts > 1").select("digest"), "clashing")
    clash = not clashing.isEmpty()
    if clash:  # different texts under one digest: these rows are told apart by their bytes
        apart = own.join(clashing, "digest", "left_semi").join(verified, ["digest", "bytes"]).select("digest", "id", "keep", "n")
        copies, single = (x.join(clashing, "digest", "left_anti") for x in (copies, single))
    found = copies.join(hits, "digest", "left")
    one = F.lit(1).cast("long")
    found = found.select("digest", "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"), F.coalesce("n", one).alias("n"))
    found = found.unionByName(single.select("digest", "id", F.col("id").alias("keep"), one.alias("n")))
    if clash:
        found = found.unionByName(apart)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
