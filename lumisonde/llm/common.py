"""What several text operators share: words, shared storage, column names."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the controls 9 to 13. bytes.split() splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """The lower-cased (A to Z only) words of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it; a new local one only where none is set and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumisonde-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Has Spark remove the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What queries have shuffled within goes as each ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back: cuts lineage and survives lost executors.

    What the query that writes it has shuffled is of no more use afterwards and is removed at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """A to Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sizes_fit(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no more than it needs to tell."""
    return df.limit(most + 1).count() <= most


def most_frequent(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the largest counts n, at most so many, and the others; counts of one power of 2^(1/8) stay together."""
    step = F.floor(8 * F.log2("n"))
    total = F.sum("rows").over(Window.orderBy(F.desc("step_")))  # a few hundred steps
    steps = table.groupBy(step.alias("step_")).agg(F.count(F.lit(1)).alias("rows")).withColumn("total", total)
    least = steps.where(F.col("total") <= most).agg(F.min("step_")).first()[0]
    return (table.where(step >= least), table.where(step < least)) if least is not None else (table.where("false"), table)


#: A filter has about so many bits for each key, and no more than MOST_BITS, so what is broadcast is at most 32 MB.
KEY_BITS, MOST_BITS = 16, 1 << 28


def _filter_bits(h: Column, bits: int) -> list[tuple[Column, Column]]:
    """The places of a hash in a filter: words, and bits within them."""
    spots = [F.pmod(x, F.lit(bits)) for x in (h, F.xxhash64(h))]
    return [(F.floor(x / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))) for x in spots]


Filter = tuple[DataFrame, int]


def filter_of(keys: DataFrame, key: Column) -> Filter:
    """A bloom filter of the hashes in a column of keys: one row with an array of words, and its number of bits."""
    spark = keys.sparkSession
    bits = min(MOST_BITS, max(1 << 12, 1 << (KEY_BITS * keys.count()).bit_length()))
    spots = keys.select(key.alias("h")).select(F.explode(F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in _filter_bits(F.col("h"), bits)])).alias("x"))
    every = spark.range(bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    merged = spots.select("x.w", "x.b").unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    whole = merged.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bloom_words_"))
    return written(whole, "filter"), bits


def split_by(df: DataFrame, h: Column, by: Filter) -> tuple[DataFrame, DataFrame]:
    """df's rows whose hash h may be in the filter, and those whose hash is certainly not, so that only the first need meet the keys in a shuffle.

    If there are more keys than MOST_BITS can tell apart, more rows may be in it; none is lost.
    """
    (w1, b1), (w2, b2) = _filter_bits(h, by[1])
    is_set = (F.get("bloom_words_", w1).bitwiseAND(b1) != 0) & (F.get("bloom_words_", w2).bitwiseAND(b2) != 0)
    may, cannot = (df.join(F.broadcast(by[0]), is_set, how) for how in ("left_semi", "left_anti"))
    return may, cannot


def packed(a: np.ndarray) -> bytes:
    """Numbers, byte by byte: all first bytes, then all second ones, and so on, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    """The numbers of packed, in an array that may be changed."""
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()
