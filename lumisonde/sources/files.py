"""Readers and writers of clips, manifests, feature tables and reports."""

from __future__ import annotations

import io
import tarfile
import wave
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that describe a segment and are no features. Fixed values.
SEGMENT_COLUMNS = ("segment_id", "segment_index", "start_time", "end_time", "duration")


def scan(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, size, modified, md5, label, split) of files below a folder; label and split come from the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select(
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        F.md5("content").alias("md5"),
        F.when(F.contains("path", F.lit("/fake/")), 1).when(F.contains("path", F.lit("/real/")), 0).alias("label"),
        F.nullif(F.regexp_extract("path", "/(train|val|test)/", 1), F.lit("")).alias("split"),
    )


def totals(files: DataFrame) -> DataFrame:
    """Number and bytes of files, and of different contents."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_distinct("md5").alias("contents"))


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path, size and time a manifest does not have."""
    return files.join(manifest.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def pcm(raw: bytes) -> tuple[int, list[float]] | None:
    """Rate and mono samples in [-1, 1] of a WAV file of 8, 16 or 32-bit PCM; None if it is no such file."""
    try:
        with wave.open(io.BytesIO(raw)) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            data = w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width not in (1, 2, 4):
        return None
    x = np.frombuffer(data, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(float)
    x = (x - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1)
    return rate, x.reshape(-1, channels).mean(1).tolist()


def clips(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rate, samples) of WAV files; unreadable ones have null samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pcm(raw) or (None, None) for raw in b["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["path"], pa.array([r for r, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.float64()))], names=["path", "rate", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, rate int, samples array<double>")


def validity(clips_: DataFrame, rate: int = 16000) -> DataFrame:
    """The first defect of a clip, or ok: corrupted, too_short (1 s), too_long (30 s), nan_inf, silent; and whether its rate is wrong."""
    x, r = F.col("samples"), F.col("rate")
    seconds = F.size(x) / r
    bad = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    level = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))
    status = F.when(x.isNull() | (F.size(x) == 0), "corrupted").when(seconds < 1, "too_short").when(seconds > 30, "too_long").when(bad, "nan_inf").when(level < 10 ** (-50 / 20), "silent").otherwise("ok")
    return clips_.withColumns({"status": status, "wrong_rate": r != rate})


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature columns of CSV files, without those that describe segments; rows that do not parse hold nulls."""
    out = spark.read.csv(folder, header=True, inferSchema=True, mode="PERMISSIVE")
    return out.drop(*[c for c in SEGMENT_COLUMNS if c in out.columns])


def save_features(rows: DataFrame, folder: str, places: int = 6) -> None:
    """CSV with floating-point columns rounded half to even."""
    made = {c: F.bround(c, places) for c, t in rows.dtypes if t in ("double", "float")}
    rows.withColumns(made).write.mode("overwrite").csv(folder, header=True)


def save_by_category(rows: DataFrame, keys: Sequence[str], folder: str) -> None:
    """Long form (keys, name, value), partitioned by the part of a feature's name before its first underscore."""
    names = [c for c in rows.columns if c not in keys]
    long = rows.unpivot(list(keys), names, "name", "value").withColumn("category", F.split_part("name", F.lit("_"), F.lit(1)))
    long.write.mode("overwrite").partitionBy("category").parquet(folder)


def save_splits(rows: DataFrame, folder: str) -> None:
    """Parquet partitioned by split, so a reader of one split skips the others."""
    rows.write.mode("overwrite").partitionBy("split").parquet(folder)


def columns_like(spark: SparkSession, path: str, part: str) -> list[str]:
    """Columns of a Parquet table whose names contain a text; reads the schema only."""
    return [c for c in spark.read.parquet(path).schema.names if part.lower() in c.lower()]


def one_hot_label(v: str) -> Column:
    """The place of an array's largest value, from 0."""
    return F.array_position(F.col(v), F.array_max(v)) - 1


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small table as text, of at most so many rows."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows.limit(most).collect())])


# -- logs as folders of Parquet ---------------------------------------------------------------


def append(rows: DataFrame, folder: str) -> None:
    """Insertion: new files beside the old ones."""
    rows.write.mode("append").parquet(folder)


def delete_all(spark: SparkSession, folder: str) -> None:
    """Leaves a table without rows."""
    schema = spark.read.parquet(folder).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)


def seeded(rows: DataFrame, first: DataFrame) -> DataFrame:
    """rows, or the first rows of a new table if there are none; looks at one row at most."""
    return first.select(*rows.columns) if rows.isEmpty() else rows


def by_id(rows: DataFrame, ids: Sequence[int], key: str = "id") -> DataFrame:
    """A row for each id asked for, with found telling whether it exists; the condition on the key reaches the scan."""
    asked = rows.sparkSession.createDataFrame([(i,) for i in ids], f"{key} long")
    hits = rows.where(F.col(key).isin(list(ids))).withColumn("found", F.lit(True))
    return F.broadcast(asked).join(hits, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def export_csv(rows: DataFrame, folder: str, order: Sequence[Column]) -> None:
    """CSV with a header, in order from file to file."""
    form = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    rows.orderBy(*order).write.mode("overwrite").option("timestampFormat", form).option("timestampNTZFormat", form).csv(folder, header=True)


def save_table(rows: DataFrame, folder: str) -> None:
    """A table as CSV and as JSON lines, for instance of speakers or predictions."""
    rows.write.mode("overwrite").csv(f"{folder}/csv", header=True)
    rows.write.mode("overwrite").json(f"{folder}/jsonl")


def first_rows(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """So many rows of a folder of shards; shards beyond them are not read."""
    return spark.read.parquet(folder).limit(most)


def members(spark: SparkSession, folder: str, most: int = 1 << 28) -> DataFrame:
    """(archive, member, safe, size, content) of the files in all ZIP and TAR archives under a folder.

    A member is unsafe if its name is absolute, leads out of the folder it would be written to, or it is a link; its content is null, as is that of members over ``most`` bytes.
    """

    def safe(name: str) -> bool:
        parts = name.replace("\\", "/").split("/")
        return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(archive: str, name: str, good: bool, size: int, read) -> pa.RecordBatch:
            body = read() if good and size <= most else None
            return pa.RecordBatch.from_pylist([{"archive": archive, "member": name, "safe": good, "size": size, "content": body}], schema)

        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("safe", pa.bool_()), ("size", pa.int64()), ("content", pa.binary())])
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                if path.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for i in z.infolist():
                            if not i.is_dir():
                                yield row(path, i.filename, safe(i.filename) and (i.external_attr >> 28) != 0xA, i.file_size, lambda z=z, i=i: z.read(i))
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        for i in t:
                            if not i.isdir():
                                yield row(path, i.name, safe(i.name) and i.isreg(), i.size, lambda t=t, i=i: t.extractfile(i).read())

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,tar,tar.gz,tgz}").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "content").mapInArrow(run, "archive string, member string, safe boolean, size long, content binary")


def save_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def load_json(spark: SparkSession, folder: str, default: DataFrame) -> DataFrame:
    """The rows of a folder of JSON lines, with the columns and types of default; default itself where there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(default.schema).json(folder) if there else default
