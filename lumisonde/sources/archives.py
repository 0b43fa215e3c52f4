"""Archives of arrays (NPZ) as a Spark data source: a partition for each range of rows, read by seeking into the archive.

A member that is stored uncompressed is sought to directly; a compressed one is read up to its
range and no further, a piece at a time. Either way a task holds one batch of rows, so an archive may be of any size.
Files are opened through pyarrow's filesystems, so their path may be a URI of any that it knows.
"""

from __future__ import annotations

import ast
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, split string, row long, x array<double>, y int"


def _opened(path: str):
    from pyarrow import fs

    system, local = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return pa.PythonFile(system.open_input_file(local), mode="r")


def header(f) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type, shape and length of the header of an array at the start of an open member. Arrays of objects, or in column order, are refused."""
    start = f.read(8)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not an array")
    wide = start[6] > 1
    size = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))[0]
    said = ast.literal_eval(f.read(size).decode("latin1"))
    kind = np.dtype(said["descr"])
    if kind.hasobject or said["fortran_order"] and len(said["shape"]) > 1:
        raise ValueError("arrays of objects or in column order are not read")
    return kind, tuple(said["shape"]), 8 + (4 if wide else 2) + size


def rows_of(archive: zipfile.ZipFile, name: str, first: int, last: int) -> np.ndarray:
    """Rows first to last (exclusive) of a member; of an uncompressed one nothing before them is read."""
    with archive.open(f"{name}.npy") as f:
        kind, shape, begin = header(f)
        width = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        f.seek(begin + first * width)  # zipfile seeks in stored members, and reads on in others
        want = (last - first) * width
        raw = bytearray()
        while len(raw) < want:
            piece = f.read(min(1 << 20, want - len(raw)))
            if not piece:
                raise ValueError(f"{name} ends early")
            raw += piece
        return np.frombuffer(bytes(raw), kind).reshape(last - first, *shape[1:])


class Range(InputPartition):
    def __init__(self, path: str, split: str, x: str, y: str | None, first: int, last: int):
        self.path, self.split, self.x, self.y, self.first, self.last = path, split, x, y, first, last


class NpzReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.paths = options["path"].split("\n")
        self.split, self.rows, self.batch = options.get("split", "train"), int(options.get("rows", 65_536)), int(options.get("batch", 256))
        self.columns = columns

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            with _opened(path) as raw, zipfile.ZipFile(raw) as z:
                names = {n.removesuffix(".npy") for n in z.namelist()}
                for x in sorted(n for n in names if n == "X" or n.startswith("X_")):
                    with z.open(f"{x}.npy") as f:
                        count = header(f)[1][0]
                    y = "y" + x[1:]
                    out += [Range(path, x[2:] or self.split, x, y if y in names else None, a, min(a + self.rows, count)) for a in range(0, count, self.rows)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with _opened(part.path) as raw, zipfile.ZipFile(raw) as z:
            for a in range(part.first, part.last, self.batch):
                b = min(a + self.batch, part.last)
                made = {"path": lambda a=a, b=b: pa.array([part.path] * (b - a)), "split": lambda a=a, b=b: pa.array([part.split] * (b - a)), "row": lambda a=a, b=b: pa.array(np.arange(a, b))}

                def x(a: int = a, b: int = b) -> pa.Array:
                    v = rows_of(z, part.x, a, b).reshape(b - a, -1).astype(float)
                    return pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))

                def y(a: int = a, b: int = b) -> pa.Array:
                    if part.y is None:
                        return pa.array([-1] * (b - a), pa.int32())
                    v = rows_of(z, part.y, a, b)
                    return pa.array((v.argmax(1) if v.ndim == 2 and v.shape[1] > 1 else v.reshape(b - a)).astype(np.int32))  # one-hot rows name a class

                made |= {"x": x, "y": y}
                yield pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)


class NpzSource(DataSource):
    """Options: path (one or more, a line each), split (the name of plain X and y), rows (of a partition), batch, columns."""

    @classmethod
    def name(cls) -> str:
        return "npz_rows"

    def schema(self) -> str:
        kinds = dict(c.strip().split(" ", 1) for c in SCHEMA.split(","))
        return ", ".join(f"{c} {kinds[c]}" for c in self._columns())

    def _columns(self) -> list[str]:
        return self.options.get("columns", "path,split,row,x,y").split(",")

    def reader(self, schema) -> NpzReader:
        return NpzReader(dict(self.options), self._columns())


def read_rows(spark: SparkSession, folder: str, split: str = "train", rows: int = 65_536, columns: str = "path,split,row,x,y") -> DataFrame:
    """The rows of all archives under a folder; only the columns named are read from them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(folder).select("path")
    paths = [r.path for r in found.collect()]  # names of files, not what is in them
    if not paths:
        return spark.createDataFrame([], NpzSource({"columns": columns}).schema())
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz_rows").option("path", "\n".join(paths)).option("split", split).option("rows", rows).option("columns", columns).load()
