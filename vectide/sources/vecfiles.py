"""Vector files (S1-S3, S5, S7, S10, S11): read in parallel by offset, checked against their headers.

A file of fixed-width rows is split into row ranges, and each task reads its own bytes. Sizes and headers come through
Spark's Hadoop file systems. Ranges are read from mounted paths by open(), from other stores by the file systems that
PyArrow knows; a store that neither reads goes through Spark's binaryFile source, for files below 2 GB.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectide.errors import require
from vectide.session import share_code
from vectide.sources import store

#: Element type of each format, and whether the dimension stands before every row or once in a header.
FORMATS = {
    "fvecs": ("<f4", "row"),
    "bvecs": ("u1", "row"),
    "ivecs": ("<i4", "row"),
    "fbin": ("<f4", "file"),
    "f16bin": ("<f2", "file"),
    "u8bin": ("u1", "file"),
    "i8bin": ("i1", "file"),
    "u16bin": ("<u2", "file"),
    "u32bin": ("<u4", "file"),
}
QUERY_ONLY = ("i8bin", "u16bin", "u32bin")
TASK_BYTES = 64 << 20


def format_of(path: str, named: str | None = None) -> str:
    """The format named, or that of the extension; a file without one is fvecs."""
    kind = named or os.path.splitext(path)[1].lstrip(".").lower() or "fvecs"
    require(kind in FORMATS, "read", "unknown vector format", format=kind)
    return kind


def layout(path: str, kind: str, spark: SparkSession | None = None) -> tuple[int, int, int, int]:
    """(rows, dim, bytes before the first row, bytes of a row), checked against the size of the file.

    Without a session the path must be one for open().
    """
    require(store.is_file(spark, path) if spark else os.path.isfile(path), "read", "no such file", "NOT_FOUND", path=path)
    size = store.size(spark, path) if spark else os.path.getsize(path)
    dtype, where = FORMATS[kind]
    width = np.dtype(dtype).itemsize
    if spark:
        start = store.read(spark, path, 0, min(8, size))
    else:
        with open(path, "rb") as f:
            start = f.read(8)
    head = np.frombuffer(start[: len(start) // 4 * 4], "<u4")
    if where == "file":
        require(size >= 8, "read", "file is shorter than its header", "INVALID_DATA", path=path)
        rows, dim, skip, stride = int(head[0]), int(head[1]), 8, int(head[1]) * width
        require(dim > 0 and rows > 0 and size == skip + rows * stride, "read", "size doesn't match the header", "INVALID_DATA", path=path, rows=rows, dim=dim, size=size)
    else:
        require(size >= 4, "read", "file is empty", "INVALID_DATA", path=path)
        dim, skip = int(head[0]), 0
        stride = 4 + dim * width
        require(dim > 0 and size % stride == 0, "read", "size isn't a whole number of rows", "INVALID_DATA", path=path, dim=dim, size=size)
        rows = size // stride
    return rows, dim, skip, stride


def read_vectors(spark: SparkSession, path: str, kind: str | None = None, max_points: int | None = None, as_base: bool = False) -> DataFrame:
    """(id, vec) of a file; ids are row positions. max_points keeps a prefix."""
    kind = format_of(path, kind)
    require(not (as_base and kind in QUERY_ONLY), "read", "format is for queries only", "UNSUPPORTED", format=kind)
    require(max_points is None or max_points > 0, "read", "max_points must be positive")
    rows, dim, skip, stride = layout(path, kind, spark)
    rows = min(rows, max_points or rows)
    share_code(spark)
    opened = _opener(spark, path)
    if opened is None:
        return read_small(spark, path, kind).where(F.col("id") < rows)
    dtype, where = FORMATS[kind]
    step = max(1, TASK_BYTES // stride)

    def batches(frames):
        for f in frames:
            for first in f["id"]:
                n = min(step, rows - int(first))
                with opened() as file:
                    file.seek(skip + int(first) * stride)
                    raw = np.frombuffer(file.read(n * stride), "u1").reshape(n, stride)
                if where == "row":
                    require(bool((raw[:, :4].copy().view("<u4") == dim).all()), "read", "rows differ in dimension", "INVALID_DATA", path=path)
                    raw = raw[:, 4:]
                x = np.ascontiguousarray(raw).view(dtype).reshape(n, dim)
                for a in range(0, n, 4096):
                    part = x[a : a + 4096]
                    yield pd.DataFrame({"id": np.arange(int(first) + a, int(first) + a + len(part)), "vec": list(part.astype(np.float32 if "f" in dtype else np.int64))})

    ranges = spark.range(0, rows, step, numPartitions=max(1, min(10_000, -(-rows // step))))
    return ranges.mapInPandas(batches, f"id long, vec array<{'float' if 'f' in dtype else 'int' if dtype != '<u4' else 'bigint'}>")


def _opener(spark: SparkSession, path: str):
    """What opens the file on a worker, or None where only Spark reads the store."""
    local = store.local_path(spark, path)
    if local is not None:
        return lambda: open(local, "rb")

    def remote():
        from pyarrow.fs import FileSystem

        fs, p = FileSystem.from_uri(path)
        return fs.open_input_file(p)

    try:
        remote().close()
    except Exception:  # each library reports a store that it doesn't know in its own way
        return None
    return remote


def read_small(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(id, vec) through Spark's binaryFile source: for any store that Spark reads, one row per file, so below 2 GB."""
    kind = format_of(path, kind)
    dtype, where = FORMATS[kind]

    def batches(frames):
        for f in frames:
            for content in f["content"]:
                raw = np.frombuffer(content, "u1")
                dim = int(raw[:4].copy().view("<u4")[0]) if where == "row" else int(raw[4:8].copy().view("<u4")[0])
                if where == "row":
                    raw = raw.reshape(-1, 4 + dim * np.dtype(dtype).itemsize)[:, 4:]
                else:
                    raw = raw[8:]
                x = np.ascontiguousarray(raw).view(dtype).reshape(-1, dim)
                for a in range(0, len(x), 4096):
                    part = x[a : a + 4096]
                    yield pd.DataFrame({"id": np.arange(a, a + len(part)), "vec": list(part.astype(np.float32 if "f" in dtype else np.int64))})

    share_code(spark)
    kind_of = "float" if "f" in dtype else "int" if dtype != "<u4" else "bigint"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(batches, f"id long, vec array<{kind_of}>")


def from_array(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """S3: (id, vec) of a 2-D float32 or uint8 array."""
    require(isinstance(x, np.ndarray) and x.ndim == 2 and x.size > 0, "from_array", "a nonempty 2-D array is needed")
    require(x.dtype in (np.float32, np.uint8), "from_array", "base arrays must be float32 or uint8", dtype=str(x.dtype))
    flat = np.ascontiguousarray(x).ravel().astype(np.float32 if x.dtype == np.float32 else np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(flat))
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(x))), "vec": lists}))


def encoded(x: np.ndarray, kind: str) -> bytes:
    """Rows in a format, without what stands once before all rows."""
    dtype, where = FORMATS[kind]
    x = np.ascontiguousarray(x, dtype)
    if where == "file":
        return x.tobytes()
    head = np.full((len(x), 1), x.shape[1], "<u4").view("u1").reshape(len(x), 4)
    return np.hstack([head, x.view("u1").reshape(len(x), -1)]).tobytes()


def header(rows: int, dim: int, kind: str) -> bytes:
    return np.array([rows, dim], "<u4").tobytes() if FORMATS[kind][1] == "file" else b""


def write_vectors(path: str, x: np.ndarray, kind: str | None = None, spark: SparkSession | None = None) -> None:
    """Writes an array in a vector format, with a session on any store; refuses to overwrite."""
    kind = format_of(path, kind)
    data = (header(*x.shape, kind), encoded(x, kind))
    if spark:
        store.write(spark, path, data)
        return
    with open(path, "xb") as f:
        for d in data:
            f.write(d)


def convert(spark: SparkSession, source: str, path: str, kind: str | None = None, to: str | None = None, block: int = 1) -> None:
    """A file in another format, rows padded with zeros to a multiple of `block`; passes the driver 4096 rows at a time."""
    kind, to = format_of(source, kind), format_of(path, to)
    rows, dim, _, _ = layout(source, kind, spark)
    wide = dim + -dim % block

    def data():
        yield header(rows, wide, to)
        held: list = []
        for r in read_vectors(spark, source, kind).orderBy("id").toLocalIterator():
            held.append(r["vec"])
            if len(held) == 4096:
                yield encoded(np.pad(np.array(held), ((0, 0), (0, wide - dim))), to)
                held = []
        if held:
            yield encoded(np.pad(np.array(held), ((0, 0), (0, wide - dim))), to)

    store.write(spark, path, data())


def convert_hdf5(source: str, path: str, name: str = "train", kind: str | None = None, block: int = 1) -> None:
    """Writes a matrix of an HDF5 file in a vector format, padded with zeros; needs h5py, which is optional."""
    try:
        import h5py
    except ImportError:
        require(False, "convert", "h5py is not installed", "UNSUPPORTED")
    with h5py.File(source, "r") as f:
        x = np.asarray(f[name], np.float32)
    write_vectors(path, np.pad(x, ((0, 0), (0, -x.shape[1] % block))), kind)


def zero_pad(df: DataFrame, block: int) -> DataFrame:
    """Vec padded with zeros to a multiple of `block` coordinates."""
    short = (F.lit(block) - F.size("vec") % block) % block
    return df.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast(dict(df.dtypes)["vec"][6:-1]), short)))


def ground_truth(df: DataFrame, k: int, rows: int) -> DataFrame:
    """(query_id, rank, id) of ivecs rows (id, vec); their width must be constant, at least k and at most `rows`."""
    w = df.agg(F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"), F.max(F.array_max("vec")).alias("top"), F.min(F.array_min("vec")).alias("least")).first()
    require(w["low"] == w["high"] and k <= (w["low"] or 0) <= rows, "ground_truth", "row width must be constant, at least k and at most the number of rows", "INVALID_DATA", width=w["low"])
    require(0 <= w["least"] and w["top"] < rows, "ground_truth", "id out of range", "INVALID_DATA")
    return df.select(F.col("id").alias("query_id"), F.posexplode("vec").alias("p", "n")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("n").cast("long").alias("id"))
