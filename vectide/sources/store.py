"""Single files on any store that Spark reads: through its Hadoop file systems, on the driver, a bounded piece at a time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

PIECE = 16 << 20


def _at(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def size(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).getLen()


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path for open(), if the file lies on a mounted file system."""
    fs, p = _at(spark, path)
    whole = fs.makeQualified(p).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def read(spark: SparkSession, path: str, first: int = 0, n: int | None = None) -> bytes:
    """n bytes from `first` on, or all that follow."""
    return b"".join(pieces(spark, path, first, n))


def pieces(spark: SparkSession, path: str, first: int = 0, n: int | None = None) -> Iterable[bytes]:
    fs, p = _at(spark, path)
    left = fs.getFileStatus(p).getLen() - first if n is None else n
    stream = fs.open(p)
    try:
        stream.seek(first)
        while left > 0:
            got = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(PIECE, left)))
            yield got
            left -= len(got)
    finally:
        stream.close()


def write(spark: SparkSession, path: str, data: Iterable[bytes]) -> None:
    """A new file; an existing one is an error."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    out = fs.create(p, False)
    try:
        for d in data:
            for a in range(0, len(d), PIECE):
                out.write(bytearray(d[a : a + PIECE]))
    finally:
        out.close()


def make(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.mkdirs(p)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Renames; False if `to` exists or the store refuses."""
    fs, p = _at(spark, path)
    _, q = _at(spark, to)
    return not fs.exists(q) and fs.rename(p, q)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
