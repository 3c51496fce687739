"""Tables that cut lineage: written to the folder that driver and executors share, and read again.

The folder is the session's ``spark.checkpoint.dir``; only where it is unset (tests, notebooks) one is made, and only for a
local master: executors on other machines would not see it.
A written table survives the loss of an executor, which a local checkpoint does not.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of an Arrow batch: bounds what a Python worker holds at once, long texts included.
ARROW_ROWS = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


_held: dict = {}


def held(key, make):
    """A worker's one large object, made once and reused by its tasks; the one of another key is let go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Called where a task has a model of its own: a worker outlives a stage, and should not keep what the last one needed."""
    _held.clear()


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches and lets Python workers import this package, wherever it was imported from.

    The bound holds for the session from then on, as results are worked out after an operator has returned; all operators
    set the same one, and a lower one that the session has stays.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= ARROW_ROWS:
        spark.conf.set(_BATCH, str(ARROW_ROWS))
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Larger batches for short rows, for what is worked out within; then what the session had."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or else the checkpoint folder of the context, or else a new one on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        if not context.master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {context.master})")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vectide-"))
        at = context._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def spread(df: DataFrame, key: str, rows: int, per_task: int) -> DataFrame:
    """df dealt out by key so that a task has about per_task of its rows: for small tables that fan out in what follows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)), key)


class Scratch:
    """Written tables of one run of an operator, under a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/vectide-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        atexit.register(self.clear)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """df as a table that was written and is read again."""
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._vectide_path = path
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Kept tables of one schema as one."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._vectide_path for t in tables])

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for t in tables:
            self._delete(getattr(t, "_vectide_path", None))

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended; its folder then goes with the cluster's clean-up
            pass

    def _delete(self, path: str | None) -> None:
        if path and self.spark.sparkContext._jsc:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A column as text that Python can read: bytes that aren't UTF-8, which a file may hold, become U+FFFD."""
    return F.make_valid_utf8(F.col(column).cast("string"))
