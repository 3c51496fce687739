"""Session helper: settings that the engine's plans count on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is left to the cluster."""
    b = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("VECTIDE_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return share_code(b.getOrCreate())


def share_code(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver did."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)
    return spark


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or on a local master in a temporary one."""
    from vectide.sources.store import make

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {spark.sparkContext.master})")
        root = tempfile.mkdtemp(prefix="vectide-")
        atexit.register(shutil.rmtree, root, True)
    path = f"{root.rstrip('/')}/work-{uuid.uuid4().hex[:12]}"
    make(spark, path)
    return path
