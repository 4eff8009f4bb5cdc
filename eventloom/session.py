"""Session builder and scratch-space helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_SCRATCH = re.compile(r"-[0-9a-f]{12}$")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "eventloom", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the submitter's session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where that is unset, on a local master, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"eventloom-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def _shuffles_end_with_the_write(spark: SparkSession):
    """Shuffle files of a written table go when it is there, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables written once to the shared folder and read back, so that lineage is cut and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        with _shuffles_end_with_the_write(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this engine's runs; results that read them end with them."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(root):
        for entry in files.listStatus(root):
            if _SCRATCH.search(entry.getPath().getName()):
                files.delete(entry.getPath(), True)
