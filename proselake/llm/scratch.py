"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Only a local master, where driver and executors are
    one process, may go without: it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "proselake-shared")


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def opened() -> list[str]:
    """The folders that operators called by this thread have written to and not yet given back."""
    if not hasattr(_roots, "every"):
        _roots.every = []
    return _roots.every


def release(spark: SparkSession, roots: list[str] | None = None) -> None:
    """Deletes intermediate folders (of this thread's calls so far), once the results that read them are written."""
    for root in list(opened() if roots is None else roots):
        p, fs = hadoop_path(spark, root)
        fs.delete(p, True)
        if root in opened():
            opened().remove(root)


class Scratch:
    """Written tables that cut lineage: a lost executor costs a re-read, not a recomputation.

    ``put`` writes, reads back, and lets Spark's cleaner remove the shuffle files of what it wrote;
    ``drop`` deletes tables that no later step needs.  What the returned DataFrames still read is
    deleted by ``release`` after they have been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        opened().append(self.root)

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.sweep()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            p, fs = hadoop_path(self.spark, t._scratch_path)
            fs.delete(p, True)

    def sweep(self) -> None:
        """Shuffles that nothing refers to any more are removed at the JVM's next collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
