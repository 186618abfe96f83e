"""Versioned lists of what is live in a folder, committed whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from .scratch import hadoop_path


class Manifest:
    """``<path>/v<number>``: JSON rows of ``schema`` (whose first column is ``version``).

    A version is written aside and renamed: the rename fails if another writer was first, and readers
    see the old or the new version.  It needs a file system whose rename is atomic (HDFS, a local
    disk); on a bare object store put a committer with conditional writes under it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.names = [x.split()[0] for x in schema.split(", ")]

    def listed(self, folder: str) -> list[tuple[str, int, int]]:
        """(name, bytes, milliseconds of the last change) of what a folder holds."""
        p, fs = hadoop_path(self.spark, folder)
        if not fs.exists(p):
            return []
        return [(x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(p)]

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n, _, _ in self.listed(self.path) if n[0] == "v")

    def version(self) -> int:
        return max(self.versions(), default=0)

    def rows(self, version: int | None = None) -> list[dict]:
        """Rows of the newest version, or of an older one: a few a run, whatever the data."""
        v = self.version() if version is None else version
        if not v:
            return []
        return [r.asDict() for r in self.spark.read.schema(self.schema).json(f"{self.path}/v{v:08d}").collect()]

    def commit(self, rows: list[dict], base: int) -> None:
        """Makes version base + 1, or fails if it exists."""
        aside, final = f"{self.path}/.{uuid.uuid4().hex}", f"{self.path}/v{base + 1:08d}"
        self.spark.createDataFrame([tuple((r | {"version": base + 1})[n] for n in self.names) for r in rows], self.schema).coalesce(1).write.json(aside)
        jvm = self.spark._jvm
        src, fs = hadoop_path(self.spark, aside)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(src).toUri(), fs.getConf())
        flags = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(fs.makeQualified(src), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(final)), flags)
