"""Size-tiered shards with a versioned manifest.  DataFrame operations only.

Arrivals are appended as runs of small immutable shards.  A run's tier is the power of ``fanout`` that its
bytes reach over ``least``; when ``fanout`` runs of one tier exist, they are merged into files of
about ``target`` bytes, and the merged run takes the tier of its own bytes.  Every change of the set of
live runs is a new manifest, committed by a rename that fails if another writer was first.  Merged
runs stay on disk, so that readers of an older version can finish, until ``vacuum`` removes them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .manifest import Manifest
from .scratch import Scratch, hadoop_path

MANIFEST = "version long, run string, tier int, rows long, bytes long, files long"


def free(name: str, taken: list[str]) -> str:
    """name, with as many underscores after it as make it no column's name."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


class ShardStore:
    """A folder with ``data/<run>/`` and ``manifest/v<number>/``.

    ``target``: bytes of a merged file.  ``fanout``: runs a merge takes.  ``least``: runs up to so many bytes are
    of tier 0.  ``retain``: seconds that ``compact`` leaves replaced runs for readers of older versions.
    """

    def __init__(self, spark: SparkSession, path: str, *, target: int = 128 << 20, fanout: int = 4, least: int = 1 << 20, retain: float = 7 * 86400):
        self.spark, self.path, self.target, self.fanout, self.least, self.retain = spark, path, target, fanout, least, retain
        self.manifest = Manifest(spark, f"{path}/manifest", MANIFEST)

    def version(self) -> int:
        return self.manifest.version()

    def live(self, version: int | None = None) -> list[dict]:
        """Rows of the newest manifest, or of an older one: one per run (tens, whatever the data)."""
        return self.manifest.rows(version)

    def commit(self, runs: list[dict], base: int) -> None:
        """Makes version base + 1, or fails if it exists."""
        self.manifest.commit(runs, base)

    def tier(self, size: int) -> int:
        tier = 0
        while size >= self.least * self.fanout ** (tier + 1):
            tier += 1
        return tier

    def _describe(self, run: str, rows: int) -> dict:
        files = [n for n in self.manifest.listed(f"{self.path}/data/{run}") if n[0].endswith(".parquet")]
        size = sum(n for _, n, _ in files)
        return {"run": run, "tier": self.tier(size), "rows": rows, "bytes": size, "files": len(files)}

    def append(self, arrivals: DataFrame, arrival: str) -> None:
        """One pass over the rows; each value of column ``arrival`` (few; null is one of them) becomes a run."""
        tag = uuid.uuid4().hex[:8]
        base, runs = self.version(), self.live()
        value = F.coalesce(F.md5(F.col(arrival).cast("string").cast("binary")), F.lit("null"))  # safe as a folder's name
        name = free("_run", arrivals.columns)
        arrivals.withColumn(name, F.concat(F.lit(f"{tag}-"), value)).write.mode("append").partitionBy(name).parquet(f"{self.path}/incoming/{tag}")
        schema = T.StructType([*arrivals.schema.fields, T.StructField(name, T.StringType())])
        counts = self.spark.read.schema(schema).parquet(f"{self.path}/incoming/{tag}").groupBy(F.col(name).alias("run")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: r["run"]):
            src, fs = hadoop_path(self.spark, f"{self.path}/incoming/{tag}/{name}={r['run']}")
            dst = hadoop_path(self.spark, f"{self.path}/data/{r['run']}")[0]
            fs.mkdirs(dst.getParent())
            if not fs.rename(src, dst):
                raise OSError(f"could not move {src} to {dst}; nothing is committed")
            runs.append(self._describe(r["run"], r["n"]))
        p, fs = hadoop_path(self.spark, f"{self.path}/incoming/{tag}")
        fs.delete(p, True)
        if counts:
            self.commit(runs, base)

    def compact(self) -> None:
        """Merges while a tier has ``fanout`` runs: its smallest ones, into one run of whole files."""
        while True:
            base, runs = self.version(), self.live()
            tiers: dict[int, list[dict]] = {}
            for r in sorted(runs, key=lambda r: (r["bytes"], r["run"])):
                tiers.setdefault(r["tier"], []).append(r)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if full is None:
                return
            old = tiers[full][: self.fanout]
            files = max(1, -(-sum(r["bytes"] for r in old) // self.target))
            run = f"merged-{uuid.uuid4().hex[:8]}"
            rows = self.spark.read.parquet(*(f"{self.path}/data/{r['run']}" for r in old))
            # Dealt by place in the scan, which is the same whenever a task is run again, so equal rows spread.
            rows.repartition(files, F.monotonically_increasing_id()).write.parquet(f"{self.path}/data/{run}")
            gone = {r["run"] for r in old}
            self.commit([r for r in runs if r["run"] not in gone] + [self._describe(run, sum(r["rows"] for r in old))], base)
            self.vacuum()

    def vacuum(self, retain: float | None = None) -> list[str]:
        """Deletes the runs that the newest version doesn't list and that are older than ``retain`` seconds:
        replaced ones, and what a writer left that failed before its commit."""
        keep = {r["run"] for r in self.live()}
        before = time.time() - (self.retain if retain is None else retain)
        gone = [name for name, _, changed in self.manifest.listed(f"{self.path}/data") if name not in keep and changed <= 1000 * before]
        for name in gone:
            p, fs = hadoop_path(self.spark, f"{self.path}/data/{name}")
            fs.delete(p, True)
        return gone

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of the newest version, or of an older one; None before the first commit."""
        runs = [r["run"] for r in self.live(version) if r["rows"]]
        return self.spark.read.parquet(*(f"{self.path}/data/{r}" for r in runs)) if runs else None


def shard(spark: SparkSession, docs: DataFrame, *, path: str | None = None, arrivals: int = 8, target: int = 64 << 20, fanout: int = 4, least: int = 1 << 20) -> DataFrame:
    """docs through a store: ``arrivals`` appends (by hash of doc_id, as feeds come in), then
    compaction; returns the rows of the committed version with their file's path in ``shard``.

    Every row comes back once, repeated rows as often as they came, nulls as they are; an empty
    table commits nothing and returns no rows.  Columns are kept, whatever their names; where one is
    named shard, the path comes as shard_.
    A store without a path of its own has no other readers: replaced runs go at once.
    """
    store = ShardStore(spark, path or f"{Scratch(spark, 'shards').root}/store", target=target, fanout=fanout, least=least, **({} if path else {"retain": 0}))
    arrival, where = free("_arrival", docs.columns), free("shard", docs.columns)
    store.append(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), arrival)
    store.compact()
    out = store.read()
    if out is None:
        return docs.withColumn(where, F.lit(None).cast("string")).limit(0)
    return out.select(*docs.columns, F.col("_metadata.file_path").alias(where))


def op4_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("shard").isNotNull().alias("sharded"))
