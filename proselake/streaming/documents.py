"""Documents that change while they are checked: a stream of versions in, the findings of the newest ones out.

A version is (doc_id, generation, content).  Versions of a document that come within one trigger interval become one
(debouncing), and those that are no newer than one already taken are dropped: the newest generation of each document is
keyed state in the checkpoint.  A version that can't be read gives a row with an error and stops nothing.  Each batch
writes a folder of its own number, which a repeated batch writes again, so a result is there once whatever happens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from proselake.operators import rules

VERSION = "doc_id long, generation long, content binary"


class NewestGeneration(StatefulProcessor):
    """Lets a key's newest version of a batch through if it is newer than all before; of equal ones the first."""

    def __init__(self, forget_after_ms: int | None = None):
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("generation", "generation long", self.forget_after_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        taken = self.newest.get()[0] if self.newest.exists() else None
        best = None
        for part in rows:
            part = part[part["generation"].notna()]
            if len(part):
                top = part.loc[part["generation"].idxmax()]
                if best is None or top["generation"] > best["generation"]:
                    best = top
        if best is not None and (taken is None or best["generation"] > taken):
            self.newest.update((int(best["generation"]),))
            yield pd.DataFrame([(key[0], int(best["generation"]), best["content"])], columns=["doc_id", "generation", "content"])

    def close(self) -> None:
        pass


def newest_versions(stream: DataFrame) -> DataFrame:
    """The versions of a stream that are the newest of their document when their batch comes."""
    return stream.select("doc_id", "generation", "content").groupBy("doc_id").transformWithStateInPandas(NewestGeneration(), VERSION, "Append", "None")


def latest(versions: DataFrame) -> DataFrame:
    """The batch twin: of each document the row of the greatest generation; rows without one don't count."""
    rest = [c for c in versions.columns if c != "doc_id"]
    return versions.where("generation is not null").groupBy("doc_id").agg(F.max_by(F.struct(*rest), "generation").alias("x")).select("doc_id", "x.*")


def checked(versions: DataFrame) -> DataFrame:
    """versions -> doc_id, generation, status (ok or runtime-error), error, n_words, error_count, warn_count, info_count,
    per_thousand.  Content that is no UTF-8 is a runtime error with null counts; null content counts as empty."""
    text = F.col("content").cast("string")
    sound = F.col("content").isNull() | F.is_valid_utf8(text)
    docs = versions.select("doc_id", "generation", F.when(~sound, "content is not valid UTF-8").alias("error"), F.when(sound, text).alias("text"))
    out = rules.report(docs, "generation", "error")
    known = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return out.select("doc_id", "generation", F.when(F.col("error").isNull(), "ok").otherwise("runtime-error").alias("status"), "error", *map(known, ("n_words", "error_count", "warn_count", "info_count", "per_thousand")))


def run_documents(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts checking a stream of versions into ``path``, from where ``checkpoint`` says: every so often ("2 seconds"), or
    once through all there is."""

    def put(batch: DataFrame, number: int) -> None:
        checked(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = newest_versions(stream).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def results(spark: SparkSession, path: str) -> DataFrame:
    """What has been found so far: of each document its newest generation."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("generation"), F.desc("batch")))
    return rows.withColumn("place", place).where("place = 1").drop("place", "batch")
