"""A corpus pipeline in five stages, each over all rows its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` writes each stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from proselake.deploy import ship
from proselake.llm.credentials import redact_secrets
from proselake.llm.langid import fit_languages, held_out, keep_identified
from proselake.llm.minhash import drop_near_duplicates
from proselake.llm.packing import pack
from proselake.llm.scratch import Scratch, opened, release
from proselake.llm.substrings import strip_repeats

#: Folders of the stage before, which its written result no longer reads.
_left = threading.local()


def _begin(spark: SparkSession) -> list[str]:
    """As each stage's docs are its predecessor's result, written and reread, what that one left can go."""
    ship(spark)
    release(spark, getattr(_left, "roots", []))
    _left.roots = []
    return opened().copy()


def _end(had: list[str], out: DataFrame) -> DataFrame:
    _left.roots = [r for r in opened() if r not in had]
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those with null text or without a letter.  Each row is judged
    by its own text; null and repeated doc_ids don't matter, an empty table stays empty."""
    had = _begin(spark)
    model = fit_languages(spark, docs.where(~held_out()).select("doc_id", "text", "lang"))
    return _end(had, keep_identified(docs, model))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least doc_id: five-word shingles,
    similarity 0.8 or more.  Rows with a null doc_id or without words stay; texts that share a
    doc_id are judged each for itself; an empty table stays empty."""
    had = _begin(spark)
    return _end(had, drop_near_duplicates(spark, docs, shingle=5, percent=80))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents of which nothing is left go.  A null
    doc_id is earlier than all others, rows with equal doc_ids are none earlier than another; texts
    without words and empty tables stay as they are."""
    had = _begin(spark)
    return _end(had, strip_repeats(spark, docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text.  Every row comes back once, judged by its own text; null and
    empty texts and empty tables stay as they are."""
    had = _begin(spark)
    return _end(had, redact_secrets(spark, docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024, a row per piece; null or empty text is the end id alone."""
    had = _begin(spark)
    return _end(had, pack(docs))


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secrets", secrets), ("packing", packing)]

#: SQL cannot express the stages; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))  # run's own folder is not one of a stage's
        if last is not None:
            scratch.drop(last)
        last = docs
    release(spark, _left.roots)
    _left.roots = []
    return docs
