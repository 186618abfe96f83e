"""Reports over findings, and the rhythm of sentence lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions.text import sentences, word_count
from proselake.operators.detect import findings


def rhythm(docs: DataFrame, most: float = 0.22, least: int = 8, band: float = 0.25) -> DataFrame:
    """Sentence lengths of documents of at least ``least`` sentences: mean, coefficient of variation, uniform or
    not, and the longest run of sentences within ``band`` of the mean (its first place and length)."""
    lengths = F.filter(F.transform(sentences(F.col("text")), lambda s: word_count(s["text"])), lambda n: n > 0)
    d = docs.select("doc_id", lengths.alias("n")).where(F.size("n") >= least)
    mean = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("n")
    d = d.withColumn("mean", mean)
    var = F.aggregate("n", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("n")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("at"))

    def step(a, x):
        run = F.when(F.abs(x - F.col("mean")) <= band * F.col("mean"), a["run"] + 1).otherwise(0)
        better = run > a["best"]
        return F.struct((a["i"] + 1).alias("i"), run.alias("run"), F.when(better, run).otherwise(a["best"]).alias("best"), F.when(better, a["i"] - run + 1).otherwise(a["at"]).alias("at"))

    d = d.withColumns({"cv": F.sqrt(var) / F.col("mean"), "beat": F.aggregate("n", zero, step)})
    return d.select("doc_id", F.size("n").cast("long").alias("n_sentences"), F.round("mean", 6).alias("mean_words"), F.round("cv", 6).alias("cv"), (F.col("cv") < most).alias("uniform"), F.col("beat.at").cast("long").alias("run_at"), F.col("beat.best").cast("long").alias("run_length"))


def tenth(x: Column) -> Column:
    """Rounded half up to one place."""
    return F.floor(x * 10 + 0.5) / 10


def report(docs: DataFrame, *keep: str) -> DataFrame:
    """Per document: words, sentences, findings by severity and per 1000 words, and columns to keep; one scan, no shuffle."""
    f = findings(docs)
    count = lambda level: F.size(F.filter("found", lambda x: x["severity"] == level)).cast("long")
    out = f.select("doc_id", *keep, word_count(F.col("text")).cast("long").alias("n_words"), F.size("sents").cast("long").alias("n_sentences"), *(count(s).alias(f"{s}_count") for s in ("error", "warn", "info")))
    total = F.col("error_count") + F.col("warn_count") + F.col("info_count")
    return out.withColumn("per_thousand", F.when(F.col("n_words") > 0, tenth(1000 * total / F.col("n_words"))).otherwise(0.0))

