"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between a trusted target and
the raw corpus.  DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 13
#: Least mean log-likelihood ratio of a document's n-grams (nats per n-gram).
THRESHOLD = -0.15
#: Weight of the raw distribution in the target's, in n-grams a bucket.
PRIOR = 4


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda w: w != "")


def _windows(words: Column, n: int) -> Column:
    spots = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    out = docs.withColumn("words", word_array(F.col("text")))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    out = out.withColumns({"lines": lines, "windows": _windows(F.col("words"), 5)})
    again = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("ranked", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), again))
    near = F.filter("ranked", lambda x, k: (x["h"] == F.get(F.col("ranked"), k - 1)["h"]) | (x["h"] == F.get(F.col("ranked"), k + 1)["h"]))
    out = out.withColumn("spots", F.sort_array(F.transform(near, lambda x: x["i"])))
    step = F.transform("spots", lambda x, k: F.least(F.lit(5), F.coalesce(x - F.get(F.col("spots"), k - 1), F.lit(5))))
    return out.select(
        *docs.columns,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def gram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of single words and word pairs, in the two halves of the table."""
    half = buckets // 2
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(half)).cast("int"))
    two = F.transform(_windows(words, 2), lambda h: (F.pmod(h, F.lit(half)) + half).cast("int"))
    return F.concat(one, two)


def _multinomial(docs: DataFrame, name: str, buckets: int) -> DataFrame:
    words = docs.select(word_array(F.col("text")).alias("words"))  # a column of its own, split once a document
    grams = words.select(F.explode(gram_buckets(F.col("words"), buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gram_weights(spark: SparkSession, target: DataFrame, raw: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log p_target - log p_raw of every bucket; ``buckets`` numbers, whatever the input.

    p_raw is add-one smoothed; the target has PRIOR * buckets more n-grams spread as p_raw, so that
    a bucket without evidence has the ratio 0.  Chance alone (a target of any size drawn from the
    raw corpus) moves the mean ratio by 1 / (8 * PRIOR) nats at most, to second order.
    """
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(_multinomial(target, "t", buckets), "bucket", "left").join(_multinomial(raw, "r", buckets), "bucket", "left").fillna(0)
    rows = both.orderBy("bucket").collect()
    t, r, prior = sum(x.t for x in rows), sum(x.r for x in rows) + buckets, PRIOR * buckets
    return [math.log((x.t * r / (x.r + 1) + prior) / (t + prior)) for x in rows]


def judge(spark: SparkSession, docs: DataFrame, trusted: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text), trusted (doc_id) -> doc_id, the base counts, base_failed, score, kept.

    Raw counts come from all documents, target counts from those in ``trusted``; score is the mean
    log-likelihood ratio of a document's word and word-pair buckets (0 without words).  kept: not
    base_failed and score >= threshold.  Without trusted documents every ratio is 0 and the base
    rules decide; with few it stays close to 0.  Null or empty text has no words and fails; null doc_ids are never trusted;
    repeated rows are judged each for itself.  An empty table gives no rows; a very long text is one row of one task, and
    its n-grams are counted there before anything is shuffled; other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    target = docs.join(trusted.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")  # ids grow with the corpus: never broadcast
    weights = F.expr("array(" + ",".join(f"{w!r}D" for w in gram_weights(spark, target, docs, buckets)) + ")")  # folded to one literal
    scored = base_counts(docs).withColumn("grams", gram_buckets(F.col("words"), buckets))
    score = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(weights, b)) / F.greatest(F.size("grams"), F.lit(1))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = scored.withColumns({"score": score, "base_failed": failed})
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))


def op9_ngram_ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return judge(spark, docs, trusted)
