"""A document classifier on tag n-grams and shares: sparse vectors, full-batch gradient descent, a model that can be kept.

Vectors stay rows of (terms, values) in Spark.  An epoch sends the weights to the tasks and gets one partial gradient for
each task and term back, summed by term; the terms are single tags and pairs of two fixed tag sets and some dozen
scalars, so there are a few thousand weights whatever the corpus is.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.operators.vectors import tag_ngrams

TAGS = ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"]
SCALARS = ["mean_words", "spread_words", "type_share", "once_share", "comma_share", *(f"share_{t}" for t in TAGS)]
BIAS = "(bias)"


def features(parses: DataFrame) -> DataFrame:
    """parses (doc_id, sent_idx, tokens) -> doc_id, terms (tags and neighbouring pairs, d: relations, p: parts of speech) and
    the scalars of ``SCALARS``; a row for each document with a token."""
    tags = lambda c: F.transform("tokens", lambda t: t[c])
    words = F.filter("tokens", lambda t: ~t["upos"].isin("PUNCT", "SYM"))
    per = parses.where(F.size("tokens") > 0).select("doc_id", "sent_idx", tags("deprel").alias("d"), tags("upos").alias("p"), F.transform(words, lambda t: F.lower(t["form"])).alias("w"), F.size(F.filter("tokens", lambda t: t["form"] == ",")).alias("commas"))
    rows = per.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_idx", "d", "p", "w"))).alias("s"), F.avg(F.size("w")).alias("mean_words"), F.stddev_pop(F.size("w")).alias("spread_words"), F.sum("commas").alias("commas"))
    whole = lambda c: F.flatten(F.transform("s", lambda s: s[c]))
    rows = rows.select("doc_id", "mean_words", "spread_words", "commas", whole("d").alias("d"), whole("p").alias("p"), F.array_sort(whole("w")).alias("w"))
    new = lambda w, i: F.coalesce(F.get(F.col("w"), i - 1) != w, F.lit(True)) | (i == 0)
    once = lambda w, i: new(w, i) & F.coalesce(F.get(F.col("w"), i + 1) != w, F.lit(True))
    n, k = F.greatest(F.size("p"), F.lit(1)), F.greatest(F.size("w"), F.lit(1))
    count = lambda tag: F.size(F.filter("p", lambda t: t == tag))
    shares = [(count(t) / n).alias(f"share_{t}") for t in TAGS]
    return rows.select("doc_id", F.concat(tag_ngrams(F.col("d"), "d"), tag_ngrams(F.col("p"), "p")).alias("terms"), "mean_words", "spread_words", (F.size(F.filter("w", new)) / k).alias("type_share"), (F.size(F.filter("w", once)) / k).alias("once_share"), (F.col("commas") / n).alias("comma_share"), *shares)


@dataclass
class Model:
    """What a document's vector is made with, and the weights of its parts."""

    idf: dict[str, float]
    mean: dict[str, float]
    spread: dict[str, float]
    weights: dict[str, float]
    bias: float = 0.0

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.__dict__),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls(**json.loads(spark.read.text(path).first()[0]))


def fit_vectors(docs: DataFrame, least_df: int = 2) -> Model:
    """Inverse document frequencies of terms that ``least_df`` documents have, and the scalars' means and deviations."""
    stats = docs.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in SCALARS), *(F.stddev_pop(c).alias(f"s_{c}") for c in SCALARS)).first()
    df = docs.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_df).collect()
    return Model({r.t: math.log((1 + stats.n) / (1 + r.df)) + 1 for r in df}, {c: stats[f"m_{c}"] or 0.0 for c in SCALARS}, {c: stats[f"s_{c}"] or 1.0 for c in SCALARS}, {})


def _vectors(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, values = [], []
            scalars = [b.column(b.schema.get_field_index(c)).to_pylist() for c in SCALARS]
            for k, terms in enumerate(b.column(b.schema.get_field_index("terms"))):
                bag: dict[str, float] = {}
                for t in terms.as_py():
                    if t in model.idf:
                        bag[t] = bag.get(t, 0.0) + model.idf[t]
                norm = math.sqrt(sum(v * v for v in bag.values())) or 1.0
                names.append([*bag, *SCALARS])
                values.append([*(v / norm for v in bag.values()), *(((s[k] or 0.0) - model.mean[c]) / model.spread[c] for c, s in zip(SCALARS, scalars, strict=True))])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(names, pa.list_(pa.string())), pa.array(values, pa.list_(pa.float64()))], [*keep, "names", "values"])

    return run


def vectors(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """docs with terms and scalars -> doc_id, what is kept, names and values of the parts of each vector."""
    kinds = dict(docs.dtypes)
    columns = ["doc_id", *keep]
    return docs.mapInArrow(_vectors(model, columns), ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", names array<string>, values array<double>")


def _score(names: list[str], values: list[float], weights: dict[str, float], bias: float) -> float:
    z = bias + sum(v * weights.get(n, 0.0) for n, v in zip(names, values, strict=True))
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _gradient(weights: dict[str, float], bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, float] = {}
        for b in batches:
            for label, names, values in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                err = _score(names, values, weights, bias) - label
                total[BIAS] = total.get(BIAS, 0.0) + err
                for n, v in zip(names, values, strict=True):
                    total[n] = total.get(n, 0.0) + err * v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(np.fromiter(total.values(), np.float64, len(total)))], ["name", "g"])

    return run


def train(rows: DataFrame, model: Model, *, l2: float = 1.0, rate: float = 0.1, epochs: int = 40) -> Model:
    """rows (label 0 or 1, names, values) -> the model with weights and bias, after so many steps over all rows.  No rows
    leave it at zero."""
    rows = rows.select("label", "names", "values").persist()
    n, weights, bias = rows.count(), {}, 0.0
    for _ in range(epochs if n else 0):
        g = {r.name: r.g for r in rows.mapInArrow(_gradient(weights, bias), "name string, g double").groupBy("name").agg(F.sum("g").alias("g")).collect()}
        bias -= rate * g.pop(BIAS, 0.0) / n
        weights = {k: weights.get(k, 0.0) - rate * (g.get(k, 0.0) / n + l2 * weights.get(k, 0.0) / n) for k in g | weights}
    rows.unpersist()
    return Model(model.idf, model.mean, model.spread, weights, bias)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """rows (names, values, ...) with ``score``: 100 times the probability, rounded half up."""
    weights, bias = model.weights, model.bias

    @F.arrow_udf("long")
    def score(names: pa.Array, values: pa.Array) -> pa.Array:
        return pa.array([math.floor(100 * _score(n, v, weights, bias) + 0.5) for n, v in zip(names.to_pylist(), values.to_pylist(), strict=True)], pa.int64())

    return rows.withColumn("score", score("names", "values")).drop("names", "values")
