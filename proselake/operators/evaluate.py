"""Scores against labels: AUC, confusion, threshold sweep, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auc(scored: DataFrame, ranges: int = 32) -> DataFrame:
    """scored (score, label 0/1): Mann-Whitney with ties at half, from counts per distinct score.

    Distinct scores are dealt into ranges by quantiles; counts below a score are those of the ranges before
    (a table of ``ranges`` rows) and of its own range, so that no task sees all scores.
    """
    per = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    cuts = sorted(set(per.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []))
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("score") > c).cast("int")
    per = per.withColumn("part", part)
    sums = per.groupBy("part").agg(F.sum("n").alias("k"))
    before = sums.alias("a").join(sums.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.k"), F.lit(0)).alias("before"))
    below = F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    wins = per.withColumn("below", F.coalesce(below, F.lit(0))).join(F.broadcast(before), "part").select("p", "n", (F.col("below") + F.col("before")).alias("below"))  # at most ``ranges`` rows
    one = wins.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return one.select(F.col("p").alias("n_pos"), F.col("n").alias("n_neg"), F.round(F.col("w") / (F.col("p") * F.col("n")), 9).alias("auc"))


def sweep(scored: DataFrame, thresholds: list[int]) -> DataFrame:
    """Confusion counts for every threshold (score >= threshold predicts 1); rows are first counted by score."""
    per = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    rows = per.select("score", "p", "n", F.explode(F.array(*(F.lit(x) for x in thresholds))).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    c = rows.groupBy("threshold").agg(total(hit, "p").alias("tp"), total(hit, "n").alias("fp"), total(~hit, "n").alias("tn"), total(~hit, "p").alias("fn"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "specificity": rate(tn, tn + fp), "accuracy": (tp + tn) / F.greatest(F.lit(1), tp + tn + fp + fn)})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    names = ["precision", "recall", "specificity", "accuracy", "f1"]
    return c.withColumn("f1", f1).select("threshold", "tp", "fp", "tn", "fn", *(F.round(x, 6).alias(x) for x in names))


def best_threshold(swept: DataFrame, least_specificity: float = 0.8) -> DataFrame:
    """The row of the best F1 among those specific enough, or among all if none is; ties go to the lowest threshold."""
    order = F.struct((F.col("specificity") >= least_specificity).alias("fit"), "f1", (-F.col("threshold")).alias("low"))
    return swept.agg(F.max_by(F.struct("threshold", "f1", "specificity"), order).alias("x")).select("x.*")


def quantiles(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """Linear-interpolated and nearest-rank quantiles of each group."""
    sorted_ = rows.groupBy(by).agg(F.percentile(value, F.array(*(F.lit(s) for s in shares))).alias("linear"))
    return sorted_.select(by, F.explode(F.arrays_zip(F.array(*(F.lit(s) for s in shares)).alias("share"), F.col("linear"))).alias("x")).select(by, "x.share", F.round("x.linear", 6).alias("linear"))


def nearest_rank(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """The value at place floor(n * share) of each group in order; equal values are counted once before they are ranked."""
    per = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(by).orderBy(value)
    per = per.withColumns({"upto": F.sum("k").over(w), "n": F.sum("k").over(Window.partitionBy(by))})
    at = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    return per.where((F.col("upto") > at) & (F.col("upto") - F.col("k") <= at)).select(by, F.col(value).alias("nearest"))


def folds(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """Round-robin folds inside each stratum, ordered by doc_id."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("doc_id"))
    return rows.withColumn("fold", ((n - 1) % k).cast("long"))
