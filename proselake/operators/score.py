"""Document scores from findings: weighted density, verdict bands, clusters of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions.text import let, token_count
from proselake.operators.detect import CATEGORY, SUPPORT_ONLY, findings

# Weights of categories (others weigh 1) and bands of scores.
WEIGHT = {"evidence": 4, "significance": 3, "parallelism": 3, "promo": 2.5, "vague": 2.5, "meta": 2, "agency": 2, "ai-vocab": 2, "balance": 2, "performance": 2, "rule-of-three": 1.5, "conjunctions": 1.5, "formatting": 1, "rhythm": 1.5}
VERDICTS = [(20, "Reads clean"), (45, "Mostly clean"), (60, "Some AI-style"), (80, "Noticeably AI-styled"), (101, "Reads AI-styled")]


def _map(of: dict, key: Column, other) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), key), F.lit(other))


def category(rule: Column) -> Column:
    return _map(CATEGORY, rule, "other")


def verdict(score: Column) -> Column:
    out = F.lit(VERDICTS[-1][1])
    for most, label in reversed(VERDICTS):
        out = F.when(score < most, label).otherwise(out)
    return out


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score (0 to 100: weight of findings per 100 tokens, times six), verdict."""
    weight = lambda f: _map({k: float(v) for k, v in WEIGHT.items()}, category(f["rule"]), 1.0)
    f = findings(docs).select("doc_id", F.aggregate(F.transform("found", weight), F.lit(0.0), lambda a, x: a + x).alias("w"), token_count(F.col("text")).cast("long").alias("n_tokens"))
    score = F.when(F.col("n_tokens") > 0, F.least(F.lit(100), F.floor(F.col("w") / F.col("n_tokens") * 100 * 6 + 0.5))).otherwise(0).cast("long")
    return f.select("doc_id", "n_tokens", score.alias("score")).withColumn("verdict", verdict(F.col("score")))


def _evidence(f: Column) -> Column:
    return F.when(f["confidence"] == "high", 3.0).when(f["confidence"] == "medium", 2.0).when(f["rule"].isin(SUPPORT_ONLY), 0.25).otherwise(1.0)


def independent(hits: Column) -> Column:
    """hits by start and end; of two short ones that nearly cover each other the heavier stays."""
    same = lambda a, b: let(F.struct(F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])).alias("both"), F.least(a["end"] - a["start"], b["end"] - b["start"]).alias("short"), F.greatest(a["end"] - a["start"], b["end"] - b["start"]).alias("long")), lambda x: (x["long"] <= 120) & (x["short"] > 0) & (x["both"] >= 0.8 * x["short"]))

    def step(kept, x):
        at = F.array_position(F.transform(kept, lambda k: same(x, k)), True)
        swap = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (_evidence(x) > _evidence(k)), x).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(x))).otherwise(swap)

    kind = "array<struct<start:int,end:int,rule:string,confidence:string>>"
    flat = F.sort_array(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["rule"].alias("rule"), h["confidence"].alias("confidence"))))
    return F.aggregate(flat, F.array().cast(kind), step)


def _signals(hits: Column) -> Column:
    """Of hits: their weight s, and the numbers of rules r, of rules that are more than support b, of categories c."""
    names = lambda x: F.size(F.array_distinct(F.transform(x, lambda h: h["rule"])))
    kinds = F.size(F.array_distinct(F.transform(hits, lambda h: category(h["rule"]))))
    solid = F.filter(hits, lambda h: ~h["rule"].isin(SUPPORT_ONLY))
    return F.struct(F.aggregate(F.transform(hits, _evidence), F.lit(0.0), lambda a, x: a + x).alias("s"), names(hits).alias("r"), names(solid).alias("b"), kinds.alias("c"))


def clusters(pars: Column, found: Column) -> Column:
    """The paragraphs in which several independent signals meet: start, end, n_signals, confidence."""

    def rated(p):
        near = F.filter(found, lambda h: (h["end"] > p["start"]) & (h["start"] < p["end"]))
        one = lambda hits: let(_signals(hits), lambda x: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.size(hits).alias("n_signals"), x.alias("x")))
        return let(near, lambda hits: F.when(F.size(hits) >= 2, let(independent(hits), one)))

    strong = lambda x: (x["s"] >= 4) & (x["r"] >= 2) & (x["b"] >= 2) & (x["c"] >= 2)
    high = lambda x: (x["s"] >= 9) & (x["r"] >= 3) & (x["c"] >= 3)
    kept = F.filter(F.transform(pars, rated), lambda p: F.coalesce(strong(p["x"]), F.lit(False)))
    return F.transform(kept, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["n_signals"].alias("n_signals"), F.when(high(p["x"]), "high").otherwise("medium").alias("confidence")))


def evidence_clusters(docs: DataFrame) -> DataFrame:
    """Paragraphs in which several independent signals meet: (doc_id, start, end, n_signals, confidence)."""
    # Outer, so that no filter on the array is moved below, where the whole array would be computed twice.
    f = findings(docs).select("doc_id", F.explode_outer(clusters(F.col("pars"), F.col("found"))).alias("p")).where("p is not null")
    return f.select("doc_id", "p.*")


def document_clusters(docs: DataFrame) -> DataFrame:
    """Documents whose signals are spread but many: (doc_id, start, end, n_signals, n_rules), placed on the strongest one.

    Weight of 12, 20 signals a thousand tokens, five rules of which four are more than support, three categories,
    and fewer than two paragraphs that are clusters of their own.
    """
    rank = lambda h: F.when(h["confidence"] == "high", 0).when(h["confidence"] == "medium", 1).otherwise(2)
    anchor = lambda found: F.array_min(F.transform(found, lambda h, i: F.struct(rank(h).alias("rank"), h["start"].alias("start"), i.alias("i"), h["end"].alias("end"))))
    dense = lambda n, x, k: (x["s"] >= 12) & (n * 1000 >= 20 * F.greatest(k, F.lit(1))) & (x["r"] >= 5) & (x["b"] >= 4) & (x["c"] >= 3)

    def spread_out(found, pars, text):
        row = lambda x: let(anchor(found), lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), F.size(found).alias("n_signals"), x["r"].alias("n_rules")))
        few = F.size(clusters(pars, found)) < 2
        return F.when(F.size(found) >= 5, let(_signals(found), lambda x: F.when((x["r"] >= 5) & dense(F.size(found), x, token_count(text)) & few, row(x))))

    # One scan, and an array of none or one for each document: a filter on found itself would find everything again.
    some = lambda c: F.filter(F.array(c), lambda r: r.isNotNull())
    out = findings(docs).select("doc_id", F.explode_outer(some(spread_out(F.col("found"), F.col("pars"), F.col("text")))).alias("a")).where("a is not null")
    return out.select("doc_id", "a.*")
