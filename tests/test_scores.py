"""Scores and clusters take one scan, tokens one count."""

from pyspark.sql import functions as F

from proselake.functions.text import syntactic_words, token_count
from proselake.operators import score


def test_clusters_come_from_one_scan(spark):
    docs = spark.createDataFrame([(1, "However, we are sorry. It never ends.")], "doc_id long, text string")
    for found in (score.document_clusters(docs), score.evidence_clusters(docs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and plan.count("semantic-redundancy") <= 4


def test_token_count(spark):
    texts = ["", None, "Don't stop, cannot go", "CANNOT X", "á ́ b", "www.x.org's 3.5 x’s", "no marks: 12,5 — ok", "six-ty cannot's"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select(token_count(F.col("t")).alias("n"), syntactic_words(F.col("t")).alias("w")).collect():
        assert r.n == sum(any(c.isalnum() for c in w) for w in r.w)
