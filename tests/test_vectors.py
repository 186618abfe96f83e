"""Tags counted in the pass that parses texts, and their weights."""

import collections
import math

import pyarrow as pa
import pytest

from proselake.operators import shallow, vectors

TEXTS = ["The dog runs. It made a cat of stones, and quickly slept!", None, "", "Clear.\n\nClear and clear. No end", "word " * 90]


def grams(tags, prefix):
    return [f"{prefix}:{t}" for t in tags] + [f"{prefix}:{a}|{b}" for a, b in zip(tags, tags[1:], strict=False)]


def test_counts_of_tags():
    lead = lambda d: (["root", "odd"], ["X", "NOUN"]) if d % 2 else ([], [])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)], ["doc_id", "text"])
    for most in (10, 1000):
        rows = [r for b in shallow._parsed(most, lambda: vectors.tag_count_look(lead), whole=True)([batch, batch]) for r in b.to_pylist()]
        want = []
        for d, text in [*enumerate(TEXTS)] * 2:
            toks = [t for s in shallow.parse_text(text or "") for t in s["tokens"]]
            d_tags, p_tags = (lead(d)[k] + [t[f] for t in toks] for k, f in enumerate(("deprel", "upos")))
            if d_tags:
                want.append((d, dict(collections.Counter(grams(d_tags, "d") + grams(p_tags, "p")))))
        assert [(r["doc_id"], {t["term"]: t["tf"] for t in r["terms"]}) for r in rows] == want


@pytest.mark.parametrize("few", [True, False])
def test_weights(spark, few):
    docs = {1: {"a": 2, "b": 1}, 2: {"a": 1, "c": 3, "b": 4}, 3: {"d": 1}, 4: {}, 5: {"c": 1, "a": 7}}
    rows = [(d, [(t, n) for t, n in x.items()]) for d, x in docs.items()]
    df = collections.Counter(t for x in docs.values() for t in x)
    w = {(d, t): n * (math.log(6 / (1 + df[t])) + 1) for d, x in docs.items() for t, n in x.items() if df[t] >= 2}
    norm = {d: math.sqrt(sum(v * v for (k, _), v in w.items() if k == d)) for d in docs}
    want = {(d, t): pytest.approx(v / norm[d]) for (d, t), v in w.items()}
    counted = spark.createDataFrame(rows, f"doc_id long, {vectors.COUNTED}")
    assert {(r.doc_id, r.term): r.weight for r in vectors.tfidf_of(counted, few=few).collect()} == want
    listed = spark.createDataFrame([(d, [t for t, n in x.items() for _ in range(n)]) for d, x in docs.items()], "doc_id long, terms array<string>")
    assert {(r.doc_id, r.term): r.weight for r in vectors.tfidf(listed).collect()} == want


def test_documents_are_parsed_once(spark):
    import __spark_entry__ as entry

    q = entry.queries()["tag_vectors"](spark, "/root/testdata/sf0.001")
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan and "tokens" not in plan
