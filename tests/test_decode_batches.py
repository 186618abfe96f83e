"""Trees decoded many at a time, and scores of words by the CRC of both."""

import random
import zlib

import numpy as np
import pyarrow as pa

from proselake.operators import decode, shallow
from proselake.plans import runs


def test_many_tables_at_once():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 5, 8, 17, 33):
        for most in (3, 10_000):  # few values make ties
            s = np.array([[[rng.randint(0, most) / 8 for _ in range(n + 1)] for _ in range(n)] for _ in range(60)]).reshape(60, n, n + 1)
            assert decode.greedy_trees(s).tolist() == [decode.greedy_tree([[decode._NONE if h == d else x for h, x in enumerate(row)] for d, row in enumerate(t, 1)]) for t in s.tolist()]


def test_column_of_mixed_tables(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    table = lambda n, holes: [[None if h == d or rng.random() < holes else rng.uniform(-5, 5) for h in range(n + 1)] for d in range(1, n + 1)]
    rows = [(k, table(rng.randint(0, 9), 0.02 * (k % 3 == 0))) for k in range(150)] + [(150, None), (151, [[1.0], [2.0]]), (152, [None, [1.0, 2.0, 3.0]])]
    got = spark.createDataFrame(rows, "k int, s array<array<double>>").coalesce(1).select("k", decode.decoded(F.col("s")).alias("h")).collect()
    plain = lambda t: decode.greedy_tree([[decode._NONE if v is None else v for v in row] for row in t])
    assert {r.k: r.h for r in got} == {k: plain(t) if k < 150 else None for k, t in rows}


def test_stretches_of_words():
    texts = ["The dog saw the cat and a dog. É ǆ no!", " ".join(f"w{k * k % 71}é" + "x" * (k % 9) for k in range(90)), None, "", "One"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    own = lambda a, b: zlib.crc32(f"{a} {b}".encode()) % 1000 / 100
    want = []
    for d, text in enumerate(texts):
        for s in shallow.parse_text(text or ""):
            words = [t["form"].lower() for t in s["tokens"]]
            for k in range(0, len(words), runs.STRETCH):
                w = words[k : k + runs.STRETCH]
                heads = decode.greedy_tree([[own(a, "") - 4, *(decode._NONE if i == j else own(a, b) - abs(i - j) / 4 for j, b in enumerate(w))] for i, a in enumerate(w)])
                want.append({"doc_id": d, "sent_idx": s["sent_idx"], "part": k // runs.STRETCH, "heads": " ".join(map(str, heads)), "n_roots": heads.count(0)})
    assert [r for b in shallow._parsed(30, lambda: runs._decoded)([batch]) for r in b.to_pylist()] == want


def test_scores_stay_in_the_pass(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["decoded_trees"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "Generate" not in plan
