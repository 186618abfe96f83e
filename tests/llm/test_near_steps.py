"""Near-duplicate steps that a corpus pays for: signatures by ranks, and rows that needn't move."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def test_signatures_are_those_of_whole_permutations():
    from proselake.llm.minhash import LISTED, shingles, superminhash
    from proselake.llm.text import U, mix

    rng = random.Random(5)
    texts = ["", None, "a", "a b", "x x x x x x x", *(" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (3, 9, 40, 700))]
    for size, m in ((1, 7), (3, 252), (2, 300), (3, LISTED), (3, LISTED + 1)):
        val, ptr = shingles(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"]), size)
        sig = superminhash(val, ptr, m)
        for d, text in enumerate(texts):
            own = val[ptr[d] : ptr[d + 1]]
            words = (text or "").split()
            assert len(own) == len({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} - {()}) and (own[1:] > own[:-1]).all()
            want = np.full(m, ~U(0), np.uint64)
            for x in own:
                perm = list(range(m))
                for j in range(m):
                    u = int(mix(np.array([x + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)]))[0])
                    k = j + ((u >> 40) * (m - j) >> 24)
                    perm[j], perm[k] = perm[k], perm[j]
                    want[perm[j]] = min(want[perm[j]], U(j << 40 | u & (1 << 40) - 1))
            assert (sig[d] == want).all()


def test_sieve_catches_all_its_keys(spark, monkeypatch):
    from proselake.llm import minhash
    from proselake.llm.scratch import Scratch

    monkeypatch.setattr(minhash, "SIEVE", 1 << 16)
    s = Scratch(spark, "sieve")
    keys = spark.range(600).select(F.xxhash64("id").alias("key"))
    sieve = minhash._sieve(s, keys)
    assert sieve.count() <= 1024
    every = spark.range(60000).join(sieve, minhash._caught(F.xxhash64("id")), "left_semi")
    assert every.where("id < 600").count() == 600 and every.count() < 2400
    none = minhash._sieve(s, keys.limit(0))
    assert spark.range(50).join(none, minhash._caught(F.xxhash64("id")), "left_semi").count() == 0


def test_rows_that_stay_are_not_shuffled(spark, monkeypatch):
    """Whatever the sieve lets through: rows with null, repeated and negative ids too."""
    from proselake.llm import minhash

    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(40)]
    rows = [(i - 5, t) for i, t in enumerate(base)] + [(100 + i, base[i]) for i in range(0, 40, 4)] + [(200 + i, base[i] + " more") for i in range(1, 40, 4)]
    rows += [(None, base[2]), (None, None), (0, base[30]), (7, ""), (7, None), (-9, base[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {(100 + i, base[i]) for i in range(0, 40, 4)} | {(200 + i, base[i] + " more") for i in range(1, 40, 4)} | {(-3, base[2]), (25, base[30])}
    want = sorted((r for r in rows if r not in gone), key=repr)
    for bits in (64, 1 << 24):  # one word catches nearly all
        monkeypatch.setattr(minhash, "SIEVE", bits)
        out = minhash.drop_near_duplicates(spark, docs, shingle=5, percent=80)
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == want
    assert re.search(r"BroadcastHashJoin [^\n]*LeftAnti", out._jdf.queryExecution().executedPlan().toString())
