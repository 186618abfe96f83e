"""Trees against enumeration, and a stream of document versions against its batch twin."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from proselake.operators.decode import best_tree, decoded, greedy_tree
from proselake.operators.graph import is_tree
from proselake.streaming import documents

NONE = float("-inf")


def table(n, rng, ties=False):
    return [[NONE if h == d else rng.randint(0, 3) if ties else rng.uniform(-10, 10) for h in range(n + 1)] for d in range(1, n + 1)]


def total(scores, heads):
    return sum(row[h] for row, h in zip(scores, heads, strict=True))


@pytest.mark.parametrize("ties", [False, True])
def test_best_tree_against_enumeration(ties):
    rng = random.Random(3)
    for n in range(1, 7):
        trees = [h for h in itertools.product(range(n + 1), repeat=n) if is_tree(list(h))]
        for _ in range(25 if n < 6 else 6):
            s = table(n, rng, ties)
            got = best_tree(s)
            assert is_tree(got) and total(s, got) == pytest.approx(max(total(s, h) for h in trees))


def plain_repair(scores):
    """Cycles by walking from every token, one repair at a time, all options laid out."""
    n = len(scores)
    heads = [0 if n == 1 else min((h for h in range(1, n + 1) if h != d), key=lambda h: (-scores[d - 1][h], h)) for d in range(1, n + 1)]
    root = min(range(1, n + 1), key=lambda d: (-(scores[d - 1][0] - scores[d - 1][heads[d - 1]]), d))
    heads[root - 1] = 0

    def walk(d):
        path = []
        while d and d not in path:
            path.append(d)
            d = heads[d - 1]
        return path, d

    while True:
        loose = [d for d in range(1, n + 1) if walk(d)[1]]
        if not loose:
            return heads
        path, again = walk(loose[0])
        cycle = path[path.index(again) :]
        safe = [d for d in range(1, n + 1) if not walk(d)[1]]
        options = sorted((scores[d - 1][heads[d - 1]] - scores[d - 1][h], d, h) for d in cycle for h in [min(safe, key=lambda h: (-scores[d - 1][h], h))])  # noqa: B023
        _, d, h = options[0]
        heads[d - 1] = h


def test_greedy_trees_are_valid_and_repaired_where_it_costs_least():
    rng = random.Random(13)
    for n in range(1, 40):
        for k in range(10):
            s = table(n, rng, k % 2 == 1)
            got = greedy_tree(s)
            assert is_tree(got) and got == plain_repair(s)
            if n < 20:
                assert is_tree(best_tree(s)) and total(s, best_tree(s)) >= total(s, got) - 1e-9
    assert greedy_tree([[9, NONE, 1, 0], [0, 8, NONE, 1], [0, 1, 8, NONE]]) == [0, 1, 2]
    assert greedy_tree([[10, NONE, 0, 0], [0, 0, NONE, 9], [0, 8, 10, NONE]]) == [0, 3, 1]
    assert greedy_tree([]) == best_tree([]) == [] and greedy_tree([[3, NONE]]) == [0]
    with pytest.raises(ValueError, match="scores"):
        greedy_tree([[1], [2]])


def test_decoded_column(spark):
    rows = [(1, [[10.0, None, 0.0, 0.0], [0.0, 0.0, None, 9.0], [0.0, 8.0, 10.0, None]]), (2, []), (3, None), (4, [[1.0], [2.0]])]
    got = spark.createDataFrame(rows, "k int, s array<array<double>>").select("k", decoded(F.col("s")).alias("h"), decoded(F.col("s"), True).alias("b")).collect()
    assert {r.k: r.h for r in got} == {1: [0, 3, 1], 2: [], 3: None, 4: None} and {r.k: r.b for r in got}[1] == [0, 3, 1]


def test_version_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    text = lambda d, g: f"Sorry, this is version {g} of {d}. " + "It never ends. " * (d + g)
    rows = [(d, g, bytearray(text(d, g).encode())) for d in range(6) for g in range(1, 6)]
    rows += [(7, 1, bytearray(b"fine")), (7, 2, bytearray(b"\xff\xfe broken")), (8, 1, None), (9, None, bytearray(b"no generation"))]
    random.Random(2).shuffle(rows)
    for at in range(3):  # stopped and started again between parts; later parts bring older generations
        part = [r for k, r in enumerate(rows) if k % 3 == at]
        spark.createDataFrame(part, documents.VERSION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = documents.run_documents(spark.readStream.schema(documents.VERSION).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        assert q.exception() is None
    want = documents.checked(documents.latest(spark.createDataFrame(rows, documents.VERSION)))
    got = documents.results(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    by = {r.doc_id: r for r in got.collect()}
    assert by[7].status == "runtime-error" and by[7].n_words is None and by[8].n_words == 0 and 9 not in by and by[3].generation == 5
    # A batch that is run again replaces its own folder.
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("batch=*"))
    before = spark.read.parquet(str(tmp_path / "out" / f"batch={last}")).count()
    documents.checked(spark.createDataFrame(rows[:0], documents.VERSION)).write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={last}"))
    assert before >= 0 and spark.read.parquet(str(tmp_path / "out" / f"batch={last}")).count() == 0
