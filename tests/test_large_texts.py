"""Steps that hold little at a time, and long lines."""

import time

import pyarrow as pa

from proselake.functions import places
from proselake.operators import detect, graph, shallow, trace


def test_long_line_is_read_in_time():
    # Names before the first verb are subjects of all later ones: 300 x 150 relations in one sentence.
    line = "".join(f"x{i}o " for i in range(300)) + " ".join(f"and walked h{i}o" for i in range(150)) + "."
    began = time.time()
    m = [trace.Reader().read(s) for s in shallow.parse_text(line)]
    assert time.time() - began < 10
    new = m[0]["new_relations"]
    assert len(new) > 40_000 and not m[0]["old_relations"]


def test_parser_hands_on_few_tokens_at_a_time():
    texts = ["One dog runs. " * 50, None, "", "Two cats sleep here"] * 200
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = list(shallow._parsed(1_000)([batch]))
    assert max(len(b.column("tokens").flatten()) for b in out) <= 1_100
    rows = [r for b in out for r in b.to_pylist()]
    want = [{"doc_id": k, **s} for k, t in enumerate(texts) for s in shallow.parse_text(t or "")]
    assert rows == want


def test_graph_rules_look_at_nodes_once(spark):
    docs = spark.createDataFrame([(1, "It runs well. It never stops. It sleeps here. The plan was rejected.")], "doc_id long, text string")
    found = graph.graph_findings(shallow.parses(docs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1
    shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 1


def test_reference_distance_shuffles_no_nodes(spark):
    docs = spark.createDataFrame([(1, "The dog ran. It slept.")], "doc_id long, text string")
    d = graph.reference_distance(graph.with_paths(shallow.parses(docs)))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.split("\n") if "Window" in line)
    assert "nodes" not in window and [tuple(r) for r in d.collect()]


def test_linked_slices(spark):
    docs = spark.createDataFrame([(1, "A dog runs. " * 600)], "doc_id long, text string")
    assert graph.with_paths(shallow.parses(docs)).selectExpr("size(nodes) as n").groupBy("n").count().collect() == [(4, 600)]


def test_places_are_found_some_texts_at_a_time():
    texts = pa.array(["Never say it. “Always” wait.", None, "", "x" * 50] * 300)
    sizes = []

    def one(some):
        sizes.append(len(some))
        return places.scan(some, detect.PLACES)

    assert places.in_slices(texts, one).to_pylist() == places.scan(texts, detect.PLACES).to_pylist()
    assert max(sizes) <= places.SLICE < sum(sizes) == len(texts)
    assert len(places.in_slices(pa.array([], pa.string()), lambda some: places.scan(some, detect.PLACES))) == 0
