"""The trace in the pass that parses texts, against the reader sentence by sentence and the rules on moments."""

import random

import pyarrow as pa
import pytest

from proselake.operators import shallow, trace
from proselake.operators.trees import Block

WORDS = "And and but of on dogs Cat runs. walked made clear clearly must Should is note: Overall, result means back to. earlier We will explain weak Strong strong: means Alpha, Alpha Beta carried stones shaped it\n\n. they".split(" ")


def texts(n=150, seed=2):
    rng = random.Random(seed)
    busy = lambda: " ".join(f"{rng.choice(['Alpha', 'Beta', 'Gamma'])} {rng.choice(['carried', 'moved', 'shaped'])} {rng.choice(['Alpha', 'Beta', 'Delta'])} and {rng.choice(['stones', 'Beta'])}." for _ in range(rng.randint(0, 40)))
    wide = lambda: " ".join(f"Alpha, A{rng.randint(0, 60)} and B{rng.randint(0, 60)} of C{rng.randint(0, 60)} carried D{rng.randint(0, 60)} and walked on A{rng.randint(0, 9)}." for _ in range(rng.randint(20, 40)))
    return [*(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 80))) for _ in range(n)), *(busy() for _ in range(n)), *(wide() for _ in range(n // 5)), "", None]


def batch(some):
    return pa.RecordBatch.from_arrays([pa.array([k // 2 for k in range(len(some))], pa.int64()), pa.array(some)], ["doc_id", "text"])


def plain(some):
    out = []
    for k, t in enumerate(some):
        r = trace.Reader()
        out += [(k // 2, m) for s in shallow.parse_text(t or "") if (m := r.read(s))]
    return out


@pytest.mark.parametrize("most", [60, 5_000])
def test_moments_of_blocks(most):
    some, every = texts(), [f.name for f in trace.MOMENT]
    want, look = plain(some), trace.Reading(every)
    assert [(b.doc_id[k].as_py(), m) for b in shallow.blocks([batch(some)], most) for k, m in look.moments(b)] == want
    lists = ("introduced", "returned_relations", "released")
    rows = [r for b in shallow._parsed(most, lambda: trace.Reading(["sentence", *lists, "load"], lists))([batch(some)]) for r in b.to_pylist()]
    assert rows == [{"doc_id": d, "sentence": m["sentence"], **{k: len(m[k]) for k in lists}, "load": m["load"]} for d, m in want]


@pytest.mark.parametrize("most", [1, 60, 5_000, 1_000_000])
def test_loads_of_blocks(most):
    from proselake.plans.traces import LEADS

    line = "".join(f"x{i}o " for i in range(30)) + " ".join(f"and walked h{i % 7}o" for i in range(25)) + "."
    some = [*LEADS, *texts(), line, f"{line} {line} It rained. It rained. {line} In short, it rained. {line}"]
    rows = [r for b in shallow._parsed(most, trace.Loads, whole=True)([batch(some), batch(some[:2]), batch([None])]) for r in b.to_pylist()]
    want = [{"doc_id": d, **{k: len(m[k]) if k in trace.Loads.SIZED else m[k] for k in trace.Loads.ONLY}} for part in (some, some[:2]) for d, m in plain(part)]
    assert rows == want


@pytest.mark.parametrize("most", [60, 5_000])
def test_things_of_blocks(most):
    some = texts()
    rows = [r for b in shallow._parsed(most, trace.Things)([batch(some)]) for r in b.to_pylist()]
    assert rows == [{"doc_id": d, "sentence": m["sentence"], **{f"n_{k}": len(m[k]) for k in ("introduced", "reinforced", "returned")}} for d, m in plain(some)]


def test_findings_of_texts_are_those_on_moments(spark):
    from proselake.plans.traces import LEADS

    some = [*LEADS, *texts()]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    want = sorted(map(tuple, trace.trace_findings(trace.moments(shallow.parses(docs)).persist()).collect()))
    assert sorted(map(tuple, trace.findings_of(docs).collect())) == want
    assert {w[1] for w in want} >= {"sustained-buffer-pressure", "unresolved-idea-stack", "undefined-decision-stack", "unoriented-reactivation", "relationship-pileup"}


def test_long_line_in_a_block():
    line = "".join(f"x{i}o " for i in range(300)) + " ".join(f"and walked h{i}o" for i in range(150)) + "."
    (b,) = shallow.blocks([batch([line])], 10)
    assert isinstance(b, Block)
    (_, m), = trace.Reading([f.name for f in trace.MOMENT]).moments(b)
    assert m == trace.Reader().read(shallow.parse_text(line)[0])


@pytest.mark.parametrize("query", ["trace_findings", "moment_entities", "reading_moments"])
def test_parses_are_not_shuffled(spark, query):
    import __spark_entry__ as entry

    plan = entry.queries()[query](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "InMemoryTableScan" not in plan and "FlatMapGroups" not in plan
