"""The reading trace against its definition over whole histories, in batch and as a stream, and the rules on it."""

import random

import pytest

from proselake.operators import shallow, trace


def stories(n=12, seed=4):
    rng = random.Random(seed)
    nouns = ["river", "stones", "tower", "Alpha", "Beta", "garden", "cities", "boxes", "team", "Gamma", "people"]
    verbs = ["carried", "shaped", "watching", "moved", "building"]
    out = []
    for d in range(n):
        parts = []
        for _ in range(rng.randint(0, 40)):
            s = " ".join([rng.choice(["The", "No", "We", "Overall", "They must"]), rng.choice(nouns), rng.choice(verbs), rng.choice(nouns), rng.choice(["and", "of", ""]), rng.choice(nouns), rng.choice(["is clear", "is weak enough", ""])])
            parts.append(" ".join(s.split()) + rng.choice([".", ".", ".\n\n"]))
        out.append((d, " ".join(parts)))
    return [*out, (98, None), (99, "")]


@pytest.fixture(scope="module")
def parses(spark):
    return shallow.parses(spark.createDataFrame(stories(), "doc_id long, text string"))


@pytest.fixture(scope="module")
def told(parses):
    rows = [r.asDict(recursive=True) for r in trace.moments(parses).collect()]
    return sorted(rows, key=lambda r: (r["doc_id"], r["sentence"]))


def by_document(told):
    out = {}
    for r in told:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_moments_from_whole_histories(told):
    """A frame is held while no more than two sentences passed since it was named and nothing released it."""
    assert len(told) > 150
    for rows in by_document(told).values():
        freed = [k > 0 and (r["after_heading"] or bool(rows[k - 1]["cues"])) for k, r in enumerate(rows)]
        things = [r["introduced"] + r["reinforced"] for r in rows]
        relations = [r["new_relations"] + r["old_relations"] for r in rows]
        for k, r in enumerate(rows):
            at = r["sentence"]

            def held(named, key, upto, at=at, k=k, rows=rows, freed=freed):
                """Is it held when sentence k begins (after what is let go), from what was named before?"""
                last = max((j for j in range(upto) if key in named[j]), default=None)
                return last is not None and at - rows[last]["sentence"] <= 2 and not any(freed[last + 1 : k + 1])

            events = {"push": 0, "reinforce": 0, "reactivate": 0}
            for named in (things, relations):
                met = set()
                for key in named[k]:
                    before = any(key in named[j] for j in range(k))
                    events["reinforce" if key in met or held(named, key, k) else "reactivate" if before else "push"] += 1
                    met.add(key)
            assert r["load"]["reinforcements"] == events["reinforce"] and r["load"]["reactivations"] == events["reactivate"]
            for named, frames, gone in ((things, "entity_frames", "released"), (relations, "relation_frames", "released_relations")):
                every = {x for j in range(k + 1) for x in named[j]}
                assert r["load"][frames] == sum(x in named[k] or held(named, x, k) for x in every)
                if k:
                    was = set(rows[k - 1]["entities" if named is things else "relations"])
                    assert set(r[gone]) == {x for x in was if not held(named, x, k)}
            assert set(r["introduced"]) == {x for x in things[k] if not any(x in things[j] for j in range(k))}
            back = {x: at - max(rows[j]["sentence"] for j in range(k) if x in things[j]) for x in r["reinforced"]}
            assert {x["key"]: x["gap"] + 1 for x in r["returned"]} == {x: g for x, g in back.items() if g >= 4}
            roles = {}
            for c in (c for q in rows[:k] for c in q["clauses"]):
                roles.update([(x, "subject") for x in c["subjects"]] + [(o["key"], o["role"]) for o in c["objects"]])
            changes = 0
            for c in r["clauses"]:
                for who, role in [(x, "subject") for x in c["subjects"]] + [(o["key"], o["role"]) for o in c["objects"]]:
                    changes += roles.get(who, role) != role
                    roles[who] = role
            assert r["load"]["role_changes"] == changes == len(r["role_changes"])
            assert r["load"]["inflow"] == r["load"]["pushes"] + r["load"]["reactivations"] - r["load"]["pops"]


def test_one_story_by_hand():
    r, out = trace.Reader(), []
    for s in shallow.parse_text("The stones carried Alpha. We will explain the tower later. It rained. Overall the tower rested.\n\nCheck that it is clear. Clear means bright. Alpha carried the stones."):
        out.append(r.read(s))
        r = trace.Reader.load(r.save())
    assert [m["introduced"] for m in out][0] == ["stone", "alpha"] and out[0]["new_relations"] == ["stone->carried->alpha"]
    assert [i["topics"] for i in out[1]["ideas"]] == [["explain"]] and out[-1]["ideas"] == out[1]["ideas"]
    assert out[3]["cues"] == ["summary"] and out[4]["load"]["entity_frames"] <= 2 and out[4]["new_unit"]
    assert [c["to"] for c in out[-1]["role_changes"]] == ["subject", "object"] and {x["key"] for x in out[-1]["returned"]} >= {"alpha", "stone"}
    assert trace.entity_key("Cities", "NOUN") == "city" and trace.entity_key("boxes", "NOUN") == "box" and trace.entity_key("gas", "NOUN") == "gas" and trace.entity_key("glass", "NOUN") == "glass" and trace.entity_key("Alphas", "PROPN") == "alphas"


def test_stream_equals_batch(spark, parses, told, tmp_path):
    rows = parses.collect()
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for at in range(3):  # each part is read by a stream of its own, which goes on from the state of the one before
        part = [r for r in rows if min(2, r.sent_idx // 9) == at] + [r for r in rows if at == 2 and r.sent_idx == 0][:2]
        spark.createDataFrame(part, parses.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(parses.schema).parquet(str(tmp_path / "in"))
        q = trace.moments_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.asDict(recursive=True) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: (r["doc_id"], r["sentence"]))
    assert got == told


def test_rules_on_moments(spark):
    from proselake.plans.traces import LEADS

    docs = spark.createDataFrame(list(enumerate(LEADS)), "doc_id long, text string")
    m = trace.moments(shallow.parses(docs)).persist()
    found = {(r.doc_id, r.rule, r.start, r.confidence) for r in trace.trace_findings(m).collect()}
    assert (1, "unresolved-idea-stack", 0, "low") in found and (2, "undefined-decision-stack", LEADS[2].index("clearly"), "high") in found
    assert {f for f in found if f[0] == 0} == set()
    assert [f[1] for f in found if f[0] == 3] == ["unresolved-idea-stack"]


def test_windows_that_grow_and_skip():
    def moment(at, *pairs, cue=False):
        return {"start": at * 100, "end": at * 100 + 90, "after_heading": False, "cues": ["summary"] if cue else [], "clauses": [{"subjects": [a], "objects": [{"key": b, "role": "object"}]} for a, b in pairs]}

    busy = [moment(k, ("a", "b"), ("b", "c"), ("c", "a")) for k in range(4)]
    assert trace._pileup(busy[:2]) == (6, 3, 9, 3)
    more = [moment(k, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")) for k in range(3)]
    assert trace.pileup_windows(more) == [(0, 290, "high")]
    assert trace.pileup_windows([*more[:1], moment(1, cue=True), *more[2:]]) == []
    assert trace.pileup_windows(more + [moment(k) for k in range(3, 20)] + [moment(k, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")) for k in (20, 21)]) == [(0, 690, "high"), (1500, 2190, "medium")]


def test_pressure_counts_windows(spark):
    from pyspark.sql import functions as F

    load = lambda e, p, r: (p, 0, 0, 0, e, 0, 0, 0, r, p)
    rows = [(1, k, k * 10, k * 10 + 9, load(30, 9, 2) if 5 <= k < 12 else load(1, 1, 0), k == 8, []) for k in range(30)] + [(2, k, k, k + 1, load(30, 9, 2), False, []) for k in range(19)]
    kind = "struct<" + ",".join(f"{k}:int" for k in trace.LOAD) + ">"
    m = spark.createDataFrame(rows, f"doc_id long, sentence int, start int, end int, load {kind}, after_heading boolean, cues array<string>")
    got = sorted((r.doc_id, r.start, r.end) for r in trace.sustained_pressure(m.withColumn("cues", F.col("cues"))).collect())
    # Windows 5-7 and 8-10 or 9-11 are whole; those over the heading before 8 don't count.
    assert got == [(1, 50, 79), (1, 80, 109)]
