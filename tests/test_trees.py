"""Looks over the trees of many sentences against their definition, token by token."""

import random
import re

import pyarrow as pa
import pytest

from proselake.operators import graph, shallow, trees

RELS = ["conj", "conj:and", "nsubj", "nsubj:pass", "compound", "obj", "conjunct", None]


def sentences(n=300, seed=3, loops=True):
    rng = random.Random(seed)
    out = [[], None]
    for _ in range(n):
        k = rng.randint(1, 9)
        heads = [rng.randint(0, k + (rng.random() < 0.1)) for _ in range(k)] if loops and rng.random() < 0.6 else [rng.randint(0, i) for i in range(k)]
        out.append([(i, rng.choice("Ab"), rng.choice(["NOUN", "VERB"]), h, rng.choice(RELS[:-1]), 3 * i, 3 * i + rng.randint(1, 9)) for i, h in enumerate(heads, 1)])
    return out


def told(some, look):
    tokens = pa.array([s and [dict(zip(shallow._TOKEN_FIELDS, t, strict=True)) for t in s] for s in some], shallow._TREE)
    b = trees.Block(pa.array(range(len(some)), pa.int64()), None, [(i, None, 0, 9, None, None, "") for i in range(len(some))], trees.Trees.of(tokens))
    return look(b).to_pylist()


def is_rel(t, rel):
    return (t["deprel"] or "").split(":")[0] == rel


def paths(some):
    """(document, nodes by id) of sentences that have tokens; heads that are no token end a path."""
    for d, s in enumerate(some):
        if s:
            nodes = {t["id"]: t for t in graph._linked([dict(zip(shallow._TOKEN_FIELDS, t, strict=True)) for t in s])}
            yield d, {i: {**t, "anc": [a for a in t["anc"] if a in nodes]} for i, t in nodes.items()}


def ids(found):
    return " ".join(map(str, sorted(found)))


def test_chains():
    some, want = sentences(), []
    for d, n in paths(some):
        def chain(t, rel, n=n):
            return ids(o for o in n if t in n[o]["anc"] and all(is_rel(n[x], rel) for x in [o, *n[o]["anc"]][: n[o]["anc"].index(t) + 1]))

        subjects = {i: [k for k in t["kids"] if is_rel(n[k], "nsubj")] for i, t in n.items()}
        for i, t in n.items():
            path = [i, *t["anc"]]
            # A head that is no token ends the way up as well.
            stop = next((x for x in path if not (is_rel(n[x], "conj") and not subjects[x])), path[-1])
            want.append({"doc_id": d, "sent_idx": d, "id": i, "joined": chain(i, "conj"), "compounds": chain(i, "compound"), "subjects": ids(subjects[stop])})
    assert told(some, graph.chain_look) == want and any(" " in w["subjects"] for w in want) and any(" " in w["joined"] for w in want)

def test_subtrees():
    some, want = sentences(), []
    for d, n in paths(some):
        for i in n:
            below = [i, *(o for o in n if i in n[o]["anc"])]
            want.append({"doc_id": d, "sent_idx": d, "id": i, "ids": ids(below), "start_at": min(n[o]["start"] for o in below), "end_at": max(n[o]["end"] for o in below)})
    assert told(some, graph.subtree_look) == want and told([[], None], graph.subtree_look) == []

def test_children():
    some, want = sentences(), []
    for d, n in paths(some):
        for i, t in n.items():
            head = n[t["head"]]["form"] if t["head"] in n else None
            want.append({"doc_id": d, "sent_idx": d, "id": i, "kids": ids(t["kids"]), "first_kid": n[t["kids"][0]]["form"] if t["kids"] else None, "head_form": head, "has_subject": any(is_rel(n[k], "nsubj") for k in t["kids"]), "depth": len(t["anc"])})
    assert told(some, graph.children_look) == want


def test_checks():
    some = [*sentences(), [(1, "a", "NOUN", None, "obj", 0, 1)], [(1, "a", "NOUN", -1, "obj", 0, 1), (2, "b", "NOUN", 0, "root", 2, 3)]]
    want = [{"doc_id": d, "sent_idx": d, "root_id": next((t[0] for t in s or [] if t[3] == 0), None), "valid": graph.is_tree([t[3] for t in s or []])} for d, s in enumerate(some)]
    assert told(some, graph.check_look) == want and 50 < sum(w["valid"] for w in want) < 250


def test_parses_of_a_block_are_those_of_each_sentence():
    rng = random.Random(1)
    words = ["And", "and", "of", "dog", "Cat", "runs.", "quickly", "made", "3", "is", "(x)", "not", "İs", "...", "\n\n", "“Hm”", " ", "because", "it", "by", "a’b", "no!", "_x", "﻿"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", " "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    want = [{"doc_id": k, **s} for k, t in enumerate(texts) for s in shallow.parse_text(t or "")]
    for whole in (False, True):
        assert [r for b in shallow._parsed(200, whole=whole)([batch, batch]) for r in b.to_pylist()] == want * 2


PARTS = ["It ran.", "The dog saw cats.", "They slept.", "Its data grew", "Alpha knew them.", "Then?", "On it.", "A team, people and gas walked.", "\n\n"]


def pronouns(seed=5, n=80):
    rng = random.Random(seed)
    return [(d, " ".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))) for d in range(n)]


@pytest.mark.parametrize("most", [5, 40, 10_000])
def test_distances(spark, most):
    docs = pronouns()
    want = graph.reference_distance(graph.with_paths(shallow.parses(spark.createDataFrame(docs, "doc_id long, text string"))))
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])
    got = [(r["doc_id"], r["sent_idx"], r["id"], r["distance"]) for b in shallow._parsed(most, graph.Distances)([batch]) for r in b.to_pylist()]
    assert got == sorted(map(tuple, want.collect())) and {None, 0, 1, 2} <= {g[3] for g in got}


SPOKEN = """It and they fast clean small and smart cheap but not only also , highlighting serves as symbol role plays vital important to note is thing that
matters quite large made decision might seem team for Then Not What drives cost . . was rejected by staff listed This compound""".split()
TAGS = ["ADJ", "ADV", "NOUN", "PROPN", "VERB", "AUX", "PUNCT", "PRON"]
ARCS = ["amod", "advmod", "root", "conj", "cc", "advcl", "acl", "obl", "obj", "nsubj", "nsubj:pass", "aux:pass", "aux", "cop", "case", "xcomp", "compound", "expl", "parataxis", "acl:relcl"]


def test_rules_find_only_where_they_may(spark):
    from proselake.plans.parses import rows

    rng, some = random.Random(8), []
    for _, _, _, _, _, toks in rows():
        some.append(toks)
        for _ in range(60):  # near misses and hits: stories with a word, a tag or an arc changed
            changed = [list(t) for t in toks]
            for _ in range(rng.randint(0, 2)):
                t = rng.choice(changed)
                k = rng.choice([1, 2, 3, 4])
                t[k] = rng.choice({1: SPOKEN, 2: TAGS, 3: range(len(toks) + 1), 4: ARCS}[k])
            some.append([tuple(t) for t in changed])
    for _ in range(600):
        n = rng.randint(1, 9)
        some.append([(i, rng.choice(SPOKEN), rng.choice(TAGS), rng.randint(0, n), rng.choice(ARCS), 2 * i, 2 * i + 1) for i in range(1, n + 1)])
    p = spark.createDataFrame([(i, i, 0, 99, "A.", s) for i, s in enumerate(some)], f"doc_id long, sent_idx int, start int, end int, text string, tokens {graph.TOKENS}")
    found = graph.signs(graph.with_paths(p)).where("size(own) > 0 or size(passive) > 0 or bare").select("doc_id", "own.rule", "passive").collect()
    tokens = pa.array([[dict(zip(shallow._TOKEN_FIELDS, t, strict=True)) for t in s] for s in some], shallow._TREE)
    may = graph.may_find(trees.Trees.of(tokens), len(some))
    assert all(may[r.doc_id] for r in found) and not may.all()
    assert {x for r in found for x in r.rule} | {"passive" for r in found if r.passive} == {"rule-of-three", "negative-parallelism", "participial-appendage", "copula-avoidance", "light-verb-role", "throat-clearing", "setup-fragment", "qualifier-softener", "stacked-nouns", "nominalization", "hedge-opener", "dramatic-fragment", "wh-fragment", "agentless-opener", "passive"}


def test_findings_with_few_sentences(spark):
    docs = spark.createDataFrame([(d, t + " It was made. Then on. It walked. They rested. It ended. For it.") for d, t in pronouns(n=30)], "doc_id long, text string")
    signs = graph.signs(graph.with_paths(graph.signs_of(docs)), "one", "many")
    want = sorted(map(tuple, graph.graph_findings(shallow.parses(docs)).collect()))
    assert sorted(map(tuple, graph.judged(signs).collect())) == want and signs.count() < shallow.parses(docs).count()
    assert {w[2] for w in want} == {"dramatic-fragment", "referential-compression"}


@pytest.mark.parametrize("query", ["graph_chains", "tree_checks", "graph_children", "graph_subtrees"])
def test_trees_stay_in_the_pass_that_parses_them(spark, query):
    import __spark_entry__ as entry

    plan = entry.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    passes = re.findall(r"MapInArrow \w+\(doc_id#\w+, text#\w+\).*", plan)
    assert len(passes) == 1 and "tokens" not in passes[0]
