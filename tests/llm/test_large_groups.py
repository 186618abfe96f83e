"""Near-duplicate groups whose members share an edit but not each other's: pairs must not grow with the group's square."""

import random

import pytest


@pytest.mark.parametrize(("query", "shingle", "percent", "own"), [("op1", 3, 85, 10), ("pipeline", 5, 80, 8)])
def test_members_that_share_one_edit(spark, monkeypatch, query, shingle, percent, own):
    """Each member has an edit that all have, which puts it just below the similarity to the text they were copied from,
    and edits of its own; a few are copied from members, with one more edit."""
    from proselake.llm.minhash import drop_near_duplicates, near_duplicates
    from proselake.llm.scratch import Scratch

    rng = random.Random(7)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    places = [p for p in range(10, 390, 5) if p != 200]
    for i in range(1, 61):
        t = list(base)
        t[200] = "common"
        for p in rng.sample(places, own):
            t[p] = f"own{i}x{p}"
        rows.append((i, " ".join(t)))
    for i in range(1, 61, 20):
        t = rows[i][1].split()
        t[3] = f"more{i}"
        rows.append((100 + i, " ".join(t)))
    sets = {d: {tuple(t.split()[i : i + shingle]) for i in range(len(t.split()) - shingle + 1)} for d, t in rows}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    assert {d: r for d, r in root.items() if d != r} == {101: 1, 121: 21, 141: 41}

    pairs, put = [], Scratch.put

    def counted(self, df):
        out = put(self, df)
        if out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if query == "op1":
        assert {r.doc_id: r.component_id for r in near_duplicates(spark, docs, shingle=shingle, percent=percent).collect()} == root
    else:
        assert sorted(r.doc_id for r in drop_near_duplicates(spark, docs, shingle=shingle, percent=percent).collect()) == sorted(set(root.values()))
    assert len(pairs) == 2 and pairs[1] < 2 * len(rows), pairs
