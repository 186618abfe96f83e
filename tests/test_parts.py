"""Readers, registry and graph operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from proselake.operators import graph, intervals, registry, vectors
from proselake.sources import masking, records
from proselake.sources.html import html_text
from proselake.sources.readers import files, ignore_pattern


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("x")).first().x


def test_changed_files():
    status = " M a b.md\0R  new.md\0old.md\0D  gone.md\0?? sub/./x.md\0 M a b.md\0"
    assert records.changed_files(status, "/r/") == ["/r/a b.md", "/r/new.md", "/r/sub/x.md"]
    assert records.changed_files("", "/r") == []
    with pytest.raises(ValueError, match="outside"):
        records.changed_files(" M ../x", "/r")
    with pytest.raises(ValueError, match="porcelain"):
        records.changed_files("x", "/r")


def test_files_below_a_folder(spark, tmp_path):
    root = tmp_path / "build" / "site"
    for name in ("a.md", ".hid.md", ".git/b.md", "sub/dist/c.md", "sub/keep.md", "sub/drop.txt", "tmp/x.md", "lib.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    names = lambda **o: {r.text for r in files(spark, str(root), **o).collect()}
    assert names() == {"a.md", "sub/keep.md", "sub/drop.txt", "tmp/x.md", "lib.py"}  # a parent named build does not matter
    assert names(ignore=["# note", "*.txt", "/tmp"]) == {"a.md", "sub/keep.md", "lib.py"}
    assert names(no_ignore=True, extensions=["md"]) == {"a.md", "sub/keep.md", "tmp/x.md", "sub/dist/c.md"}
    assert ignore_pattern([]) is None
    with pytest.raises(ValueError, match="negated"):
        ignore_pattern(["!x"])


def test_registry(spark):
    config = registry.layered(registry.preset("craft"), registry.Config({"emoji": "error", "verdict-word": "off"}, "warn"))
    rows = [("emoji", "info"), ("verdict-word", "warn"), ("apology-reflex", "error"), ("paragraph-load", "warn"), ("hedge-phrase", "info")]
    got = registry.configured(spark.createDataFrame(rows, "rule string, severity string"), config).collect()
    assert {tuple(r) for r in got} == {("emoji", "error"), ("apology-reflex", "error")}
    with pytest.raises(ValueError, match="unknown rules"):
        registry.Config({"nope": "warn"})
    with pytest.raises(ValueError, match="unknown severities"):
        registry.Config({"emoji": "loud"})
    assert registry.catalogue(spark).count() == len(registry.CATEGORY)


def test_trees(spark):
    def tree(heads, rels):
        return [(i + 1, f"t{i}", "NOUN", h, r, 3 * i, 3 * i + 2) for i, (h, r) in enumerate(zip(heads, rels, strict=True))]

    rows = [(1, 0, "", 0, 9, tree([2, 0, 2], ["a", "root", "conj"])), (1, 1, "", 0, 9, tree([2, 1], ["a", "b"])), (1, 2, "", 0, 0, []), (1, 3, "", 0, 9, tree([0, 1, 5], ["root", "x", "y"]))]
    p = graph.with_paths(spark.createDataFrame(rows, f"doc_id long, sent_idx int, text string, start int, end int, tokens {graph.TOKENS}"))
    got = p.select("sent_idx", graph.valid_tree(F.transform("tokens", lambda t: t["head"])).alias("ok"), F.transform("nodes", lambda t: t["anc"]).alias("anc")).orderBy("sent_idx").collect()
    assert [r.ok for r in got] == [True, False, False, False]
    assert got[0].anc == [[2], [], [2]] and got[1].anc == [[2], [1]] and got[2].anc is None
    assert graph.graph_findings(p.select("doc_id", "sent_idx", "text", "start", "end", "tokens")).count() == 0


def test_masks(spark):
    code = "a = 'x # no' # yes\n\"\"\"# no\"\"\"\n"
    out = one(spark, code, masking.comments(F.col("text"), F.lit("py")))
    assert out.split() == ["yes"] and len(out) == len(code) and out.count("\n") == 2
    page = "---\nt: 1\n---\nA [b](c) `d`\n```\ne\n```\n> f\n- g"
    out = one(spark, page, masking.markdown(F.col("text")))
    assert out.replace(" ", " ").split() == ["A", "[b]", "-", "g"] and len(out) == len(page)
    assert one(spark, None, masking.markdown(F.col("text"))) == ""
    assert one(spark, "<p a='>'>x&#65;&nope;&lt;<br>y<script>z", html_text(F.col("text"))) == "xA&nope;<\ny "


def test_spans(spark):
    outer = spark.createDataFrame([(1, 0, 10), (2, 0, 5)], "doc_id long, start int, end int")
    holes = spark.createDataFrame([(1, 2, 4), (1, 3, 6), (1, 9, 20)], "doc_id long, start int, end int")
    assert {tuple(r)[2:] for r in intervals.difference(outer, holes).where("doc_id = 1").collect()} == {(0, 2), (6, 9)}
    assert intervals.difference(outer, holes.limit(0)).count() == 2
    spans = spark.createDataFrame([(1, 1, 5, 2, 1), (1, 3, 7, 1, 2)], "doc_id long, start int, end int, prio int, seq int")
    got = intervals.segments(spans, spark.createDataFrame([(1, 8), (3, 2)], "doc_id long, length int")).collect()
    assert {(r.doc_id, r.start, r.end, r.owner) for r in got} == {(1, 0, 1, None), (1, 1, 3, 1), (1, 3, 7, 2), (1, 7, 8, None), (3, 0, 2, None)}


def test_logistic(spark):
    rows = spark.createDataFrame([(float(i), int(i > 0)) for i in range(-5, 6)], "x double, y int")
    w, b = vectors.logistic(rows, ["x"], "y", l2=0.1, epochs=30)
    assert vectors.probability([4.0], w, b) > 0.8 > 0.3 > vectors.probability([-4.0], w, b)
    assert vectors.logistic(rows.limit(0), ["x"], "y") == ([0.0], 0.0)
