from pyspark.sql import functions as F

from proselake.functions.text import line_column, sentence_array, spans, syntactic_words, word_count
from proselake.operators import detect, evaluate
from proselake.sources.html import html_text
from proselake.sources.readers import files
from proselake.streaming.hook import retry_decisions, retry_stream


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("x")).first().x


def test_sentences(spark):
    text = 'One stop. Two "quoted." three\nsame line! \n\nNew (block?) end'
    assert one(spark, text, sentence_array(F.col("text"))) == ["One stop.", 'Two "quoted."', "three\nsame line!", "New (block?)", "end"]
    assert one(spark, "“Left.” After\n \nthat… it. So\u2029on (end.]", sentence_array(F.col("text"))) == ["“Left.”", "After\n \nthat… it.", "So", "on (end.]"]
    assert one(spark, None, sentence_array(F.col("text"))) == []
    assert one(spark, "  ", sentence_array(F.col("text"))) == []


def test_words_and_spans(spark):
    assert one(spark, "it's 3 o’clock — né", word_count(F.col("text"))) == 4
    forms = ["I", "ca", "n't", ",", "it", "’s", "can", "not", "3.14", "https://a.b/c", "x", "-", "y"]
    assert one(spark, "I can't, it’s cannot 3.14 https://a.b/c x-y", syntactic_words(F.col("text"))) == forms
    assert one(spark, None, word_count(F.col("text"))) == 0
    got = one(spark, "😀a😀 b", spans(F.col("text"), "[ab]"))
    assert [(m.start, m.end, m.match) for m in got] == [(1, 2, "a"), (4, 5, "b")]
    at = one(spark, "ab\ncd", line_column(F.col("text"), F.lit(4)))
    assert (at.line, at.column) == (2, 2)


def found(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.rule, r.start, r.end, r.confidence) for r in detect.finding_rows(docs).orderBy("place").collect()]


def test_rules(spark):
    assert found(spark, None) == [] and found(spark, "") == []
    assert found(spark, "a — b. — — —") == [("em-dash-overuse", 2, 3, "medium")]
    got = found(spark, "😀 Sorry, sorryish. Moreover, x is it. Moreover, y. “Moreover, z.”")
    assert got == [("emoji", 0, 1, "low"), ("apology-reflex", 2, 7, "medium")] + [("opening-conjunction", a, a + 8, "medium") for a in (19, 38, 52)]
    assert found(spark, "They see clearly that it is. Clearly, that works.") == [("unsupported-certainty", 29, 36, "low")]
    assert found(spark, "It never ends? Unless it always does, no. It is not always so. Always, never, nobody.")[-1] == ("absolute-claim", 78, 84, "medium")
    assert found(spark, "A load-bearing wall. A load-bearing idea.") == [("emerging-slop-phrases", 23, 35, "low")]


def test_html(spark):
    got = one(spark, "<head><title>x</title></head><p>A &amp; <b>b</b><br>c<!-- no --><script>q()</script></p>", html_text(F.col("text")))
    assert got.split() == ["A", "&", "b", "c"]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("prose")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist/b.md").write_text("no")
    (tmp_path / "c.py").write_text("# x")
    (tmp_path / "d.bin").write_text("no")
    got = {(r.path.rsplit("/", 1)[1], r.kind, r.text) for r in files(spark, str(tmp_path)).collect()}
    assert got == {("a.md", "prose", "prose"), ("c.py", "comments", "# x")}


def test_auc_ties(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (0, 0)], "score int, label int")
    assert evaluate.auc(rows).first().auc == 0.875


def retries(spark, tmp_path, batches):
    """The stream's rows for these batches of events, each handed on as it is."""
    schema = "key long, seq long, dirty boolean, active boolean"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = retry_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()  # each batch is a query of its own, which goes on from the state of the last
    return {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_retry_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, (i * k) % 3 != 0, i % 4 != 0) for k in (1, 2) for i in range(12)]
    want = {tuple(r) for r in retry_decisions(spark.createDataFrame(rows, "key long, seq long, dirty boolean, active boolean")).collect()}
    # Rows of a batch in any order; the second batch has one that comes too late.
    first, second = [r for r in rows if r[1] < 7][::-1], [r for r in rows if r[1] >= 7][::-1] + [(1, 3, True, True)]
    got = retries(spark, tmp_path, [first, second])
    assert {r for r in got if r[4] != "late"} == want
    assert [r[:2] + r[3:] for r in got if r[4] == "late"] == [(1, 3, False, "late")]


def test_texts_take_linear_time():
    import time

    import pyarrow as pa

    from proselake.functions.places import cut_sentences, scan

    line = "However, it never ends — she said (maybe not) that it is “so”. NATO is not NATO; who is sorry? "

    def took(n):
        began = time.process_time()
        x = scan(pa.array([line * n + "\n\n" + line * n]), detect.PLACES)
        return time.process_time() - began, len(x[0].as_py()["sents"])

    took(100)
    (a, k), (b, m) = took(2000), took(8000)
    assert m == 4 * k and b < 4 * 2.3 * a / 2 + 1
    began = time.process_time()
    assert len(cut_sentences("It goes on and on here. " * 40_000)[0]) == 40_000 and time.process_time() - began < 2


def test_golden_spans(spark):
    """Expected by hand, from what the rules say, not from any pattern."""
    assert found(spark, "“Maybe so,” she said. Perhaps-like.") == [("hedge-phrase", 1, 6, "medium"), ("hedge-phrase", 22, 29, "medium")]
    again = "Quiet rivers carry heavy stones toward distant valleys."
    assert found(spark, f"{again}\n\nToward distant valleys quiet rivers carry heavy stones.") == [("semantic-redundancy", 57, 112, "medium")]
    assert found(spark, f"{again}\n\nToward distant valleys quiet rivers carry seven heavy stones.") == []
    assert found(spark, "One line ends here.\n- a\n- b") == [("list-without-break", 20, 23, "low")]
    assert found(spark, "The ABC one. ABC two. The XYZ (Xylo Yard Zone) and XYZ.") == [("unexplained-initialism", 4, 7, "medium")]
    assert found(spark, "Certainly. A. B. C. D. E. F. Certainly. G. Certainly. H. I. J. K. L. M. N. O. P. Certainly.") == [("unsupported-certainty", a, a + 9, c) for a, c in ((0, "low"), (29, "low"), (43, "low"), (81, "low"))]
    assert [f[3] for f in found(spark, "Certainly. A. B. C. D. E. Certainly. Certainly.")] == ["medium"] * 3


def test_shallow_parses(spark):
    from proselake.operators import graph, shallow

    docs = spark.createDataFrame([(1, "The old river quietly carried stones. And they rested.\n\nNo end"), (2, None), (3, "— ?")], "doc_id long, text string")
    rows = {(r.doc_id, r.sent_idx): r for r in shallow.parses(docs).collect()}
    assert sorted(rows) == [(1, 0), (1, 1), (1, 2), (3, 0)] and rows[1, 2].par_idx == 1
    assert [(t.form, t.upos, t.head, t.deprel) for t in rows[1, 0].tokens] == [("The", "DET", 2, "det"), ("old", "NOUN", 3, "nsubj"), ("river", "VERB", 0, "root"), ("quietly", "ADV", 5, "advmod"), ("carried", "VERB", 3, "advcl"), ("stones", "NOUN", 5, "obj"), (".", "PUNCT", 3, "punct")]
    assert all(graph.is_tree([t.head for t in r.tokens]) for r in rows.values())
    deep = [{"id": i, "form": "x", "upos": "NOUN", "head": i - 1, "deprel": "compound" if i % 3 else "conj", "start": i, "end": i + 1} for i in range(1, 8)]
    nodes = graph._linked(deep)
    assert nodes[6]["anc"] == [6, 5, 4, 3, 2, 1] and nodes[2]["sub"] == [3, 4, 5, 6, 7] and [n["run"] for n in nodes] == [1, 2, 1, 1, 2, 1, 1]
    assert graph._linked([{**deep[0], "head": 2}, {**deep[1], "head": 1}])[0]["anc"] == [2]
    assert not graph.is_tree([2, 1]) and not graph.is_tree([]) and not graph.is_tree([0, 0]) and graph.is_tree([0, 1, 1])
