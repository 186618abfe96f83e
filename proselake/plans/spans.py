"""Registered queries on spans, windows and sequences, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proselake.functions.text import paragraphs, sentences, spans, word_count
from proselake.operators import intervals as iv
from proselake.plans import sql
from proselake.plans.seeds import seeded
from proselake.sources.readers import table

KINDS = {"absolute": (1, r"(?i)\b(?:always|never|everyone|nobody|nothing|guaranteed|certainly)\b"), "sign": (2, "[“”\"—]"), "triple": (3, r"\b(?:the|it|is|we|that|never) [a-z]+ [a-z]+\b")}


def _long(df):
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def marks(spark, sf_dir):
    """(doc_id, kind, prio, start, end, seq)."""
    docs = seeded(spark, sf_dir)
    named = lambda k, n: lambda h: F.struct(F.lit(k).alias("kind"), F.lit(n).alias("prio"), h["start"].alias("start"), h["end"].alias("end"))
    every = F.concat(*(F.transform(spans(F.col("text"), p), named(k, n)) for k, (n, p) in KINDS.items()))
    m = docs.select("doc_id", F.explode_outer(every).alias("m")).where("m is not null").select("doc_id", "m.*")
    return m.withColumn("seq", F.col("start") * 10 + F.col("prio"))


def _sents(spark, sf_dir):
    s = seeded(spark, sf_dir).select("doc_id", F.posexplode_outer(sentences(F.col("text"))).alias("i", "s")).where("i is not null")
    return s.select("doc_id", "i", "s.start", "s.end", word_count(F.col("s.text")).alias("n"))


def _pars(spark, sf_dir):
    p = seeded(spark, sf_dir).select("doc_id", F.posexplode_outer(paragraphs(F.col("text"))).alias("j", "p")).where("j is not null")
    return p.select("doc_id", "j", "p.start", "p.end")


def sentence_paragraphs(spark, sf_dir):
    return _long(iv.overlapping(_sents(spark, sf_dir), _pars(spark, sf_dir)).select("a.doc_id", F.col("a.i").alias("sent_idx"), F.col("b.j").alias("par_idx")))


def mark_sentences(spark, sf_dir):
    m = marks(spark, sf_dir).select("doc_id", "start", "kind")
    return _long(iv.first_holder(m, _sents(spark, sf_dir), "i").withColumnsRenamed({"i": "sent_idx", "start": "start_at"}))


def lone_marks(spark, sf_dir):
    m = marks(spark, sf_dir)
    return _long(iv.overlapping(m.where("kind = 'triple'"), m, "left_anti", "absolute").select("doc_id", F.col("start").alias("start_at")))


def marked_sentences(spark, sf_dir):
    return _long(iv.overlapping(_sents(spark, sf_dir), marks(spark, sf_dir), "left_semi", "sign").select("doc_id", F.col("i").alias("sent_idx")))


def readable_ranges(spark, sf_dir):
    # All spans of a document lie in its row, so that nothing is joined or sorted.
    d = seeded(spark, sf_dir).select("doc_id", paragraphs(F.col("text")).alias("pars"), *(spans(F.col("text"), p).alias(k) for k, (_, p) in KINDS.items()))
    holes = (F.concat(*(F.col(f"{k}.{side}") for k in KINDS)) for side in ("start", "end"))
    d = d.select("doc_id", F.explode_outer(iv.uncovered(F.col("pars.start"), F.col("pars.end"), *holes)).alias("r")).where("r is not null").select("doc_id", "r.*")
    return _long(d.withColumnsRenamed({"start": "start_at", "end": "end_at"}))


def mark_segments(spark, sf_dir):
    docs = seeded(spark, sf_dir).where(F.length("text") > 0)
    s = iv.segments(marks(spark, sf_dir), docs.select("doc_id", F.length("text").alias("length")))
    return _long(s.withColumnsRenamed({"start": "start_at", "end": "end_at"}))


def mark_clusters(spark, sf_dir):
    c = iv.clusters(marks(spark, sf_dir), 60).where("n >= 2").drop("cluster")
    return _long(c.withColumnsRenamed({"start": "start_at", "end": "end_at"}))


def short_runs(spark, sf_dir):
    r = iv.runs(_sents(spark, sf_dir).withColumn("short", F.col("n") <= 8), "short", "i")
    return _long(r.withColumnRenamed("first", "first_idx"))


def neighbour_counts(spark, sf_dir):
    """Marks in each sentence, within three sentences around it, in the next six, and in those before and after."""
    held = iv.first_holder(marks(spark, sf_dir).select("doc_id", "start", "kind"), _sents(spark, sf_dir), "i").groupBy("doc_id", "i").agg(F.count(F.lit(1)).alias("k"))
    s = _sents(spark, sf_dir).join(held, ["doc_id", "i"], "left").fillna(0, ["k"])
    w = Window.partitionBy("doc_id").orderBy("i")
    return _long(s.select("doc_id", F.col("i").alias("sent_idx"), "k", F.sum("k").over(w.rangeBetween(-3, 3)).alias("around"), F.sum("k").over(w.rangeBetween(0, 5)).alias("ahead"), F.lag("k").over(w).alias("k_before"), F.lead("k").over(w).alias("k_after")))


def load_buffer(spark, sf_dir):
    s = _sents(spark, sf_dir).withColumn("release", F.col("n") <= 3)
    return iv.decayed(s, "n", "i", 0.5, "release").select("doc_id", F.col("i").cast("long").alias("sent_idx"), "buffer")


def heaviest_windows(spark, sf_dir):
    """The three heaviest windows of three sentences that don't overlap."""
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(-2, 0)
    s = _sents(spark, sf_dir).select("doc_id", F.min("i").over(w).alias("start"), (F.col("i") + 1).alias("end"), F.avg("n").over(w).alias("score"), F.count("n").over(w).alias("k")).where("k = 3")
    return _long(iv.best_apart(s, 3)).select("doc_id", "rank", F.col("start").alias("first_idx"), F.round("score", 6).alias("score"))


def counted_words(spark, sf_dir):
    """A counting policy: words of four letters or more that no mark touches, per document."""
    words = seeded(spark, sf_dir).select("doc_id", F.explode_outer(spans(F.col("text"), r"[A-Za-z]{4,}")).alias("w")).where("w is not null").select("doc_id", "w.start", "w.end")
    return iv.overlapping(words, marks(spark, sf_dir), "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))


def _regions(spark, sf_dir):
    """Default regions: the document and its paragraphs; some are spoilt, so that the checks find something."""
    docs = seeded(spark, sf_dir)
    whole = docs.select("doc_id", F.lit("document").alias("id"), F.lit("document").alias("role"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(None).cast("string").alias("parent"))
    name = F.concat(F.lit("p"), F.when(F.col("doc_id") % 7 == 0, F.least("j", F.lit(1))).otherwise(F.col("j")).cast("string"))
    pars = _pars(spark, sf_dir).select("doc_id", name.alias("id"), F.lit("paragraph").alias("role"), "start", F.when(F.col("doc_id") % 11 == 0, F.col("end") + 10000000).otherwise(F.col("end")).alias("end"), F.when(F.col("doc_id") % 13 == 0, "nowhere").otherwise("document").alias("parent"))
    return whole.unionByName(pars)


def region_checks(spark, sf_dir):
    """Per document: regions, ids used twice, spans out of the text, parents that don't exist."""
    r = _regions(spark, sf_dir)
    size = seeded(spark, sf_dir).select("doc_id", F.length("text").alias("size"))
    twice = r.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_twice"))
    lost = r.where("parent is not null").alias("c").join(r.alias("p"), F.expr("c.doc_id = p.doc_id and c.parent = p.id"), "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_orphans"))
    out = r.join(size, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_regions"), F.count_if(F.expr("start < 0 or end < start or end > size")).alias("n_outside"))
    return out.join(twice, "doc_id", "left").join(lost, "doc_id", "left").fillna(0, ["n_twice", "n_orphans"])


def latest_results(spark, sf_dir):
    """Of each user's results only those of the newest generation (ten events each): late ones are dropped."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 10).alias("generation"))
    return e.withColumn("newest", F.max("generation").over(Window.partitionBy("user_id"))).where("generation = newest").select("user_id", "event_id", "generation")


QUERIES = [counted_words, region_checks, latest_results, sentence_paragraphs, mark_sentences, lone_marks, marked_sentences, readable_ranges, mark_segments, mark_clusters, short_runs, neighbour_counts, load_buffer, heaviest_windows]

_MARKS = "marks AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {n} AS prio, start_at, end_at, start_at * 10 + {n} AS seq FROM ({sql.hits(p)})" for k, (n, p) in KINDS.items()) + ")"
_BASE = f"WITH RECURSIVE {sql.SEEDED}, {sql.sentences()}, {sql.paragraphs()}, {_MARKS}"
_N = sql.words("text")
_MERGED = """reach AS (SELECT *, max(end_at) OVER (PARTITION BY doc_id ORDER BY start_at, end_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM marks),
isl AS (SELECT *, sum(CASE WHEN r >= start_at THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start_at, end_at) AS g FROM reach), holes AS (SELECT doc_id, min(start_at) AS a, max(end_at) AS z FROM isl GROUP BY doc_id, g)"""


def oracle_sql() -> dict[str, str]:
    inside = "m.doc_id = s.doc_id AND m.start_at >= s.start_at AND m.start_at < s.end_at"
    return {
        "counted_words": f"{_BASE}, w AS ({sql.hits('[A-Za-z]{4,}')}) SELECT doc_id, count(*) AS n_words FROM w WHERE NOT EXISTS (SELECT 1 FROM marks o WHERE o.doc_id = w.doc_id AND o.end_at > w.start_at AND o.start_at < w.end_at) GROUP BY doc_id",
        "region_checks": f"""{_BASE}, r AS (SELECT doc_id, 'document' AS id, 0 AS a, length(text) AS z, CAST(NULL AS VARCHAR) AS parent FROM seeded UNION ALL SELECT doc_id, 'p' || CASE WHEN doc_id % 7 = 0 THEN least(i, 1) ELSE i END, start_at, CASE WHEN doc_id % 11 = 0 THEN end_at + 10000000 ELSE end_at END, CASE WHEN doc_id % 13 = 0 THEN 'nowhere' ELSE 'document' END FROM pars)
            SELECT s.doc_id, (SELECT count(*) FROM r WHERE r.doc_id = s.doc_id) AS n_regions, (SELECT count(*) FROM r WHERE r.doc_id = s.doc_id AND (a < 0 OR z < a OR z > length(s.text))) AS n_outside, (SELECT count(*) FROM (SELECT id FROM r WHERE r.doc_id = s.doc_id GROUP BY id HAVING count(*) > 1)) AS n_twice,
            (SELECT count(*) FROM r WHERE r.doc_id = s.doc_id AND parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r x WHERE x.doc_id = r.doc_id AND x.id = r.parent)) AS n_orphans FROM seeded s""",
        "latest_results": "SELECT user_id, event_id, event_id // 10 AS generation FROM events QUALIFY event_id // 10 = max(event_id // 10) OVER (PARTITION BY user_id)",
        "sentence_paragraphs": f"{_BASE} SELECT s.doc_id, s.i AS sent_idx, p.i AS par_idx FROM sents s JOIN pars p ON s.doc_id = p.doc_id AND s.end_at > p.start_at AND s.start_at < p.end_at",
        "mark_sentences": f"{_BASE} SELECT m.doc_id, m.start_at, kind, min(s.i) AS sent_idx FROM marks m LEFT JOIN sents s ON {inside} GROUP BY ALL",
        "lone_marks": f"{_BASE} SELECT doc_id, start_at FROM marks m WHERE kind = 'triple' AND NOT EXISTS (SELECT 1 FROM marks o WHERE o.kind = 'absolute' AND o.doc_id = m.doc_id AND o.end_at > m.start_at AND o.start_at < m.end_at)",
        "marked_sentences": f"{_BASE} SELECT doc_id, i AS sent_idx FROM sents s WHERE EXISTS (SELECT 1 FROM marks o WHERE o.kind = 'sign' AND o.doc_id = s.doc_id AND o.end_at > s.start_at AND o.start_at < s.end_at)",
        # By characters: those of a paragraph that no mark covers, runs of which are the ranges.
        "readable_ranges": f"""{_BASE}, chars AS (SELECT p.doc_id, p.start_at AS outer_start, unnest(range(p.start_at, p.end_at)) AS c FROM pars p), free AS (SELECT * FROM chars x WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.doc_id = x.doc_id AND m.start_at <= x.c AND m.end_at > x.c)),
            g AS (SELECT *, c - row_number() OVER (PARTITION BY doc_id, outer_start ORDER BY c) AS g FROM free) SELECT doc_id, outer_start, min(c) AS start_at, max(c) + 1 AS end_at FROM g GROUP BY doc_id, outer_start, g""",
        "mark_segments": f"""{_BASE}, chars AS (SELECT doc_id, unnest(range(0, length(text))) AS c FROM seeded WHERE length(text) > 0), owned AS (SELECT x.doc_id, c, min(struct_pack(prio := prio, seq := seq)).seq AS owner FROM chars x LEFT JOIN marks m ON m.doc_id = x.doc_id AND m.start_at <= x.c AND m.end_at > x.c GROUP BY ALL),
            g AS (SELECT *, c - row_number() OVER (PARTITION BY doc_id, owner ORDER BY c) AS g FROM owned) SELECT doc_id, owner, min(c) AS start_at, max(c) + 1 AS end_at FROM g GROUP BY doc_id, owner, g""",
        "mark_clusters": f"""{_BASE}, l AS (SELECT *, lag(end_at) OVER w AS before FROM marks WINDOW w AS (PARTITION BY doc_id ORDER BY start_at, end_at)), c AS (SELECT *, sum(CASE WHEN start_at - before <= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start_at, end_at) AS g FROM l)
            SELECT doc_id, min(start_at) AS start_at, arg_max(end_at, start_at * 1000000 + end_at) AS end_at, count(*) AS n FROM c GROUP BY doc_id, g HAVING count(*) >= 2""",
        "short_runs": f"""{_BASE}, f AS (SELECT doc_id, i, {_N} <= 8 AS short FROM sents), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, short ORDER BY i) AS g FROM f), r AS (SELECT doc_id, min(i) AS first_idx, count(*) AS n FROM g WHERE short GROUP BY doc_id, g)
            SELECT doc_id, first_idx, n FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_idx) = 1""",
        "neighbour_counts": f"""{_BASE}, h AS (SELECT m.doc_id, m.kind, m.start_at, min(s.i) AS i FROM marks m JOIN sents s ON {inside} GROUP BY ALL), k AS (SELECT s.doc_id, s.i, count(h.i) AS k FROM sents s LEFT JOIN h ON h.doc_id = s.doc_id AND h.i = s.i GROUP BY ALL)
            SELECT a.doc_id, a.i AS sent_idx, a.k, (SELECT sum(b.k) FROM k b WHERE b.doc_id = a.doc_id AND abs(b.i - a.i) <= 3) AS around, (SELECT sum(b.k) FROM k b WHERE b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 5) AS ahead, b.k AS k_before, c.k AS k_after
            FROM k a LEFT JOIN k b ON b.doc_id = a.doc_id AND b.i = a.i - 1 LEFT JOIN k c ON c.doc_id = a.doc_id AND c.i = a.i + 1""",
        "load_buffer": f"""{_BASE}, f AS (SELECT doc_id, i, {_N} AS n FROM sents), b(doc_id, i, buffer) AS (SELECT doc_id, i, CASE WHEN n <= 3 THEN 0.0::DOUBLE ELSE n::DOUBLE END FROM f WHERE i = 0 UNION ALL SELECT f.doc_id, f.i, CASE WHEN f.n <= 3 THEN 0.0::DOUBLE ELSE b.buffer * 0.5 + f.n END FROM b JOIN f ON f.doc_id = b.doc_id AND f.i = b.i + 1)
            SELECT doc_id, i AS sent_idx, round(buffer, 6) AS buffer FROM b""",
        # Greedy by recursion: the best window left after those taken.
        "heaviest_windows": f"""{_BASE}, f AS (SELECT doc_id, i, {_N} AS n FROM sents), w AS (SELECT * FROM (SELECT doc_id, i - 2 AS a, avg(n) OVER o AS score, count(*) OVER o AS k FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE k = 3),
            w1 AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, a) = 1), w2 AS (SELECT w.* FROM w JOIN w1 ON w.doc_id = w1.doc_id AND abs(w.a - w1.a) >= 3 QUALIFY row_number() OVER (PARTITION BY w.doc_id ORDER BY w.score DESC, w.a) = 1),
            w3 AS (SELECT w.* FROM w JOIN w1 ON w.doc_id = w1.doc_id AND abs(w.a - w1.a) >= 3 JOIN w2 ON w.doc_id = w2.doc_id AND abs(w.a - w2.a) >= 3 QUALIFY row_number() OVER (PARTITION BY w.doc_id ORDER BY w.score DESC, w.a) = 1)
            SELECT doc_id, 0 AS rank, a AS first_idx, round(score, 6) AS score FROM w1 UNION ALL SELECT doc_id, 1, a, round(score, 6) FROM w2 UNION ALL SELECT doc_id, 2, a, round(score, 6) FROM w3""",
    }
