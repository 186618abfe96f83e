"""Registered queries on reports, scores, evaluation and records, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proselake.functions.text import word_array, word_count
from proselake.operators import detect, evaluate, rules, score, shallow, vectors
from proselake.plans import parses as parsed
from proselake.plans import sql
from proselake.plans.rules_sql import FOUND
from proselake.plans.seeds import seeded
from proselake.sinks import render
from proselake.sources import records
from proselake.sources.readers import table


def _path():
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def _found(spark, sf_dir):
    docs = seeded(spark, sf_dir)
    f = detect.findings(docs).select("doc_id", "source", "text", F.explode_outer("found").alias("f")).where("f is not null").select("doc_id", "source", "text", "f.*")
    f = f.withColumns({"path": _path(), "match": F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))})
    return f.withColumn("message", F.concat(F.lit("check: "), "match"))


def annotation_lines(spark, sf_dir):
    return render.annotations(_found(spark, sf_dir)).select("path", F.col("start").cast("long").alias("start_at"), "rule", "annotation")


def terminal_lines(spark, sf_dir):
    return render.stylish(_found(spark, sf_dir)).select("path", F.col("start").cast("long").alias("start_at"), "rule", "line_text")


def compact_groups(spark, sf_dir):
    return render.compact(_found(spark, sf_dir))


def _reported(spark, sf_dir):
    return rules.report(seeded(spark, sf_dir).withColumn("path", _path()), "path")


def result_json(spark, sf_dir):
    return render.json_lines(_reported(spark, sf_dir))


def exit_status(spark, sf_dir):
    return render.exit_status(_reported(spark, sf_dir), 10)


def document_scores(spark, sf_dir):
    return score.scored(seeded(spark, sf_dir))


def evidence_clusters(spark, sf_dir):
    e = score.evidence_clusters(seeded(spark, sf_dir))
    return e.select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), F.col("n_signals").cast("long").alias("n_signals"), "confidence")


def document_clusters(spark, sf_dir):
    e = score.document_clusters(seeded(spark, sf_dir))
    return e.select("doc_id", *(F.col(c).cast("long").alias(n) for c, n in (("start", "start_at"), ("end", "end_at"), ("n_signals", "n_signals"), ("n_rules", "n_rules"))))


def top_rules(spark, sf_dir):
    """The three most frequent rules of each source."""
    n = _found(spark, sf_dir).groupBy("source", "rule").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "rule"))
    return n.withColumn("place", place.cast("long")).where("place <= 3")


def rule_changes(spark, sf_dir):
    """Rules that only one of a document and its successor shows (a full outer comparison)."""
    has = _found(spark, sf_dir).select("doc_id", "rule").distinct()
    nxt = has.select((F.col("doc_id") - 1).alias("doc_id"), "rule")
    both = has.withColumn("a", F.lit(True)).join(nxt.withColumn("b", F.lit(True)), ["doc_id", "rule"], "full_outer")
    return both.where("a is null or b is null").select("doc_id", "rule", F.when(F.col("b").isNull(), "gone").otherwise("new").alias("change"))


def held_out_sample(spark, sf_dir):
    """Of each language the eight documents that come first by a hash of language and text."""
    order = F.sha2(F.concat(F.coalesce("lang", F.lit("")), F.lit("\x01"), F.coalesce("text", F.lit(""))), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", order.alias("h"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")).cast("long")).where("place <= 8").drop("h")


def _scored(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", F.col("quality").alias("label"), F.least(F.lit(100), F.floor(word_count(F.col("text")) / 10)).cast("long").alias("score"))


def best_threshold(spark, sf_dir):
    b = evaluate.best_threshold(evaluate.sweep(_scored(spark, sf_dir), list(range(0, 101, 2))))
    return b.withColumn("threshold", F.col("threshold").cast("long"))


def score_quantiles(spark, sf_dir):
    return evaluate.quantiles(_scored(spark, sf_dir), "lang", "score", [0.1, 0.5, 0.95])


def score_ranks(spark, sf_dir):
    return evaluate.nearest_rank(_scored(spark, sf_dir), "lang", "score", 0.95)


def tag_vectors(spark, sf_dir):
    look = vectors.tag_count_look(parsed.story_tags())
    counted = shallow.looked(parsed.own_texts(spark, sf_dir), lambda: look, f"doc_id long, {vectors.COUNTED}", whole=True)
    return vectors.tfidf_of(counted).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def scaled_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("n_words"), F.length("text").alias("n_marks"))
    return vectors.scaled(docs, ["n_words", "n_marks"]).select("doc_id", F.round("n_words", 6).alias("n_words"), F.round("n_marks", 6).alias("n_marks"))


def attachment_scores(spark, sf_dir):
    """Share of tokens with the right head, and with head and relation, against a guess: the token before, one relation."""
    t = parsed.parses(spark, sf_dir).select(F.explode("tokens").alias("t")).select("t.*")
    head, rel = F.col("head") == F.col("id") - 1, F.col("deprel").isin("nsubj", "punct")
    return t.groupBy("deprel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(head.cast("double")), 6).alias("uas"), F.round(F.avg((head & rel).cast("double")), 6).alias("las"))


def sensitivity_tallies(spark, sf_dir):
    """Findings by rule, by source and by severity in one pass."""
    f = _found(spark, sf_dir)
    sets = [[F.col("rule")], [F.col("source")], [F.col("severity")]]
    return f.groupingSets(sets, "rule", "source", "severity").agg(F.count(F.lit(1)).alias("n")).select("rule", "source", "severity", "n")


def _lines(spark, sf_dir):
    """The conversations as transcript lines, in a dialect by conv_id, each file with a broken last line."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    block = lambda kind: F.array(F.struct(F.lit(kind).alias("type"), F.col("text").alias("text")))
    plain = F.when(role == "user", F.to_json(F.struct(role.alias("type"), F.struct(role.alias("role"), F.col("text").alias("content")).alias("message")))).otherwise(F.to_json(F.struct(role.alias("type"), F.struct(role.alias("role"), block("text").alias("content")).alias("message"))))
    items = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), role.alias("role"), block("output_text").alias("content")).alias("payload")))
    third = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(role.alias("role"), block("text").alias("content")).alias("message")))
    line = F.when(F.col("conv_id") % 3 == 0, plain).when(F.col("conv_id") % 3 == 1, items).otherwise(third)
    lines = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), line.alias("line"))
    return lines.union(c.groupBy("conv_id").agg((F.max("turn") + 1).alias("n")).select("conv_id", "n", F.lit('{"type":"assist')))


def transcript_texts(spark, sf_dir):
    m = records.transcript_messages(_lines(spark, sf_dir), most=3)
    return m.select(F.col("file").alias("conv_id"), F.col("line_no").alias("turn"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def conllu_tokens(spark, sf_dir):
    """The parses written as CoNLL-U with comments, ranges and empty nodes, and read back."""
    p = parsed.parses(spark, sf_dir)
    row = lambda t: F.concat_ws("\t", t["id"].cast("string"), t["form"], F.lit("_"), t["upos"], F.lit("_"), F.lit("_"), t["head"].cast("string"), t["deprel"], F.lit("_"), F.when(t["id"] == 2, "RuleWeight=4").otherwise("_"))
    block = F.concat_ws("\n", F.concat(F.lit("# family = s"), F.col("sent_idx").cast("string")), F.lit("1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_"), F.array_join(F.transform("tokens", row), "\n"), F.lit("8.1\ty\t_\t_\t_\t_\t_\t_\t_\t_"))
    files = p.select("doc_id", "sent_idx", block.alias("b")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_idx", "b"))).alias("x"))
    files = files.select(F.col("doc_id").alias("path"), F.array_join(F.transform("x", lambda x: x["b"]), "\n\n").alias("text"))
    s = records.conllu_sentences(files).select(F.col("path").alias("doc_id"), F.col("sent_idx").cast("long").alias("sent_idx"), "family", "text", F.explode(F.arrays_zip("tokens", "lemmas", "weights")).alias("z"))
    return s.select("doc_id", "sent_idx", "family", "text", F.col("z.tokens.id").cast("long").alias("id"), F.col("z.tokens.form").alias("form"), F.col("z.tokens.head").cast("long").alias("head"), F.col("z.lemmas").alias("lemma"), F.col("z.weights").alias("weight"))


TERMS = [(1, "however", ["moreover"], "general"), (2, "However", [], "project"), (1, "sorry", ["apologies"], "general"), (3, "NATO", [], "team"), (1, "nato", [], "general")]


def glossary_hits(spark, sf_dir):
    entries = records.glossary(spark.createDataFrame(TERMS, "layer int, term string, surfaces array<string>, status string"))
    words = seeded(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.transform(word_array(F.col("text")), lambda w: F.lower(w)))).alias("word"))
    return records.looked_up(words, entries).select("doc_id", "word", F.col("layer").cast("long").alias("layer"), "status")


QUERIES = [annotation_lines, terminal_lines, compact_groups, result_json, exit_status, document_scores, evidence_clusters, document_clusters, top_rules, rule_changes, held_out_sample, best_threshold, score_quantiles, score_ranks, tag_vectors, scaled_features, attachment_scores, sensitivity_tallies, transcript_texts, conllu_tokens, glossary_hits]

_PATH = "source || '/' || doc_id || '.md'"
_F = f"WITH RECURSIVE {FOUND}, fp AS (SELECT f.*, s.source, s.text, {_PATH.replace('doc_id', 'f.doc_id')} AS path, substr(s.text, start_at + 1, end_at - start_at) AS match FROM found f JOIN seeded s ON s.doc_id = f.doc_id)"


def _line(at: str) -> str:
    return f"len(string_split(substr(text, 1, {at}), chr(10)))"


def _column(at: str) -> str:
    return f"(length(string_split(substr(text, 1, {at}), chr(10))[-1]) + 1)"


def _escape(x: str, more: bool = False) -> str:
    x = f"replace(replace(replace({x}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
    return f"replace(replace({x}, ':', '%3A'), ',', '%2C')" if more else x


def _case(of: dict, key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) + f" ELSE {other} END"


def oracle_sql() -> dict[str, str]:
    counts = f"""n AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warn') AS w, count(*) FILTER (severity = 'info') AS i FROM found GROUP BY doc_id),
        rep AS (SELECT {_PATH} AS path, {sql.words("text")} AS k, coalesce(e, 0) AS e, coalesce(w, 0) AS w, coalesce(i, 0) AS i FROM seeded LEFT JOIN n USING (doc_id))"""
    scored = f"scored AS (SELECT doc_id, lang, quality AS label, least(100, CAST(floor({sql.words('text')} / 10) AS BIGINT)) AS score FROM documents JOIN labels USING (doc_id))"
    category = {k: f"'{v}'" for k, v in detect.CATEGORY.items()}
    weight = _case(score.WEIGHT, f"({_case(category, 'rule', chr(39) + 'other' + chr(39))})", "1")
    words = r"(?:https?://|www\.)[^\s]+|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|\p{N}+(?:[.,:]\p{N}+)*"
    tokens = f"(len(list_filter(regexp_extract_all(text, {sql.q(words)}), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) + len(list_filter(regexp_extract_all(text, {sql.q(words)}), lambda w: regexp_matches(w, '(?i)^(cannot|.+(n[''’]t|[''’](s|re|ve|ll|d|m)))$') AND NOT regexp_matches(w, '^(https?://|www\\.)'))))"
    weigh = lambda x: f"CASE WHEN {x}.confidence = 'high' THEN 3.0 WHEN {x}.confidence = 'medium' THEN 2.0 WHEN {x}.rule IN ('absolute-claim', 'passive-actor-hiding', 'em-dash-overuse') THEN 0.25 ELSE 1.0 END"
    same = "greatest(k.z - k.a, x.z - x.a) <= 120 AND least(k.z - k.a, x.z - x.a) > 0 AND greatest(0, least(k.z, x.z) - greatest(k.a, x.a)) >= 0.8 * least(k.z - k.a, x.z - x.a)"
    grouped = f"""h AS (SELECT p.doc_id, p.start_at AS pa, p.end_at AS pz, struct_pack(a := f.start_at, z := f.end_at, rule := f.rule, confidence := f.confidence) AS x, row_number() OVER (PARTITION BY p.doc_id, p.start_at ORDER BY f.start_at, f.end_at, f.rule, f.confidence) AS n
            FROM pars p JOIN found f ON f.doc_id = p.doc_id AND f.end_at > p.start_at AND f.start_at < p.end_at),
            step(doc_id, pa, pz, n, kept) AS (SELECT doc_id, pa, pz, n, [x] FROM h WHERE n = 1 UNION ALL SELECT h.doc_id, h.pa, h.pz, h.n, CASE WHEN len(list_filter(kept, lambda k: {same})) = 0 THEN list_append(kept, x)
                ELSE list_transform(kept, lambda k, i: CASE WHEN i = list_position(list_transform(kept, lambda k: {same}), TRUE) AND {weigh("x")} > {weigh("k")} THEN x ELSE k END) END FROM step s JOIN h ON h.doc_id = s.doc_id AND h.pa = s.pa AND h.n = s.n + 1),
            o AS (SELECT doc_id, pa, pz, unnest(kept) AS k FROM step QUALIFY n = max(n) OVER (PARTITION BY doc_id, pa)),
            g AS (SELECT doc_id, pa, pz, count(*) AS n, sum({weigh("k")}) AS s, count(DISTINCT k.rule) AS r, count(DISTINCT k.rule) FILTER (k.rule NOT IN ('absolute-claim', 'passive-actor-hiding', 'em-dash-overuse')) AS b, count(DISTINCT {_case(category, 'k.rule', chr(39) + 'other' + chr(39))}) AS c FROM o GROUP BY ALL)"""
    return {
        "annotation_lines": f"""{_F} SELECT path, start_at, rule, '::' || CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'notice' END || ' file=' || {_escape("path", True)} || ',line=' || {_line("start_at")} || ',col=' || {_column("start_at")} || ',endLine=' || {_line("end_at")} || ',endColumn=' || {_column("end_at")} || ',title=' || rule || '::' || {_escape("'check: ' || match")} AS annotation FROM fp""",
        "terminal_lines": f"""{_F} SELECT path, start_at, rule, '  ' || lpad({_line("start_at")} || ':' || {_column("start_at")}, 9, ' ') || '  ' || rpad(severity, 7, ' ') || '  check: ' || match || '  ' || rule AS line_text FROM fp""",
        "compact_groups": f"""{_F}, x AS (SELECT severity, rule, path, start_at, trim(regexp_replace(match, '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM fp), e AS (SELECT *, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS ex FROM x),
            d AS (SELECT severity, rule, ex, min(struct_pack(path := path, s := start_at)) AS pos FROM e WHERE length(ex) > 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY severity, rule ORDER BY pos) AS n FROM d),
            s AS (SELECT severity, rule, string_agg('“' || ex || '”', '; ' ORDER BY n) AS shown, count(*) AS k FROM r WHERE n <= 3 GROUP BY ALL), c AS (SELECT severity, rule, count(*) AS n FROM x GROUP BY ALL)
            SELECT c.severity, c.rule, n, c.rule || ' [' || CASE c.severity WHEN 'warn' THEN 'warning' ELSE c.severity END || '] ×' || n || CASE WHEN k > 0 THEN ' Examples: ' || shown || CASE WHEN n > k THEN '; +' || (n - k) || ' more' ELSE '' END ELSE '' END AS summary FROM c LEFT JOIN s ON s.severity = c.severity AND s.rule = c.rule""",
        "result_json": f"""WITH {FOUND}, {counts} SELECT path, CAST(to_json(struct_pack("filePath" := path, "errorCount" := e, "warningCount" := w, "infoCount" := i, "wordCount" := k, "findingsPerThousandWords" := CASE WHEN k > 0 THEN CAST(floor(1000 * (e + w + i) / k * 10 + 0.5) / 10 AS DOUBLE) ELSE 0.0::DOUBLE END)) AS VARCHAR) AS json FROM rep""",
        "exit_status": f"WITH {FOUND}, {counts}, t AS (SELECT CAST(sum(e) AS BIGINT) AS error_count, CAST(sum(w) AS BIGINT) AS warn_count, CAST(sum(i) AS BIGINT) AS info_count FROM rep) SELECT *, CASE WHEN error_count > 0 OR warn_count > 10 THEN 1 ELSE 0 END AS status FROM t",
        "document_scores": f"""WITH {FOUND}, w AS (SELECT doc_id, sum({weight}) AS w FROM found GROUP BY doc_id), s AS (SELECT doc_id, {tokens} AS n_tokens FROM seeded), c AS (SELECT doc_id, n_tokens, CASE WHEN n_tokens > 0 THEN CAST(least(100, floor(coalesce(w, 0) / n_tokens * 100 * 6 + 0.5)) AS BIGINT) ELSE 0 END AS score FROM s LEFT JOIN w USING (doc_id))
            SELECT *, CASE WHEN score < 20 THEN 'Reads clean' WHEN score < 45 THEN 'Mostly clean' WHEN score < 60 THEN 'Some AI-style' WHEN score < 80 THEN 'Noticeably AI-styled' ELSE 'Reads AI-styled' END AS verdict FROM c""",
        # The collapse of overlapping hits walks through each paragraph's hits with the list of those kept.
        "evidence_clusters": f"""WITH RECURSIVE {FOUND}, {grouped} SELECT doc_id, pa AS start_at, pz AS end_at, n AS n_signals, CASE WHEN s >= 9 AND r >= 3 AND c >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM g WHERE s >= 4 AND r >= 2 AND b >= 2 AND c >= 2""",
        "document_clusters": f"""WITH RECURSIVE {FOUND}, {grouped}, own AS (SELECT doc_id, count(*) AS own FROM g WHERE s >= 4 AND r >= 2 AND b >= 2 AND c >= 2 GROUP BY doc_id),
            t AS (SELECT doc_id, count(*) AS n, sum({weigh("found")}) AS s, count(DISTINCT rule) AS r, count(DISTINCT rule) FILTER (rule NOT IN ('absolute-claim', 'passive-actor-hiding', 'em-dash-overuse')) AS b, count(DISTINCT {_case(category, 'rule', chr(39) + 'other' + chr(39))}) AS c,
            first(struct_pack(a := start_at, z := end_at) ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, start_at, end_at DESC) AS f FROM found GROUP BY doc_id)
            SELECT doc_id, f.a AS start_at, f.z AS end_at, n AS n_signals, r AS n_rules FROM t JOIN seesaw_words USING (doc_id) LEFT JOIN own USING (doc_id) WHERE s >= 12 AND n * 1000 >= 20 * n_tokens AND r >= 5 AND b >= 4 AND c >= 3 AND coalesce(own, 0) < 2""",
        "top_rules": f"{_F}, c AS (SELECT source, rule, count(*) AS n FROM fp GROUP BY ALL) SELECT source, rule, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, rule) AS place FROM c QUALIFY place <= 3",
        "rule_changes": f"WITH {FOUND}, d AS (SELECT DISTINCT doc_id, rule FROM found), e AS (SELECT doc_id - 1 AS doc_id, rule FROM d) SELECT *, 'gone' AS change FROM (FROM d EXCEPT FROM e) UNION ALL SELECT *, 'new' FROM (FROM e EXCEPT FROM d)",
        "held_out_sample": "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(coalesce(lang, '') || chr(1) || coalesce(text, '')), doc_id) AS place FROM documents QUALIFY place <= 8",
        "best_threshold": f"""WITH {scored}, c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn FROM scored, range(0, 101, 2) t(threshold) GROUP BY threshold),
            m AS (SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 1.0 END, 6) AS specificity FROM c)
            SELECT threshold, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, specificity FROM m ORDER BY specificity >= 0.8 DESC, f1 DESC, threshold LIMIT 1""",
        "score_quantiles": f"WITH {scored}, x AS (SELECT lang, unnest([0.1, 0.5, 0.95]) AS share, unnest(quantile_cont(score, [0.1, 0.5, 0.95])) AS linear FROM scored GROUP BY lang) SELECT lang, CAST(share AS DOUBLE) AS share, round(linear, 6) AS linear FROM x",
        "score_ranks": f"WITH {scored}, r AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM scored) SELECT lang, score AS nearest FROM r WHERE place = least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1)",
        "tag_vectors": f"""WITH {parsed.sql()}, q AS (SELECT doc_id, rel, upos, lead(rel) OVER w AS rel2, lead(upos) OVER w AS upos2 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY s, id)),
            g AS (SELECT doc_id, 'd:' || rel AS term FROM q UNION ALL SELECT doc_id, 'd:' || rel || '|' || rel2 FROM q WHERE rel2 IS NOT NULL UNION ALL SELECT doc_id, 'p:' || upos FROM q UNION ALL SELECT doc_id, 'p:' || upos || '|' || upos2 FROM q WHERE upos2 IS NOT NULL),
            tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM tok)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term))
            SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
        "scaled_features": f"WITH x AS (SELECT doc_id, {sql.words('text')} AS a, length(text) AS b FROM documents) SELECT doc_id, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS n_words, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) AS n_marks FROM x",
        "attachment_scores": f"WITH {parsed.sql()} SELECT rel AS deprel, count(*) AS n, round(avg(CASE WHEN head = id - 1 THEN 1.0 ELSE 0.0 END), 6) AS uas, round(avg(CASE WHEN head = id - 1 AND rel IN ('nsubj', 'punct') THEN 1.0 ELSE 0.0 END), 6) AS las FROM tok GROUP BY rel",
        "sensitivity_tallies": f"{_F} SELECT rule, source, severity, count(*) AS n FROM fp GROUP BY GROUPING SETS ((rule), (source), (severity))",
        "transcript_texts": "WITH b AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS boundary, trim(regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) AS t FROM conversations) SELECT conv_id, turn, md5(t) AS text_md5 FROM b WHERE role <> 'user' AND t <> '' AND (boundary IS NULL OR turn > boundary) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
        "conllu_tokens": f"""WITH {parsed.sql()}, k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS sent_idx, string_agg(form, ' ' ORDER BY id) AS text FROM tok GROUP BY doc_id, s)
            SELECT t.doc_id, k.sent_idx, 's' || t.s AS family, k.text, id, form, head, low AS lemma, CASE WHEN id = 2 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM tok t JOIN k USING (doc_id, s)""",
        "glossary_hits": f"""WITH {sql.SEEDED}, w AS (SELECT DISTINCT doc_id, unnest(list_transform(regexp_extract_all(text, {sql.q(sql.WORD)}), lambda x: lower(x))) AS word FROM seeded), e(layer, key, status) AS (VALUES (1, 'however', 'general'), (1, 'moreover', 'general'), (2, 'however', 'project'), (1, 'sorry', 'general'), (1, 'apologies', 'general'), (3, 'nato', 'team'), (1, 'nato', 'general'))
            SELECT doc_id, word, layer, status FROM w JOIN e ON word = key QUALIFY layer = max(layer) OVER (PARTITION BY doc_id, word)""",
    }
