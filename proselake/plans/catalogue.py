"""All registered queries of the prose engine with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions.text import WORD, line_column, paragraphs, sentences, spans, word_array, word_count
from proselake.operators import detect, evaluate, rules
from proselake.plans import extracts, graphs, reports, runs, sql, traces
from proselake.plans import spans as span_plans
from proselake.plans.rules_sql import FOUND
from proselake.plans.seeds import seeded
from proselake.sources.readers import table
from proselake.streaming.hook import retry_decisions


def document_report(spark, sf_dir):
    return rules.report(seeded(spark, sf_dir))


def finding_rows(spark, sf_dir):
    f = detect.finding_rows(seeded(spark, sf_dir))
    return f.select("doc_id", "rule", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "confidence", "severity")


def serious_findings(spark, sf_dir):
    f = detect.finding_rows(seeded(spark, sf_dir), "warn")
    return f.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def sentence_rows(spark, sf_dir):
    s = seeded(spark, sf_dir).select("doc_id", F.posexplode_outer(sentences(F.col("text"))).alias("i", "s")).where("i is not null")
    return s.select("doc_id", F.col("i").cast("long").alias("sent_idx"), F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), word_count(F.col("s.text")).cast("long").alias("n_words"), F.md5(F.col("s.text").cast("binary")).alias("sentence_md5"))


def paragraph_rows(spark, sf_dir):
    p = seeded(spark, sf_dir).select("doc_id", "text", F.posexplode_outer(paragraphs(F.col("text"))).alias("i", "p")).where("i is not null")
    return p.select("doc_id", F.col("i").cast("long").alias("par_idx"), F.col("p.start").cast("long").alias("start_at"), F.col("p.end").cast("long").alias("end_at"), F.md5(F.col("p.text").cast("binary")).alias("par_md5"))


def sentence_rhythm(spark, sf_dir):
    return rules.rhythm(seeded(spark, sf_dir))


def lexical_richness(spark, sf_dir):
    d = seeded(spark, sf_dir).select("doc_id", F.array_sort(word_array(F.lower("text"))).alias("w")).where(F.size("w") > 0)
    other = lambda w, i: F.coalesce(F.get(F.col("w"), i - 1) != w, F.lit(True))
    alone = F.filter("w", lambda w, i: other(w, i) & F.coalesce(F.get(F.col("w"), i + 1) != w, F.lit(True)))
    d = d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.filter("w", other)).cast("long").alias("n_types"), F.size(alone).cast("long").alias("n_hapax"))
    return d.withColumn("type_token_ratio", F.round(F.col("n_types") / F.col("n_words"), 6))


def word_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.agg(F.count(F.lit(1)).alias("total"))
    df = docs.select("doc_id", F.explode(F.array_distinct(word_array(F.lower("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    return df.join(F.broadcast(n), F.lit(True)).select("word", "df", F.round(F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1, 9).alias("idf"))  # one row, from an aggregate


def match_positions(spark, sf_dir):
    docs = seeded(spark, sf_dir)
    x = docs.select("doc_id", "text", F.explode(spans(F.col("text"), "—|😀")).alias("m"))
    at = line_column(F.col("text"), F.col("m.start"))
    return x.select("doc_id", F.col("m.start").cast("long").alias("start_at"), F.col("m.match").alias("matched"), at["line"].cast("long").alias("line_no"), at["column"].cast("long").alias("column_no"))


def severity_rollup(spark, sf_dir):
    f = detect.findings(seeded(spark, sf_dir)).select("source", F.explode_outer("found").alias("f")).where("f is not null").select("source", "f.severity")
    return f.rollup("source", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level_id"))


def _scored(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", F.col("quality").alias("label"), F.least(F.lit(100), F.floor(word_count(F.col("text")) / 10)).cast("long").alias("score"))


def length_auc(spark, sf_dir):
    return evaluate.auc(_scored(spark, sf_dir))


def threshold_sweep(spark, sf_dir):
    out = evaluate.sweep(_scored(spark, sf_dir), list(range(0, 101, 10)))
    return out.withColumn("threshold", F.col("threshold").cast("long"))


def stratified_folds(spark, sf_dir):
    return evaluate.folds(_scored(spark, sf_dir), ["lang", "label"], 4).select("doc_id", "fold")


def current_turn(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    after = c.withColumn("boundary", last).where("role = 'assistant' and (boundary is null or turn > boundary)")
    return after.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max_by("text", "turn").alias("last_text"))


def retry_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "view").alias("dirty"), (F.col("event_id") % 5 != 0).alias("active"))
    return retry_decisions(e, 3)


_QUERIES = [document_report, finding_rows, serious_findings, sentence_rows, paragraph_rows, sentence_rhythm, lexical_richness, word_idf, match_positions, severity_rollup, length_auc, threshold_sweep, stratified_folds, current_turn, retry_states]


def queries() -> dict:
    return {f.__name__: f for f in [*_QUERIES, *graphs.QUERIES, *span_plans.QUERIES, *reports.QUERIES, *extracts.QUERIES, *traces.QUERIES, *runs.QUERIES]}


_q, _words, _SEEDED = sql.q, sql.words, sql.SEEDED
_WORD = _q(WORD)
_S = sql.sentences()


_SCORED = f"scored AS (SELECT doc_id, lang, quality AS label, least(100, CAST(floor({_words('text')} / 10) AS BIGINT)) AS score FROM documents JOIN labels USING (doc_id))"


def oracle_sql() -> dict[str, str]:
    low = f"regexp_extract_all(lower(text), {_WORD})"
    return graphs.oracle_sql() | span_plans.oracle_sql() | reports.oracle_sql() | extracts.oracle_sql() | traces.oracle_sql() | runs.oracle_sql() | {
        "document_report": f"""WITH {FOUND}, n AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warn') AS w, count(*) FILTER (severity = 'info') AS i FROM found GROUP BY doc_id),
            k AS (SELECT doc_id, count(*) AS k FROM sents GROUP BY doc_id), b AS (SELECT doc_id, {_words("text")} AS n_words, coalesce(k, 0) AS n_sentences FROM seeded LEFT JOIN k USING (doc_id))
            SELECT doc_id, n_words, n_sentences, coalesce(e, 0) AS error_count, coalesce(w, 0) AS warn_count, coalesce(i, 0) AS info_count,
            CASE WHEN n_words > 0 THEN floor(1000 * (coalesce(e, 0) + coalesce(w, 0) + coalesce(i, 0)) / n_words * 10 + 0.5) / 10 ELSE 0.0 END AS per_thousand FROM b LEFT JOIN n USING (doc_id)""",
        "finding_rows": f"WITH {FOUND} SELECT * FROM found",
        "serious_findings": f"WITH {FOUND} SELECT rule, severity, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM found WHERE severity IN ('warn', 'error') GROUP BY ALL",
        "sentence_rows": f"WITH {_SEEDED}, {_S} SELECT doc_id, i AS sent_idx, start_at, end_at, {_words('text')} AS n_words, md5(text) AS sentence_md5 FROM sents",
        "paragraph_rows": f"WITH {_SEEDED}, {sql.paragraphs()} SELECT doc_id, i AS par_idx, start_at, end_at, md5(text) AS par_md5 FROM pars",
        "sentence_rhythm": f"""WITH {_SEEDED}, {_S}, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, n FROM (SELECT doc_id, i, {_words('text')} AS n FROM sents) WHERE n > 0),
            m AS (SELECT *, avg(n) OVER (PARTITION BY doc_id) AS mean FROM n), b AS (SELECT *, abs(n - mean) <= 0.25 * mean AS beat FROM m), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, beat ORDER BY i) AS island FROM b),
            r AS (SELECT doc_id, min(i) AS run_at, count(*) AS run_length FROM g WHERE beat GROUP BY doc_id, island), t AS (SELECT doc_id, run_at, run_length FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY run_length DESC, run_at) = 1)
            SELECT doc_id, count(*) AS n_sentences, round(avg(n), 6) AS mean_words, round(stddev_pop(n) / avg(n), 6) AS cv, stddev_pop(n) / avg(n) < 0.22 AS uniform, coalesce(any_value(run_at), 0) AS run_at, coalesce(any_value(run_length), 0) AS run_length
            FROM n LEFT JOIN t USING (doc_id) GROUP BY doc_id HAVING count(*) >= 8""",
        "lexical_richness": f"WITH {_SEEDED}, w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({low}) AS w FROM seeded) GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_words, count(*) AS n_types, count(*) FILTER (n = 1) AS n_hapax, round(count(*) / sum(n), 6) AS type_token_ratio FROM w GROUP BY doc_id",
        "word_idf": f"WITH d AS (SELECT w AS word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({low})) AS w FROM documents) GROUP BY w) SELECT word, df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 9) AS idf FROM d WHERE df >= 2",
        "match_positions": f"""WITH {_SEEDED}, c AS (SELECT doc_id, text, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM seeded WHERE contains(text, '—') OR contains(text, '😀'))
            SELECT doc_id, pos AS start_at, ch AS matched, len(string_split(substr(text, 1, pos), chr(10))) AS line_no, length(string_split(substr(text, 1, pos), chr(10))[-1]) + 1 AS column_no FROM c WHERE ch IN ('—', '😀')""",
        "severity_rollup": f"WITH {FOUND} SELECT source, severity, count(*) AS n, grouping_id(source, severity) AS level_id FROM found JOIN seeded USING (doc_id) GROUP BY ROLLUP (source, severity)",
        "length_auc": f"WITH {_SCORED} SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round((SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) FROM scored a, scored b WHERE a.label = 1 AND b.label = 0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) AS auc FROM scored",
        "threshold_sweep": f"""WITH {_SCORED}, c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn
            FROM scored, range(0, 101, 10) t(threshold) GROUP BY threshold) SELECT threshold, tp, fp, tn, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END, 6) AS recall, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 1.0 END, 6) AS specificity, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
            round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 ELSE 0.0 END, 6) AS f1 FROM c""",
        "stratified_folds": f"WITH {_SCORED} SELECT doc_id, (row_number() OVER (PARTITION BY lang, label ORDER BY doc_id) - 1) % 4 AS fold FROM scored",
        "current_turn": "WITH b AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS boundary FROM conversations) SELECT conv_id, count(*) AS n_messages, max_by(text, turn) AS last_text FROM b WHERE role = 'assistant' AND (boundary IS NULL OR turn > boundary) GROUP BY conv_id",
        # Event by event, as the state machine runs.
        "retry_states": """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, event_type IN ('error', 'view') AS dirty, event_id % 5 <> 0 AS active, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
            s(key, n, seq, before, retries, dirty, active) AS (SELECT key, n, seq, 0, CASE WHEN dirty THEN CASE WHEN active THEN 2 ELSE 1 END ELSE 0 END, dirty, active FROM e WHERE n = 1
                UNION ALL SELECT e.key, e.n, e.seq, s.retries, CASE WHEN NOT e.dirty THEN 0 WHEN NOT e.active THEN 1 WHEN greatest(1, s.retries) >= 3 THEN 0 ELSE greatest(1, s.retries) + 1 END, e.dirty, e.active FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)
            SELECT key, seq, retries, dirty AND retries > 0 AS blocked, CASE WHEN NOT dirty AND active AND before > 0 THEN 'accepted' WHEN dirty AND retries = 0 THEN 'gave up' END AS note FROM s""",
    }
