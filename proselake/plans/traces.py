"""Registered queries on the reading trace over the documents' own texts, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselake.operators import shallow, trace
from proselake.plans import parses as parsed
from proselake.plans import sql
from proselake.plans.seeds import seeded

#: Promises, standards and names that the documents lack, put in front of their texts.
LEADS = [
    "",
    "We will explain the harbour later. This section will describe the tower. We will show the garden. It rains. ",
    "All must be listed clearly and completely. It must be handled appropriately. They must be ordered significantly and materially by suitable tools. ",
    "We will discuss the harbour. It rained. It rained on. It rained again. It was late. It was dark. It was cold. They waited. They slept. They left. The harbour opened. ",
]
#: Words that are no concepts.
GENERIC = ["example", "fact", "kind", "one", "part", "point", "reason", "result", "section", "thing", "time", "type", "way", "word", "work"]


def led(spark, sf_dir) -> DataFrame:
    lead = F.element_at(F.array(*(F.lit(s) for s in LEADS)), (F.col("doc_id") % len(LEADS) + 1).cast("int"))
    return seeded(spark, sf_dir).select("doc_id", F.concat(lead, "text").alias("text"))


def reading_moments(spark, sf_dir):
    """What each sentence brings in, takes up and lets go."""
    m = trace.loads_of(led(spark, sf_dir))
    load = [F.col("load")[k].cast("long").alias(k) for k in trace.LOAD]
    return m.select("doc_id", *(F.col(c).cast("long").alias(f"{c}_at" if c in ("start", "end") else c) for c in ("sentence", "unit", "start", "end")), *(F.col(c).cast("long").alias(f"n_{c}") for c in trace.Loads.SIZED), *load, "new_unit", F.array_join("cues", " ").alias("cues"))


def moment_entities(spark, sf_dir):
    """Things that a sentence brings in, takes up, and takes up after four sentences or more."""
    return trace.things_of(led(spark, sf_dir))


def trace_findings(spark, sf_dir):
    f = trace.findings_of(led(spark, sf_dir))
    return f.select("doc_id", "rule", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "confidence")


def entity_key(form, upos):
    """``trace.entity_key`` as an expression."""
    low, cut = F.lower(form), lambda n: F.substring(F.lower(form), F.lit(1), F.length(form) - n)
    key = F.when((upos != "NOUN") | low.isin(trace.UNCHANGED), low)
    for plural, single in trace.IRREGULAR.items():
        key = key.when(low == plural, single)
    return key.when(low.rlike("[^aeiou]ies$"), F.concat(cut(3), F.lit("y"))).when(low.rlike("(?:[sxz]|ch|sh)es$"), cut(2)).when((F.length(low) > 3) & low.rlike("[^sui]s$"), cut(1)).otherwise(low)


def concept_bursts(spark, sf_dir):
    """Paragraphs that bring in twelve concepts or more of which the document makes use again; high from eighteen on."""
    p = shallow.parses(led(spark, sf_dir)).where("par_idx is not null")
    t = p.select("doc_id", "par_idx", "par_start", "par_end", F.explode("tokens").alias("t")).where("t.upos in ('NOUN', 'PROPN')")
    t = t.withColumn("term", entity_key(F.col("t.form"), F.col("t.upos"))).where((F.length("term") >= 3) & ~F.col("term").isin(GENERIC) & F.col("term").rlike("^[a-z][a-z'-]*$"))
    # A token counts for its document, and for its unit only if it lies in it.
    inside = (F.col("t.start") >= F.col("par_start")) & (F.col("t.end") <= F.col("par_end"))
    terms = t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("uses"), F.min(F.when(inside, F.struct("par_idx", "par_start", "par_end"))).alias("u")).where("uses >= 2 and u is not null")
    units = terms.groupBy("doc_id", "u").agg(F.count(F.lit(1)).alias("n_terms")).where("n_terms >= 12")
    return units.select("doc_id", F.col("u.par_start").cast("long").alias("start_at"), F.col("u.par_end").cast("long").alias("end_at"), "n_terms", F.when(F.col("n_terms") >= 18, "high").otherwise("medium").alias("confidence"))


QUERIES = [reading_moments, moment_entities, trace_findings, concept_bursts]

_LED = f"{sql.SEEDED}, led AS (SELECT doc_id, (CASE doc_id % {len(LEADS)} " + " ".join(f"WHEN {i} THEN {sql.q(s)}" for i, s in enumerate(LEADS)) + " END) || text AS text FROM seeded)"
_KEY = "CASE WHEN upos <> 'NOUN' OR low IN ({}) THEN low {} WHEN regexp_matches(low, '[^aeiou]ies$') THEN low[:-4] || 'y' WHEN regexp_matches(low, '(?:[sxz]|ch|sh)es$') THEN low[:-3] WHEN length(low) > 3 AND regexp_matches(low, '[^sui]s$') THEN low[:-2] ELSE low END".format(
    ", ".join(sql.q(w) for w in trace.UNCHANGED), " ".join(f"WHEN low = {sql.q(k)} THEN {sql.q(v)}" for k, v in trace.IRREGULAR.items())
)
_UNITS = f"""{_LED}, {parsed.shallow_sql("led")}, unit AS (SELECT s.doc_id, s.i AS s, p.i AS par, p.start_at AS pa, p.end_at AS pz FROM sents s JOIN pars p ON s.doc_id = p.doc_id AND s.end_at > p.start_at AND s.start_at < p.end_at QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.i ORDER BY p.i DESC) = 1),
named AS (SELECT own.doc_id, own.s, par, pa, pz, {_KEY} AS key, a >= pa AND z <= pz AS inside FROM own JOIN unit USING (doc_id, s) WHERE upos IN ('NOUN', 'PROPN'))"""


def oracle_sql() -> dict[str, str]:
    return {
        "moment_entities": f"""WITH {_UNITS}, e AS (SELECT *, s - lag(s) OVER (PARTITION BY doc_id, key ORDER BY s) AS gap FROM (SELECT DISTINCT doc_id, s, key FROM named WHERE inside))
            SELECT doc_id, s AS sentence, count(*) FILTER (key IS NOT NULL AND gap IS NULL) AS n_introduced, count(*) FILTER (gap IS NOT NULL) AS n_reinforced, count(*) FILTER (gap >= {trace.RETURN}) AS n_returned FROM unit LEFT JOIN e USING (doc_id, s) GROUP BY ALL""",
        "concept_bursts": f"""WITH {_UNITS}, t AS (SELECT doc_id, key, count(*) AS uses, min(par) FILTER (inside) AS par FROM named WHERE length(key) >= 3 AND key NOT IN ({", ".join(sql.q(w) for w in GENERIC)}) AND regexp_matches(key, '^[a-z][a-z''-]*$') GROUP BY ALL HAVING count(*) >= 2)
            SELECT doc_id, start_at, end_at, count(*) AS n_terms, CASE WHEN count(*) >= 18 THEN 'high' ELSE 'medium' END AS confidence FROM t JOIN pars p USING (doc_id) WHERE p.i = t.par GROUP BY ALL HAVING count(*) >= 12""",
    }
