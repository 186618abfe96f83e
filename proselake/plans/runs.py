"""Registered queries on versions of documents and on decoded trees."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from proselake.functions.text import word_count
from proselake.operators import classify, decode, shallow
from proselake.operators.trees import Block, expanded, offsets
from proselake.plans.parses import own_texts, shallow_sql
from proselake.plans.rules_sql import FOUND
from proselake.plans.seeds import seeded
from proselake.plans.sql import words
from proselake.sinks import render
from proselake.sources import masking
from proselake.sources.readers import spread, table
from proselake.streaming import documents

#: Tokens that are decoded together; longer sentences fall into stretches.
STRETCH = 32


def document_runs(spark, sf_dir):
    """The newest of several versions of each document, some of them no UTF-8."""
    d = seeded(spark, sf_dir).select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(1) + F.col("doc_id") % 3)).alias("generation"))
    last = F.col("generation") == 1 + F.col("doc_id") % 3
    whole = F.when(last, F.col("text")).otherwise(F.concat(F.lit("Sorry. "), F.substring("text", 1, 40))).cast("binary")
    v = d.select("doc_id", F.col("generation").cast("long").alias("generation"), F.when(last & (F.col("doc_id") % 17 == 0), F.concat(whole, F.unhex(F.lit("FF")))).otherwise(whole).alias("content"))
    return documents.checked(documents.latest(v))


def run_status(spark, sf_dir):
    """How a run over these versions ends."""
    return render.exit_status(document_runs(spark, sf_dir), 10)


def empty_prose(spark, sf_dir):
    """Code files without a word of prose in their comments, each with what is told instead of findings."""
    d = spread(table(spark, sf_dir, "documents"))
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), "[\n\r`'\"{}<>\\[\\]*#\\\\]", " ")
    code = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), flat)).otherwise(F.concat(F.lit("x = '"), flat, F.lit("'")))
    prose = masking.comments(code, F.lit("py"))
    empty = d.select("doc_id", word_count(prose).alias("n")).where("n = 0")
    return empty.select("doc_id", F.lit("no-extractable-prose").alias("rule"), F.lit("info").alias("severity"), F.lit(0).cast("long").alias("start_at"))


@functools.lru_cache(maxsize=1024)
def _shift(n: int) -> np.ndarray:
    """What n more bytes do to a CRC-32, byte by byte of it: 4 x 256."""
    zeros = bytes(n)
    none = zlib.crc32(zeros)
    return np.array([[zlib.crc32(zeros, v << 8 * k) ^ none for v in range(256)] for k in range(4)], np.uint32)


def _word_scores(words: list[str], codes: np.ndarray) -> np.ndarray:
    """Scores of stretches of words, a row of codes each: by crc32 of both words with a space between, which is that of the
    first and the space, moved on by the length of the second, with that of the second; and by their distance."""
    raw = [w.encode() for w in words]
    first = np.array([zlib.crc32(w + b" ") for w in raw], np.uint32)[codes]
    second = np.array([zlib.crc32(w) for w in raw], np.uint32)[codes]
    sizes, size = np.unique([len(w) for w in raw], return_inverse=True)
    moves, size = np.stack([_shift(int(n)) for n in sizes]), size[codes][:, None, :]
    both = np.broadcast_to(second[:, None, :], (*codes.shape, codes.shape[1])).copy()
    for k in range(4):
        both ^= moves[size, k, (first >> (8 * k) & 255)[:, :, None]]
    n = np.arange(codes.shape[1])
    arcs = (both % 1000) / 100 - np.abs(n[:, None] - n) / 4
    return np.concatenate([((first % 1000) / 100 - 4)[:, :, None], arcs], 2)


def _decoded(b: Block) -> pa.RecordBatch:
    t, words = b.trees, b.trees.low.values
    parts = -(-t.counts // STRETCH)
    sent = expanded(parts)
    part = np.arange(len(sent)) - offsets(parts)[sent]
    starts, sizes = t.at[sent] + part * STRETCH, np.minimum(t.counts[sent] - part * STRETCH, STRETCH)
    heads = np.zeros(len(t.form.codes), np.int64)
    for n in np.unique(sizes).tolist():
        some = starts[sizes == n][:, None] + np.arange(n)
        for at in np.array_split(some, len(some) * n * n // decode.CELLS + 1):
            used, codes = np.unique(t.form.codes[at], return_inverse=True)
            heads[at] = decode.greedy_trees(_word_scores([words[k] for k in used.tolist()], codes.reshape(at.shape)))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets(sizes), pa.int32()), pa.array(heads).cast(pa.string())), " ")
    roots = np.add.reduceat(heads == 0, starts, dtype=np.int64) if len(starts) else starts
    return pa.RecordBatch.from_arrays([b.doc_id.take(pa.array(sent)), b.column(0, pa.int64()).take(pa.array(sent)), pa.array(part, pa.int64()), joined, pa.array(roots)], ["doc_id", "sent_idx", "part", "heads", "n_roots"])


def decoded_trees(spark, sf_dir):
    """Trees over all tokens of the documents, from scores by a hash of both words and by their distance."""
    return shallow.looked(own_texts(spark, sf_dir), lambda: _decoded, "doc_id long, sent_idx long, part long, heads string, n_roots long")


def _features(spark, sf_dir):
    return classify.features(shallow.parses(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def document_features(spark, sf_dir):
    """Shares and lengths of each document, and how many tags and pairs of tags it has."""
    f = _features(spark, sf_dir)
    return f.select("doc_id", F.size("terms").cast("long").alias("n_terms"), *(F.round(c, 6).alias(c) for c in classify.SCALARS))


def trained_scores(spark, sf_dir):
    """Quality as a model of three quarters of the labelled documents scores it, for all labelled ones."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    docs = _features(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id").withColumn("held_out", held_out).persist()
    model = classify.fit_vectors(docs.where("not held_out"))
    rows = classify.vectors(docs, model, "label", "held_out")
    return classify.predict(rows, classify.train(rows.where("not held_out"), model, epochs=20))


QUERIES = [document_runs, run_status, empty_prose, decoded_trees, document_features, trained_scores]


def oracle_sql() -> dict[str, str]:
    bad = "doc_id % 17 = 0"
    n = lambda s: f"CASE WHEN {bad} THEN NULL ELSE coalesce({s}, 0) END"
    runs = f"""WITH {FOUND}, n AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warn') AS w, count(*) FILTER (severity = 'info') AS i FROM found GROUP BY doc_id),
            b AS (SELECT doc_id, {words("text")} AS k FROM seeded)
            SELECT doc_id, 1 + doc_id % 3 AS generation, CASE WHEN {bad} THEN 'runtime-error' ELSE 'ok' END AS status, CASE WHEN {bad} THEN 'content is not valid UTF-8' END AS error, {n("k")} AS n_words, {n("e")} AS error_count, {n("w")} AS warn_count, {n("i")} AS info_count,
            CASE WHEN {bad} THEN NULL WHEN k > 0 THEN floor(1000 * (coalesce(e, 0) + coalesce(w, 0) + coalesce(i, 0)) / k * 10 + 0.5) / 10 ELSE 0.0 END AS per_thousand FROM b LEFT JOIN n USING (doc_id)"""
    share = ", ".join(f"round(count(*) FILTER (upos = '{t}') / count(*), 6) AS \"share_{t}\"" for t in classify.TAGS)
    return {
        "document_features": f"""WITH {shallow_sql()}, k AS (SELECT doc_id, s, count(*) FILTER (upos <> 'PUNCT') AS n FROM own GROUP BY ALL), m AS (SELECT doc_id, round(avg(n), 6) AS mean_words, round(stddev_pop(n), 6) AS spread_words FROM k GROUP BY doc_id),
            w AS (SELECT doc_id, low, count(*) AS n FROM own WHERE upos <> 'PUNCT' GROUP BY ALL), v AS (SELECT doc_id, count(*) / sum(n) AS t, count(*) FILTER (n = 1) / sum(n) AS o FROM w GROUP BY doc_id),
            p AS (SELECT doc_id, 4 * count(*) - 2 AS n_terms, round(count(*) FILTER (form = ',') / count(*), 6) AS comma_share, {share} FROM own GROUP BY doc_id)
            SELECT p.*, mean_words, spread_words, round(coalesce(t, 0), 6) AS type_share, round(coalesce(o, 0), 6) AS once_share FROM p JOIN m USING (doc_id) LEFT JOIN v USING (doc_id)""",
        "document_runs": runs,
        "run_status": f"SELECT *, CASE WHEN failed > 0 THEN 2 WHEN error_count > 0 OR warn_count > 10 THEN 1 ELSE 0 END AS status FROM (SELECT CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(warn_count) AS BIGINT) AS warn_count, CAST(sum(info_count) AS BIGINT) AS info_count, count(*) FILTER (status = 'runtime-error') AS failed FROM ({runs}))",
        "empty_prose": f"""SELECT doc_id, 'no-extractable-prose' AS rule, 'info' AS severity, 0 AS start_at FROM documents WHERE doc_id % 3 <> 0 OR {words("coalesce(text, '')")} = 0""",
    }
