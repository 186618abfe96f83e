"""How far the sources of a language differ in their words.

Terms are counted in tasks, dealt into shards by language and term, and each shard is worked on by DuckDB inside a
task: one SQL statement keeps the terms of enough documents, another one gives, from the counts of a shard's
terms, partial sums for pairs of sources and each source's foremost terms.  Spark adds the partial sums and ranks.

A shard holds some thousand terms of one language and at most two blocks of its sources, so that neither a
large vocabulary nor many sources make a task large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import LOWER, bytes_of, chunks, lean

#: A term is kept in a language if so many of its documents have it.
LEAST = 30
SMOOTH = 5
UNIT = 1_000_000_000
TOP = 50
#: Terms of a shard, on average, and sources of a block.
SHARD, BLOCK = 4096, 64
#: Rows that a task gathers before it merges them, and that one SQL statement works on.
GATHER, TURN = 400_000, 200_000

_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(batch: pa.RecordBatch, at: int) -> tuple[pa.Array, np.ndarray]:
    """All terms of a text column, A-Z lower-cased, and the row of each."""
    buf, off = bytes_of(batch.column(at))
    solid = np.concatenate([[False], _TERM[buf], [False]])
    first, last = solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]
    inner = off[1:-1]
    both = inner[solid[inner] & solid[inner + 1]]  # a term may not run over the end of a text
    first[both] = last[both] = True
    start, end = np.flatnonzero(first[:-1]), np.flatnonzero(last)
    ends = np.concatenate([[0], np.cumsum(end - start)])
    flat = LOWER[buf[solid[1:-1]]]
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat.tobytes()))
    return words, np.searchsorted(off, start, "right") - 1


def count_chunk(b: pa.RecordBatch) -> pa.Table:
    """(lang, source, text) -> lang, source, term, n (occurrences), docs (rows that have it)."""
    words, row = terms_of(b, 2)
    if not len(words):
        return _COUNTS.empty_table()
    coded = words.dictionary_encode()
    vocabulary, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    pair, n = np.unique(row * len(vocabulary) + code, return_counts=True)
    groups = pa.table({"lang": b.column(0), "source": b.column(1)}).group_by(["lang", "source"]).aggregate([])
    at = {k: i for i, k in enumerate(zip(groups["lang"].to_pylist(), groups["source"].to_pylist(), strict=True))}
    group = np.array([at[k] for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], np.int64)
    key, where = np.unique(group[pair // len(vocabulary)] * len(vocabulary) + pair % len(vocabulary), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, where, n)
    g = key // len(vocabulary)
    return pa.table([groups["lang"].combine_chunks().take(pa.array(g)), groups["source"].combine_chunks().take(pa.array(g)), vocabulary.take(pa.array(key % len(vocabulary))).cast(pa.string()), pa.array(total), pa.array(np.bincount(where, minlength=len(key)))], schema=_COUNTS)


def _merged(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return t.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(_COUNTS.names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's rows, merged as far as memory goes before anything is shuffled."""
    held, size = [], 0
    for big in batches:
        for b in chunks(big):
            held.append(count_chunk(b))
            size += len(held[-1])
            if size > GATHER:
                held = [_merged(held)]
                size = len(held[0])
                if size > GATHER // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from _merged(held).to_batches()


def by_sql(statement: str, keys: list[str]) -> Callable:
    """Runs a statement on a task's rows, which come in order of ``keys``, as table t: turn by turn, never cutting a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        held: list[pa.RecordBatch] = []

        def turn(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            con.register("t", rows)
            out = con.sql(statement).to_arrow_table()
            con.unregister("t")
            yield from out.to_batches()

        for b in batches:
            held.append(b)
            if sum(map(len, held)) < TURN:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            same = np.ones(len(rows), bool)
            for k in keys:
                same &= pc.equal(rows[k], rows[k][-1]).combine_chunks().to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from turn(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield from turn(pa.Table.from_batches(held))
        con.close()

    return run


#: Terms that enough documents of their language have; head marks one row of each.
KEPT = """SELECT lang, source, term, n, CAST(total AS BIGINT) AS total, place = 1 AS head FROM (
    SELECT *, sum(n) OVER w AS total, sum(docs) OVER w AS known, row_number() OVER (PARTITION BY lang, term ORDER BY source) AS place FROM t WINDOW w AS (PARTITION BY lang, term)) WHERE known >= {least}"""


def _share(n: str, of: str) -> str:
    """The share of a term in parts of a thousand million, from 1 on."""
    return f"1 + CAST((CAST({UNIT} AS HUGEINT) * ({n} + {SMOOTH})) // ({of} + {SMOOTH} * g.v) AS BIGINT)"


#: t holds shards: rows without a term are its sources, the others counts.  Of a shard of two blocks, only pairs across count.
PARTS = f"""WITH g AS MATERIALIZED (SELECT lang, shard, b1, b2, source, block, n AS total_n, v, lang_n FROM t WHERE term IS NULL),
    c AS MATERIALIZED (SELECT lang, shard, b1, b2, source, term, n, total FROM t WHERE term IS NOT NULL),
    m AS (SELECT DISTINCT lang, shard, b1, b2, term FROM c),
    p AS MATERIALIZED (SELECT lang, shard, b1, b2, source, block, term, {_share("coalesce(c.n, 0)", "g.total_n")} AS p FROM m JOIN g USING (lang, shard, b1, b2) LEFT JOIN c USING (lang, shard, b1, b2, source, term)),
    s AS (SELECT c.lang, c.shard, c.source, c.term, {_share("c.n", "g.total_n")} - ({_share("c.total", "g.lang_n")}) AS f FROM c JOIN g USING (lang, shard, b1, b2, source) WHERE c.b1 = c.b2 AND c.n > 0)
    SELECT 'pair' AS part, lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value, count(*) AS met FROM p a JOIN p b USING (lang, shard, b1, b2, term)
    WHERE a.source < b.source AND (b1 = b2 OR a.block <> b.block) GROUP BY lang, a.source, b.source
    UNION ALL SELECT 'term', lang, source, term, f, 0 FROM s WHERE f > 0 QUALIFY row_number() OVER (PARTITION BY lang, shard, source ORDER BY f DESC, term) <= {{top}}"""


def divergence(spark: SparkSession, docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """docs (text, lang, source) -> lang, source, part, item, value, rank.

    Each language keeps the terms that at least ``least`` of its documents have.  A group (lang, source), like the language,
    gives a kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N counts of all V kept terms.  ``pair``: every other
    source of the language, by the sum of absolute differences of p over all kept terms; ``term``: the ``top`` terms that
    the group has and gives more than its language, by the difference.  Ranks go by value descending, then item.

    - Null text, lang and source count as ''; documents without terms still make their group occur.
    - A language that keeps no term has pairs of value 0 and no terms; a group alone in its language has no pairs.
    - Repeated rows count as often as they occur.  An empty table gives no rows.  Very long texts are counted in one
      task, some 40 bytes for each of theirs.  Other columns are ignored, whatever their names.
    """
    s = Scratch(spark, "divergence")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    counts = docs.mapInArrow(lean(_counted), "lang string, source string, term string, n long, docs long")
    merged = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    ordered = merged.sortWithinPartitions("lang", "term")
    kept = s.put(ordered.mapInArrow(lean(by_sql(KEPT.format(least=least), ["lang", "term"])), "lang string, source string, term string, n long, total long, head boolean"))

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("head").cast("long")).alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", zero("n"), zero("v"), zero("lang_n"), F.floor(place / BLOCK).cast("int").alias("block"))
    groups = s.put(groups.withColumns({"blocks": F.max("block").over(Window.partitionBy("lang")) + 1, "shards": F.ceil(F.col("v") / SHARD).cast("int")}))

    # Every block of sources meets every other in each shard of its language's terms.
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("b1"), F.greatest(o, "block").alias("b2")))
    shard = lambda d: d.withColumn("o", F.explode(others)).select("lang", "shard", "o.b1", "o.b2", "source", "block", "term", "n", "total", "v", "lang_n")
    owners = groups.where("shards > 0").withColumns({"shard": F.explode(F.sequence(F.lit(0), F.col("shards") - 1)), "term": F.lit(None).cast("string"), "total": F.lit(None).cast("long")})
    counted = kept.drop("head").join(groups.select("lang", "source", "v", "lang_n", "block", "blocks", "shards"), ["lang", "source"]).withColumn("shard", F.pmod(F.xxhash64("term"), "shards").cast("int"))
    keys = ["lang", "shard", "b1", "b2"]
    dealt = shard(owners).union(shard(counted)).repartition(*keys).sortWithinPartitions(*keys)
    parts = s.put(dealt.mapInArrow(lean(by_sql(PARTS.format(top=top), keys)), "part string, lang string, source string, item string, value long, met long"))
    s.drop(kept)

    floor = groups.select("lang", "source", "v", F.when(F.col("v") > 0, F.lit(1) + F.expr(f"{UNIT * SMOOTH}L div (n + {SMOOTH}L * v)")).otherwise(0).alias("p0"))
    left = floor.withColumnRenamed("p0", "pa")
    right = floor.select("lang", F.col("source").alias("item"), F.col("p0").alias("pb"))
    every = left.join(right, "lang").where("source < item")  # as many rows as the result has pairs
    found = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    # Terms that neither source of a pair's shards met, as their blocks have none of them.
    rest = (F.col("v") - zero("met")) * F.abs(F.col("pa") - F.col("pb"))
    pairs = every.join(found, ["lang", "source", "item"], "left").select("lang", "source", "item", (zero("value") + rest).cast("long").alias("value"))
    pairs = pairs.union(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    rows = pairs.withColumn("part", F.lit("pair")).unionByName(parts.where("part = 'term'").drop("met"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(f"part = 'pair' or rank <= {int(top)}")
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


_P = f"1 + (CAST({UNIT} AS HUGEINT) * ({{}} + {SMOOTH})) // ({{}} + {SMOOTH} * v)"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWERED} AS text FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST}),
    l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
    g AS (SELECT lang, source, coalesce(sum(n), 0) AS total_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT lang, source, term, coalesce(n, 0) AS n, {_P.format("coalesce(n, 0)", "total_n")} AS p, {_P.format("total", "lang_n")} AS q FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
    f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(a.p - b.p)), 0) AS value FROM (SELECT g.*, p.term, p.p FROM g LEFT JOIN p USING (lang, source)) a JOIN (SELECT g.*, p.term, p.p FROM g LEFT JOIN p USING (lang, source)) b
        ON a.lang = b.lang AND a.source <> b.source AND a.term IS NOT DISTINCT FROM b.term GROUP BY ALL
        UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= {TOP}"""
