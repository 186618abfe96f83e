"""Joins, differences and sweeps over text spans (start, end) of documents.

All joins have doc_id as their equality; two spans overlap where each starts before the other ends.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def _overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}.end") > F.col(f"{b}.start")) & (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id"))


def overlapping(left: DataFrame, right: DataFrame, how: str = "inner", kind: str | None = None) -> DataFrame:
    """Pairs that overlap (``how``: inner, left, left_semi or left_anti), right spans of one kind where asked."""
    if kind is not None:
        right = right.where(F.col("kind") == kind)
    return left.alias("a").join(right.alias("b"), _overlap("a", "b"), how)


def first_holder(points: DataFrame, holders: DataFrame, order: str) -> DataFrame:
    """points (doc_id, start, ...) with ``order`` of the first holder whose span contains start, or null."""
    inside = (F.col("p.start") >= F.col("h.start")) & (F.col("p.start") < F.col("h.end")) & (F.col("p.doc_id") == F.col("h.doc_id"))
    h = holders.select("doc_id", "start", "end", order)
    return points.alias("p").join(h.alias("h"), inside, "left").groupBy(*(F.col(f"p.{c}") for c in points.columns)).agg(F.min(f"h.{order}").alias(order))


def merged(spans: DataFrame) -> DataFrame:
    """Unions of overlapping or touching spans of a document: a running maximum of ends, cut where it is passed."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.select("doc_id", "start", "end").withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
    s = s.withColumn("island", F.sum("new").over(w))
    return s.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def difference(outer: DataFrame, holes: DataFrame) -> DataFrame:
    """What of each outer span (doc_id, start, end) no hole covers, as (doc_id, outer_start, start, end)."""
    m = merged(holes)
    cut = overlapping(outer, m).select(F.col("a.doc_id").alias("doc_id"), F.col("a.start").alias("outer_start"), F.col("a.end").alias("outer_end"), F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))
    w = Window.partitionBy("doc_id", "outer_start", "outer_end").orderBy("start")
    before = cut.select("doc_id", "outer_start", F.coalesce(F.lag("end").over(w), F.col("outer_start")).alias("start"), F.col("start").alias("end"))
    after = cut.groupBy("doc_id", "outer_start", "outer_end").agg(F.max("end").alias("start")).select("doc_id", "outer_start", "start", F.col("outer_end").alias("end"))
    whole = overlapping(outer, m, "left_anti").select("doc_id", F.col("start").alias("outer_start"), "start", "end")
    return before.unionByName(after).unionByName(whole).where("start < end")


def gaps(outer: list[tuple[int, int]], holes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """What of each outer span no hole covers, as (start of the outer one, start, end): one sweep of merged holes."""
    starts, ends = [], []
    for a, z in sorted(holes):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            starts.append(a)
            ends.append(z)
    out = []
    for a, z in outer:
        at, k = a, bisect_right(ends, a)
        while k < len(ends) and starts[k] < z:
            if at < starts[k]:
                out.append((a, at, starts[k]))
            at, k = ends[k], k + 1
        if at < z:
            out.append((a, at, z))
    return out


_GAPS = pa.struct([("outer_start", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _uncovered(outer_start: pa.Array, outer_end: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
    rows, ends = [], [0]
    for a, z, b, y in zip(*(c.to_pylist() for c in (outer_start, outer_end, start, end)), strict=True):
        rows += gaps(list(zip(a or [], z or [], strict=True)), list(zip(b or [], y or [], strict=True)))
        ends.append(len(rows))
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], fields=list(_GAPS)))


def uncovered(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    """``difference`` inside a row: arrays of starts and ends of outer spans and of holes -> the ranges that stay.

    A document's spans need not be exploded, joined and sorted for it."""
    return arrow_udf(_uncovered, "array<struct<outer_start:int,start:int,end:int>>")(outer_start, outer_end, start, end)


def segments(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Non-overlapping segments of each text (doc_id, length): (doc_id, start, end, owner).

    spans (doc_id, start, end, prio, seq): the lowest prio owns a character, then the lowest seq; owner is
    the seq, null where there is none.  Neighbours with one owner make one segment.
    """
    edges = spans.select("doc_id", F.explode(F.array("start", "end")).alias("edge")).union(lengths.select("doc_id", F.lit(0))).union(lengths.select("doc_id", "length")).distinct()
    pieces = edges.select("doc_id", F.col("edge").alias("start"), F.lead("edge").over(Window.partitionBy("doc_id").orderBy("edge")).alias("end")).join(lengths, "doc_id").where("end is not null and end <= length and start < end")
    held = pieces.alias("a").join(spans.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.start") <= F.col("a.start")) & (F.col("b.end") >= F.col("a.end")), "left")
    owned = held.groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.start").alias("start"), F.col("a.end").alias("end")).agg(F.min(F.struct("b.prio", "b.seq"))["seq"].alias("owner"))
    w = Window.partitionBy("doc_id").orderBy("start")
    new = F.when(F.lag("owner").over(w).eqNullSafe(F.col("owner")) & (F.lag("end").over(w) == F.col("start")), 0).otherwise(1)
    return owned.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("doc_id", "run", "owner").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def clusters(spans: DataFrame, gap: int) -> DataFrame:
    """Runs of spans whose starts follow the end before them by ``gap`` or less: sessions of a text."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    s = spans.withColumn("new", F.when(F.col("start") - F.lag("end").over(w) <= gap, 0).otherwise(1))
    s = s.withColumn("cluster", F.sum("new").over(w))
    return s.groupBy("doc_id", "cluster").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.count(F.lit(1)).alias("n"))


def runs(rows: DataFrame, flag: str, order: str) -> DataFrame:
    """Longest run of consecutive rows with flag, per document: first place and length."""
    w = Window.partitionBy("doc_id").orderBy(order)
    island = rows.withColumn("place", F.row_number().over(w)).where(flag).withColumn("island", F.col("place") - F.row_number().over(w))
    r = island.groupBy("doc_id", "island").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    return r.groupBy("doc_id").agg(F.max_by("first", F.struct("n", -F.col("first"))).alias("first"), F.max("n").alias("n"))


def decayed(rows: DataFrame, value: str, order: str, keep: float, release: str) -> DataFrame:
    """A buffer that keeps a share of itself from row to row, takes value in, and empties at a release."""
    step = lambda a, x: F.struct(F.when(x["r"], F.lit(0.0)).otherwise(a["b"] * keep + x["v"]).alias("b"), F.concat(a["out"], F.array(F.struct(x["o"].alias("o"), F.when(x["r"], F.lit(0.0)).otherwise(a["b"] * keep + x["v"]).alias("b")))).alias("out"))
    item = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"), F.col(release).alias("r"))
    per = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("x"))  # the rows of one document
    zero = F.struct(F.lit(0.0).alias("b"), F.array().cast(f"array<struct<o:{dict(rows.dtypes)[order]},b:double>>").alias("out"))
    return per.select("doc_id", F.explode(F.aggregate("x", zero, step)["out"]).alias("r")).select("doc_id", F.col("r.o").alias(order), F.round("r.b", 6).alias("buffer"))


def best_apart(windows: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` windows (doc_id, start, end, score) of a document, best first, none overlapping another."""
    w = F.struct((-F.col("score")).alias("k"), "start", "end", "score")
    per = windows.groupBy("doc_id").agg(F.sort_array(F.collect_list(w)).alias("x"))  # the windows of one document
    kind = "array<struct<k:double,start:int,end:int,score:double>>"
    step = lambda a, x: F.when((F.size(a) >= most) | F.exists(a, lambda o: (o["end"] > x["start"]) & (o["start"] < x["end"])), a).otherwise(F.concat(a, F.array(x)))
    picked = F.aggregate(F.col("x").cast(kind), F.array().cast(kind), step)
    return per.select("doc_id", F.posexplode(picked).alias("rank", "p")).select("doc_id", "rank", "p.start", "p.end", "p.score")
