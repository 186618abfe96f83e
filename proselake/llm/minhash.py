"""Near-duplicate groups: SuperMinHash, banding, verification on full shingle sets, union-find.

SuperMinHash gives element x at rank j the value (j, r_j(x)) for the component at place j of x's
own random permutation.  Ranks are correlated over components, which lowers the variance, and a
document stops at the first rank that can no longer lower any of its components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .text import U, chunks, doc_hash, lean, mix, ngrams, words_of

BANDS, ROWS = 42, 6
LISTED = 10
#: Bits of a sieve; 2^24 take 262,144 rows.
SIEVE = 1 << 24
_LOW = U((1 << 40) - 1)


def shingles(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, flat, with row boundaries."""
    w = words_of(batch, lower=True)
    h, nd = w.hashes(), len(w.ptr) - 1
    left = w.left()
    full = ngrams(h, size, 7)
    at = np.flatnonzero(left >= size)
    val, doc = [full[at]], [w.doc[at]]
    n = np.diff(w.ptr)
    for k in range(1, size):  # fewer words: the whole sequence is the only shingle
        d = np.flatnonzero(n == k)
        if len(d):
            val.append(ngrams(h, k, 7 + k)[w.ptr[d]])
            doc.append(d)
    val, doc = np.concatenate(val), np.concatenate(doc)  # a document's shingles are all of one length and lie together
    val, doc = val[order := np.argsort(doc, kind="stable")], doc[order]
    ptr = np.searchsorted(doc, np.arange(nd + 1))
    for a, z in pairwise(ptr.tolist()):
        val[a:z].sort()
    new = np.ones(len(val), bool)
    new[1:] = (val[1:] != val[:-1]) | (doc[1:] != doc[:-1])
    return val[new], np.concatenate([[0], np.cumsum(new)])[ptr]


def superminhash(val: np.ndarray, ptr: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m); all ones for an empty set.

    Most documents end after a few ranks, so the first LISTED ranks keep an element's permutation as
    the exchanges made so far (places: where, moved: what came there); what is left then gets it whole.
    """
    nd = len(ptr) - 1
    sig = np.full((nd, m), ~U(0), np.uint64)
    doc = np.repeat(np.arange(nd), np.diff(ptr))
    kind = np.uint16 if m > 256 else np.uint8
    places, moved = [], []
    x, perm, row, live = val, None, None, np.arange(nd)
    for j in range(m):
        u = mix(x + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = U(j) + (((u >> U(40)) * U(m - j)) >> U(24))
        if perm is None:
            k = k.astype(kind)
            comp, here = k.copy(), np.full(len(k), j, kind)
            for a, b in zip(places, moved, strict=True):
                np.copyto(comp, b, where=a == k)
                np.copyto(here, b, where=a == j)
            places, moved = [*places, k], [*moved, here]
        else:
            k = k.astype(np.int64)
            comp = perm[row, k]
            perm[row, k] = perm[:, j]
        np.minimum.at(sig.reshape(-1), doc * m + comp, (U(j) << U(40)) | (u & _LOW))
        live = live[sig[live].max(axis=1) > (U(j + 1) << U(40))]
        if j + 1 == m or not len(live):
            break
        still = np.zeros(nd, bool)
        still[live] = True
        stay = np.flatnonzero(still[doc])
        if not len(stay):
            break
        if perm is None:
            if len(stay) < 0.9 * len(x):
                x, doc, places, moved = x[stay], doc[stay], [a[stay] for a in places], [b[stay] for b in moved]
            if j + 1 == LISTED:
                perm, row = np.tile(np.arange(m, dtype=kind), (len(x), 1)), np.arange(len(x))
                for a, b in zip(places, moved, strict=True):
                    perm[row, a] = b
        elif len(stay) < 0.7 * len(x):
            x, doc, perm = x[stay], doc[stay], perm[stay]
            row = row[: len(x)]
    return sig


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, limit=700_000):
                val, ptr = shingles(b, size)
                n = np.diff(ptr)
                sig = superminhash(val, ptr, bands * rows).reshape(len(n), bands, rows)
                key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(n), 1))
                for r in range(rows):
                    key = mix(key * U(0xD6E8FEB86659FD93) + sig[:, :, r])
                flat = key.reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(doc_hash(val, ptr).view(np.int64)), lists, *b.columns[2:]], ["doc_id", "n", "sid", "bands", *b.schema.names[2:]])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big):
                val, ptr = shingles(b, size)
                raw = [val[a:z].tobytes() for a, z in zip(ptr[:-1], ptr[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_hash(val, ptr).view(np.int64)), pa.array(raw, pa.binary())], ["sid", "elems"])

    return run


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for p, q in zip(b.column(2), b.column(3), strict=True):
            p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            out.append((len(p), len(q), int((q[at] == p).sum()) if len(q) else 0))
        na, nb, both = np.array(out, np.int64).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(na), pa.array(nb), pa.array(both)], ["a", "b", "na", "nb", "both"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(centre, sid, in_main, centre's set, set) -> a row per element that only one of the two sets has."""
    for big in batches:
        for at in range(0, big.num_rows, 512):
            b = big.slice(at, 512)
            lists = []
            for c, e in zip(b.column(3), b.column(4), strict=True):
                lists.append(np.setxor1d(np.frombuffer(c.as_py(), np.uint64), np.frombuffer(e.as_py(), np.uint64), assume_unique=True).view(np.int64))
            rows = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(3)), pa.array(np.concatenate(lists), pa.int64())], ["centre", "sid", "in_main", "e"])


def near_duplicates(spark: SparkSession, docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per input row.

    Two documents are linked where 100 * |intersection| >= percent * |union| of their distinct
    word shingles, confirmed on full sets; component_id is the least doc_id reachable.
    A pair just at 0.85 shares no band of 42 x 6 with probability 2e-9.

    - Equal sets are grouped by a digest first: a group of copies costs one row per copy.
    - Each bucket compares its members with one centre, the member that fills the largest
      buckets (usually the text that the others were copied from).  What these links don't join
      is compared across components: members that may be linked differ from the centre in common
      shingles, and the rarest of these stand early in the order of both; candidates are pairs
      that meet in such early differences, so no link is lost and pairs stay few.
    - Null or empty text, or text without words: no shingles, linked with nothing, kept.
      A null doc_id gives a null component where no other id is in reach, and kept = false.
      Repeated rows have equal sets and share a component.  Columns besides these two are ignored.
    """
    return _grouped(spark, docs, shingle, percent, bands, rows)


def _version():
    """Tells texts with one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _sieve(s: Scratch, keys: DataFrame) -> DataFrame:
    """The bits of a fixed number that the hashes in column key fall on, in words of 64: at most SIEVE / 64 rows, to be
    broadcast.  It catches all rows with these keys and, with 60,000 keys to a percent of bits set, few others."""
    bit = keys.select(F.pmod("key", F.lit(SIEVE)).alias("bit"))
    bits = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    return F.broadcast(s.put(bits))


def _caught(key: Column) -> Column:
    """Condition of a join with a sieve: the key's bit is set."""
    bit = F.pmod(key, F.lit(SIEVE))
    return (F.col("word") == F.call_function("shiftright", bit, F.lit(6))) & F.call_function("getbit", F.col("bits"), (bit % 64).cast("int")).cast("boolean")


def _grouped(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, versioned: bool = False) -> DataFrame:
    """near_duplicates, with the column version where asked for."""
    s = Scratch(spark, "minhash")
    extra = ["version"] if versioned else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([_version().alias("version")] if versioned else []))
    sig = s.put(docs.mapInArrow(lean(_signatures(shingle, bands, rows)), "doc_id long, n long, sid long, bands array<long>" + ", version long" * versioned))
    docs = docs.select("doc_id", "text")
    sets = s.put(sig.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")))
    member = sets.select("sid", F.explode("bands").alias("bucket"))
    many = s.put(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    member = s.put(member.join(many, "bucket"))
    weight = member.groupBy("sid").agg(F.sum("size").alias("weight"))
    weight = s.put(weight)
    centre = s.put(member.join(weight, "sid").groupBy("bucket").agg(F.max(F.struct("weight", "sid")).alias("top")).select("bucket", F.col("top.sid").alias("centre")))
    s.drop(many)
    near = s.put(member.join(centre, "bucket").where("sid <> centre").select(F.col("sid").alias("a"), F.col("centre").alias("b")).distinct())

    texts = weight.join(sets.select("sid", "first_id"), "sid").where("first_id is not null").select(F.xxhash64("first_id").alias("key"))
    # Texts needn't move to be found: the sieve lets some others through, which go by their sid.  A text that only rows without
    # a doc_id hold is taken from these.
    shown = docs.join(_sieve(s, texts), _caught(F.xxhash64("doc_id")), "left_semi").union(docs.where("doc_id is null"))
    elems = s.put(shown.mapInArrow(lean(_full_sets(shingle)), "sid long, elems binary").join(weight.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]))

    def verify(pairs: DataFrame) -> DataFrame:
        left = elems.select(F.col("sid").alias("a"), F.col("elems").alias("ea"))
        right = elems.select(F.col("sid").alias("b"), F.col("elems").alias("eb"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb")
        return both.mapInArrow(lean(_intersect), "a long, b long, na long, nb long, both long")

    checked = s.put(verify(near))
    ok = f"100 * both >= {percent} * (na + nb - both)"
    links = s.put(checked.where(ok).select(F.col("a").alias("u"), F.col("b").alias("v")))
    group = s.put(components(s, links))

    # Centres whose members are still in several components: compare across them.  off: in how many shingles a member
    # and its centre differ.  Two members a and b differ in off_a + off_b shingles, less twice those in which both differ from the centre.
    rows_ = checked.select(F.col("b").alias("centre"), F.col("a").alias("sid"), F.col("na").alias("n"), F.expr("na + nb - 2 * both").alias("off"))
    rows_ = rows_.union(checked.select("b", "b", "nb", F.lit(0).cast("long")).distinct()).join(group.withColumnRenamed("node", "sid"), "sid", "left")
    rows_ = s.put(rows_.select("centre", "sid", F.coalesce("component", "sid").alias("comp"), "n", "off"))
    held = rows_.groupBy("centre", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("centre").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
    mixed = s.put(held.where("comps > 1").select("centre", F.col("top.comp").alias("main")))
    every = s.put(rows_.where("off > 0").join(mixed, "centre").select("centre", "sid", "comp", "n", "off", (F.col("comp") == F.col("main")).alias("in_main")))
    inside = elems.select(F.col("sid").alias("centre"), F.col("elems").alias("ec"))
    differ = every.select("centre", "sid", "in_main").join(inside, "centre").join(elems, "sid").select("centre", "sid", "in_main", "ec", "elems")
    differ = s.put(differ.mapInArrow(lean(_differences), "centre long, sid long, in_main boolean, e long"))
    # Differences that the same members have (those of one edit) meet as one, with their number as weight.
    holders = differ.groupBy("centre", "e").agg(F.count(F.lit(1)).alias("k"), F.min("in_main").alias("all_main"), F.bit_xor(F.xxhash64("sid")).alias("h1"), F.bit_xor(F.xxhash64("sid", F.lit(7))).alias("h2"))
    twice = holders.where("k > 1 and not all_main").groupBy("centre", "k", "h1", "h2").agg(F.min("e").alias("e"), F.count(F.lit(1)).alias("o")).select("centre", "e", "k", "o")
    # Of two members in different components one is not linked to the centre, so a linked pair always has common differences.  Each
    # member's differences are ordered by their holders, fewest first (those of its own before all); left: how many stand from one on.  The
    # first common one of a linked pair has all common ones from it on in both members, which only few early differences leave room for.
    order = Window.partitionBy("centre", "sid").orderBy(F.desc("k"), F.desc("e")).rowsBetween(Window.unboundedPreceding, 0)
    early = differ.select("centre", "sid", "e").join(twice, ["centre", "e"]).withColumn("left", F.sum("o").over(order)).drop("k")
    early = s.put(early.join(every.drop("in_main"), ["centre", "sid"]).where(f"{percent} * (off - left) <= {100 - percent} * n"))
    # The member that differs less (less_) has half as many early ones.
    less = early.where(f"{2 * percent} * (off - left) <= {100 - percent} * n").select("centre", "e", *(F.col(c).alias(f"less_{c}") for c in ("sid", "comp", "n", "off", "left")))
    apart = "less_comp <> comp and (less_off < off or (less_off = off and less_sid < sid))"
    enough = f"{100 + percent} * (less_off + off - 2 * least(less_left, left)) <= {100 - percent} * (less_n + n)"
    found = less.alias("p").join(early.alias("q"), F.expr(f"p.centre = q.centre and p.e = q.e and {apart} and {enough}"))
    cross = s.put(found.select(F.least("less_sid", "sid").alias("a"), F.greatest("less_sid", "sid").alias("b")).distinct())
    more = verify(cross).where(ok).select(F.col("a").alias("u"), F.col("b").alias("v"))
    more = s.put(more)
    if not more.isEmpty():
        group = s.put(components(s, links.union(more)))
    first = sets.join(group.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("component", "sid").alias("comp"), "first_id")
    least = first.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = s.put(first.join(least, "comp").select("sid", "component_id"))
    s.drop(member, weight, centre, near, elems, checked, links, rows_, mixed, every, differ, early, cross, more, sets, group)
    out = sig.select("doc_id", *extra, "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(named, "sid", "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", *extra, F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose document stands for its group; rows with a null doc_id stay.  Texts
    that share a doc_id are judged each for itself.  An empty table stays empty; other columns come back
    as they are, whatever their names."""
    s = Scratch(spark, "minhash")
    gone = s.put(_grouped(spark, docs, **options, versioned=True).where("not kept and doc_id is not null").select(F.col("doc_id").alias("doc"), "version").distinct())
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), _version().alias("version"))
    # Only rows that the sieve catches are shuffled.
    sieve, caught = _sieve(s, gone.select(F.xxhash64("doc", "version").alias("key"))), _caught(F.xxhash64("doc", "version"))
    rest = marked.join(sieve, caught, "left_semi").join(gone, ["doc", "version"], "left_anti")
    return marked.join(sieve, caught, "left_anti").unionByName(rest).select("row.*")


def op1_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(spark, docs, shingle=3, percent=85)
