"""SimHash groups: fingerprints as bit counts of segments, met in a grid, verified bit by bit.

A fingerprint's 64 bits are 32 segments of two; the counts of ones in them are its point.  The Manhattan distance
of two points is never more than the bits in which their fingerprints differ, so points of linked fingerprints
are at most 3 apart, and of ``bands`` bands of segments at least bands - 3 have equal counts.  A cell of the
grid is a choice of bands - 3 bands with their counts: linked fingerprints meet in one cell at least.

A cell is compared inside one task, which gives the links of a spanning forest, never all pairs.  A cell of more
than CELL fingerprints is dealt into blocks, each pair of blocks for itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .text import LOWER, U, Words, bytes_of, chunks, lean, mix

SEED = 42
BITS = 64
MOST = 3
SEGMENTS = 32
#: Fingerprints that a cell, or a block of one, holds at most on average.
CELL = 2048
_SLICE = 1 << 16


def fingerprints(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The fingerprint of each text: bits that over half of its word shingles' hashes have, repeats included."""
    buf, off = bytes_of(batch.column(batch.schema.get_field_index("text")))
    low = LOWER[buf]
    w = Words(low, off)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(w.start):
        return out
    # Words of a text, each with one space after it; a shingle is a slice without the last space.
    lengths = w.end - w.start
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(at[-1], 32, np.uint8)
    step = np.repeat(w.start - at[:-1], lengths)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    place = np.flatnonzero(inside)
    joined[place] = low[place + step]
    raw = joined.tobytes()
    n = np.diff(w.ptr)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), many)
    first = w.ptr[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    last = np.minimum(first + size, w.ptr[1:][doc])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:z], SEED) for a, z in zip(at[first].tolist(), (at[last] - 1).tolist(), strict=True)), np.uint64, len(first))
    ones = np.zeros((len(n), BITS), np.int64)
    for i in range(0, len(h), _SLICE):
        bits = np.unpackbits(h[i : i + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d = doc[i : i + _SLICE]
        new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        ones[d[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b, size).view(np.int64))], ["doc_id", "fp"])

    return run


def point(fp: np.ndarray) -> np.ndarray:
    """Ones in each of the 32 segments, as 32 numbers of two bits, side by side."""
    odd = U(0x5555555555555555)
    return (fp & odd) + ((fp >> U(1)) & odd)


def band_masks(bands: int) -> list[int]:
    """The segments dealt into bands as equal as can be, as masks over a point's bits."""
    ends = [SEGMENTS * b // bands for b in range(bands + 1)]
    return [sum(3 << 2 * s for s in range(i, j)) for i, j in itertools.pairwise(ends)]


def cells(fp: np.ndarray, bands: int) -> np.ndarray:
    """The grid cells of each fingerprint (rows x choices): a hash of a choice and of the counts in its bands."""
    p, masks = point(fp), band_masks(bands)
    chosen = list(itertools.combinations(range(bands), bands - MOST))
    keys = [mix(mix(p & U(sum(masks[b] for b in c))) ^ U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k, c in enumerate(chosen)]
    return np.stack(keys, 1)


def enough_bands(n: int) -> int:
    """Bands for n fingerprints: as many as keep chance meetings in the cells of one below some ten.  Any number is exact."""
    for bands in (5, 6, 8, 10, 12):
        free = 1.5 * SEGMENTS * (bands - MOST) / bands  # bits that the counts of a cell's bands are worth
        if n * len(list(itertools.combinations(range(bands), MOST))) <= 10 * 2**free:
            break
    return bands


def _cells(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, len(big), 20_000):
                fp = big.column(0)[at : at + 20_000].to_numpy().view(np.uint64)
                key = cells(fp, bands)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, key.shape[1]).view(np.int64))], ["cell", "fp"])

    return run


def spanning(fp: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over distinct fingerprints, of which those that differ in ``most`` bits are linked.

    A fingerprint is compared once with those that no tree has yet: of these only such whose count of ones is at
    most ``most`` away, by the Manhattan distance of their points first and then bit by bit.
    """
    ones = np.bitwise_count(fp)
    order = np.argsort(ones, kind="stable")
    f, ones = fp[order], ones[order].astype(np.int64)
    points, odd = point(f), U(0x5555555555555555)
    left = np.arange(len(f))
    us, vs = [], []
    while len(left):
        open_, left = [left[0]], left[1:]
        while open_ and len(left):
            i = open_.pop()
            a, z = np.searchsorted(ones[left], (ones[i] - most, ones[i] + most + 1))
            gap = points[i] ^ points[left[a:z]]
            # Counts of 0, 1 and 2 differ where their numbers do, and by two where these are 0 and 2.
            far = np.bitwise_count((gap | (gap >> U(1))) & odd) + np.bitwise_count((gap >> U(1)) & ~gap & odd)
            near = a + np.flatnonzero(far <= most)
            near = near[np.bitwise_count(f[i] ^ f[left[near]]) <= most]
            if len(near):
                got = left[near]
                us.append(np.full(len(got), f[i]))
                vs.append(f[got])
                open_ += got.tolist()
                left = np.delete(left, near)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, b1, b2, fp) in order of the first three -> links inside each of them."""

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = [rows.column(k).to_numpy() for k in range(3)]
        fp = rows.column(3).to_numpy().view(np.uint64)
        new = np.ones(len(fp) + 1, bool)
        new[1:-1] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        cut = np.flatnonzero(new)
        size = np.diff(cut)
        us, vs = [], []
        two = cut[:-1][size == 2]  # most cells: one comparison each, all at once
        if len(two):
            ok = np.bitwise_count(fp[two] ^ fp[two + 1]) <= MOST
            us.append(fp[two[ok]])
            vs.append(fp[two[ok] + 1])
        for i in np.flatnonzero(size > 2):
            u, v = spanning(fp[cut[i] : cut[i + 1]])
            us.append(u)
            vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        rows = pa.Table.from_batches(held)
        if len(rows) < 50_000:
            continue
        same = np.all([(k := rows.column(c).to_numpy()) == k[-1] for c in range(3)], axis=0)
        cut = len(rows) - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield from of(rows.slice(0, cut))
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield from of(pa.Table.from_batches(held))


def near_fingerprints(spark: SparkSession, docs: DataFrame, *, shingle: int = 5) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (the fingerprint as a signed long), component_id; a row for each row.

    Documents link where their fingerprints differ in at most 3 bits; component_id is the least doc_id in reach.

    - Null or empty texts, and those without words, have fingerprint zero and are linked like any other; a text of
      fewer words than a shingle has one shingle, all its words.
    - Repeated rows and equal texts have one fingerprint, so they share a component; they cost one row each and are
      compared once.  A null doc_id never names a component; one that only reaches such has a null component.
    - Very long texts are hashed in one task, some 60 bytes for each of theirs; an empty table gives no rows.
      Other columns are ignored, whatever their names.
    """
    s = Scratch(spark, "simhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = s.put(docs.mapInArrow(lean(_fingerprints(shingle)), "doc_id long, fp long"))
    distinct = s.put(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    bands = enough_bands(distinct.count())
    grid = s.put(distinct.select("fp").mapInArrow(lean(_cells(bands)), "cell long, fp long"))
    # How many blocks a cell is dealt into; cells of one fingerprint have nothing to compare.
    shared = grid.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    met = grid.join(shared, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "own").alias("b1"), F.greatest(o, "own").alias("b2"))))
    dealt = met.withColumn("o", pair).select("cell", "o.b1", "o.b2", "fp").repartition("cell", "b1", "b2").sortWithinPartitions("cell", "b1", "b2")
    links = s.put(dealt.mapInArrow(lean(_links), "u long, v long").distinct())
    s.drop(grid)
    group = s.put(components(s, links))
    named = distinct.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = s.put(named.join(least, "component").select("fp", "component_id"))
    s.drop(distinct, links, group)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op11_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_fingerprints(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
