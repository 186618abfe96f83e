"""Packing token streams into windows of fixed capacity by minimum bin slack.

Each document is cut into full windows and one remainder.  Remainders are pooled by length; for each
window a subset-sum over the pool's lengths, held as one big-integer bitset per length, finds the
fill closest to the capacity, and walking the bitsets back gives how many of each length to take.
The longest remainder is always in the window, so the pool empties in steps.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import HELD, lean

CAPACITY = 1024
#: Documents whose remainders are pooled together; a pool also ends with its task.
POOL = 20_000
#: White space on which regex engines may differ.
_OTHER_SPACE = re.compile(r"[^\S \n\t\r]")


class Encoder:
    """Ids of the byte-level BPE as little-endian 32-bit bytes, end id 0 not included.

    The same ranks and pattern give the same ids as the tokenizer file, in less time and without a
    cache of words; texts with rarer white space, or with what may be a special token, go to the
    tokenizer itself.
    """

    def __init__(self, model: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(model)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        if "<|" in text or _OTHER_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = array("I", self.fast.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


_encoders: dict[tuple[str, str], Encoder] = HELD.setdefault("packing", {})


def encoder(model: str, ranks: str) -> Encoder:
    if (model, ranks) not in _encoders:
        _encoders[model, ranks] = Encoder(model, ranks)
    return _encoders[model, ranks]


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that the sum is as close to capacity as it can be; the
    longest length is taken once at least."""
    top = max(counts)
    room = capacity - top
    full = (1 << room + 1) - 1
    reach, steps = 1, []
    for size in sorted(counts, reverse=True):
        n = counts[size] - (size == top)
        before, k = reach, 1
        layers = []
        while n > 0 and size * k <= room:  # binary splitting of the count
            k = min(k, n)
            layers.append((k, reach))
            reach |= (reach << size * k) & full
            n -= k
            k *= 2
        if layers:
            steps.append((size, layers))
        if reach >> room & 1:
            break
        del before
    at = reach.bit_length() - 1
    take = defaultdict(int)
    take[top] = 1
    for size, layers in reversed(steps):
        for k, had in reversed(layers):
            if not had >> at & 1:
                take[size] += k
                at -= size * k
    return dict(take)


def _texts(column: pa.Array) -> Iterator[str]:
    """The texts one at a time, null as empty."""
    for i in range(0, len(column), 256):
        yield from (t or "" for t in column.slice(i, 256).to_pylist())


def _pack(model: str, ranks: str, capacity: int, end: int, pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, ranks)
        seq, close = TaskContext.get().partitionId() << 40, end.to_bytes(4, "little")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows: list[tuple] = []
        spare: dict[int, list[tuple]] = defaultdict(list)
        held = 0

        def out():
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        def empty():
            nonlocal seq
            counts = {n: len(v) for n, v in spare.items()}
            while counts:
                take, at = fill(counts, capacity), 0
                times = min(counts[n] // k for n, k in take.items())  # the same fill while it lasts
                for _ in range(times):
                    at = 0
                    for n, k in take.items():
                        for _ in range(k):
                            rows.append((*spare[n].pop(), seq, at))
                            at += n
                    seq += 1
                for n, k in take.items():
                    counts[n] -= k * times
                    if not counts[n]:
                        del counts[n]
            spare.clear()

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                ids = enc.encode(text) + close
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    size = len(piece) // 4
                    row = (doc, at, size, zlib.crc32(piece), n)
                    if size == capacity:
                        rows.append((*row, seq, 0))
                        seq += 1
                    else:
                        spare[size].append(row)
                held += 1
                if held >= pool:
                    empty()
                    held = 0
                if len(rows) >= 20_000:
                    yield out()
        empty()
        yield out()

    return run


def pack(docs: DataFrame, *, model: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, end: int = 0, pool: int = POOL) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Every id of every document, its end id included, is in exactly one piece; pieces of a sequence
    lie gapless from offset 0 and sum to at most ``capacity``.  Null or empty text is the end id
    alone.  Each task packs what it reads in pools of ``pool`` documents, so that nothing is
    shuffled; at most the last window of a pool is far from full.  sequence_id is unique over
    the table; it depends on how the input is split, as does which pieces share a sequence.
    Repeated rows are packed each for itself; a null doc_id stays null.  An empty table gives no rows; very long texts
    are encoded whole in one task and fall into pieces; other columns are ignored, whatever their names.
    """
    model = model or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(_pack(model, ranks, capacity, end, pool), "packing"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def op8_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
