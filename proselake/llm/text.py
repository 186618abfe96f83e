"""Vectorised word and hash kernels over Arrow string columns (whole texts, UTF-8 bytes).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 equals
``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
NGRAM = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xA0761D6478BD642F))
#: A second, independent hash of words: another base, other byte values.
_BASE2 = 0xD1342543DE82EF95
_BASE2_INV = pow(_BASE2, -1, 1 << 64)
_BYTE_VALUES2 = mix(np.arange(1, 257, dtype=np.uint64) * U(0xE7037ED1A0B428DB) + U(0x589965CC75374CC3))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        step = np.full(size, U(base), np.uint64)
        step[0] = U(1)
        have = np.multiply.accumulate(step)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


#: Models that a Python worker keeps from task to task, by the kind of task that uses them.
HELD: dict[str, dict] = {}


def forget(keep: str | None) -> None:
    """Drops the models of other kinds of tasks and gives free memory back to the system."""
    for kind, models in HELD.items():
        if kind != keep:
            models.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable, keep: str | None = None) -> Callable:
    """``run`` over a task's batches, so that idle and reused workers hold no more than the models of ``keep``."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keep)
        yield from run(batches)
        forget(keep)

    return task


class Words:
    """Words of a few documents: byte positions and, per document, a range of word indexes."""

    __slots__ = ("buf", "doc", "end", "ptr", "start")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = buf
        solid = np.concatenate([[False], ~SPACE[buf], [False]])
        edge = solid[1:] & ~solid[:-1]
        close = solid[:-1] & ~solid[1:]
        inner = offsets[1:-1]
        both = solid[inner] & solid[inner + 1]  # a word may not run over the end of a document
        edge[inner[both]] = True
        close[inner[both]] = True
        self.start = np.flatnonzero(edge[:-1])
        self.end = np.flatnonzero(close)
        self.ptr = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.ptr))

    def hashes(self, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or a second one that is independent of it."""
        base, inverse, values = (_BASE2, _BASE2_INV, _BYTE_VALUES2) if second else (_BASE, _BASE_INV, _BYTE_VALUES)
        n = len(self.buf)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[self.buf] * powers(base, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(inverse, n + 1)[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * U(0x8CB92BA72F3D8DD7))

    def left(self) -> np.ndarray:
        """For each word, how many words its document has from it on."""
        return self.ptr[1:][self.doc] - np.arange(len(self.start))


def ngrams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of n consecutive values from each position (also over document ends: mask those)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = np.full(m, U(seed), np.uint64)
    for k in range(n):
        out = out * NGRAM + h[k : k + m]
    return mix(out)


def rolling(h: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Like ``ngrams`` for long n: from one running sum, whatever n is."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    base, inverse = (_BASE2, _BASE2_INV) if second else (_BASE, _BASE_INV)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, len(h)))])
    return mix((total[n:] - total[:-n]) * powers(inverse, len(h) - n + 1))


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n+1 offsets of a string column; null counts as empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    if pa.types.is_large_string(arr.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text, so that memory stays bounded."""
    col = batch.column(batch.schema.get_field_index(text))
    _, off = bytes_of(col)
    at, n = 0, len(col)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words_of(batch: pa.RecordBatch, text: str = "text", lower: bool = False) -> Words:
    buf, off = bytes_of(batch.column(batch.schema.get_field_index(text)))
    return Words(LOWER[buf] if lower else buf, off)


def ragged(flat: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row boundaries."""
    if flat.dtype == np.uint64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(flat, kind))


def doc_hash(h: np.ndarray, ptr: np.ndarray, seed: int = 1) -> np.ndarray:
    """One 64-bit value for each document's sequence of hashes."""
    n = len(h)
    pos = np.arange(n) - np.repeat(ptr[:-1], np.diff(ptr))
    v = mix(h ^ mix(pos.astype(np.uint64) + U(seed)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
    return mix(total[ptr[1:]] - total[ptr[:-1]] + np.diff(ptr).astype(np.uint64) * U(0x9E3779B97F4A7C15))
