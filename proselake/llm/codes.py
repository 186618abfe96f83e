"""Product codes for vectors: Lloyd's rounds with Hamerly's bounds, in exact integers.

A vector's components become integers and are cut into parts; each part has a codebook of its own.
Between rounds every part keeps its entry, an upper bound of the distance to it and one lower bound of
the distance to the second nearest.  Bounds are moved by as much as the entries moved, always
outward; only a part whose upper bound is not strictly below what separates it from all other entries is
looked at again, first against its own entry, then against all of them.  So ties always reach the full
scan, which takes the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

SCALE = 1024
#: Components from here on are no vectors' any more: squared distances must fit 64 bits.
LARGEST = 1 << 14
STATE = "vec_id long, label {kind}, x array<int>, code array<int>, upper array<double>, lower array<double>"
_BLOCK = 2048


def _up(x):
    return np.nextafter(x, np.inf)


def _down(x):
    return np.nextafter(x, -np.inf)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x by entries), as integers or as doubles that hold integers."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    if x.shape[1] * reach * reach < 1 << 53:  # every intermediate value is an integer that a double holds
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        gap = x[:, k, None] - book[None, :, k]
        out += gap * gap
    return out


def own_distance(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    gap = x - book[code]
    return (gap * gap).sum(1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, upper bound, lower bound of the second nearest); ties go to the lower index."""
    code, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
    for at in range(0, len(x), _BLOCK):
        d = distances(x[at : at + _BLOCK], book)
        best = d.argmin(1)
        row = np.arange(len(d))
        code[at : at + _BLOCK], upper[at : at + _BLOCK] = best, _up(np.sqrt(d[row, best].astype(np.float64)))
        if len(book) > 1:
            d = d.astype(np.float64)
            d[row, best] = np.inf
            lower[at : at + _BLOCK] = _down(np.sqrt(d.min(1)))
    return code, upper, lower


@dataclass
class Motion:
    """What a round did to one part's codebook: how far each entry moved, how far any other did at most, and half
    the way to the nearest other entry."""

    moved: np.ndarray
    others: np.ndarray
    apart: np.ndarray


def motion(old: np.ndarray, new: np.ndarray) -> Motion:
    gap = new - old
    moved = _up(np.sqrt((gap * gap).sum(1).astype(np.float64)))
    if len(new) == 1:
        return Motion(moved, np.zeros(1), np.full(1, np.inf))
    top = np.argsort(-moved, kind="stable")[:2]
    others = np.full(len(moved), moved[top[0]])
    others[top[0]] = moved[top[1]]
    d = distances(new, new).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return Motion(moved, others, _down(np.sqrt(d.min(1)) / 2))


def update(x: np.ndarray, book: np.ndarray, m: Motion, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves the bounds in place and assigns anew where they fail; returns how many parts were fully scanned."""
    upper[:] = _up(upper + m.moved[code])
    lower[:] = _down(lower - m.others[code])
    clear = np.maximum(lower, m.apart[code])
    doubt = np.flatnonzero(~(upper < clear))
    upper[doubt] = _up(np.sqrt(own_distance(x[doubt], book, code[doubt]).astype(np.float64)))
    doubt = doubt[~(upper[doubt] < clear[doubt])]
    if len(doubt):
        code[doubt], upper[doubt], lower[doubt] = scan(x[doubt], book)
    return len(doubt)


def cuts(width: int, parts: int) -> list[int]:
    return [width * j // parts for j in range(parts + 1)]


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1), kind))


def _begin(books: list[np.ndarray], at: list[int]):
    """(vec_id, label, embedding) -> the first state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(SCALE * _matrix(b.column(2), at[-1], np.float64)).astype(np.int64)
            found = [scan(x[:, i:j], book) for i, j, book in zip(at[:-1], at[1:], books, strict=True)]
            code, upper, lower = (np.stack([f[k] for f in found], 1) for k in range(3))
            yield _state(b, x, code, upper, lower)

    return run


def _state(b: pa.RecordBatch, x, code, upper, lower) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(x, pa.int32()), _lists(code, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64())], ["vec_id", "label", "x", "code", "upper", "lower"])


def _step(books: list[np.ndarray], motions: list[Motion], at: list[int]):
    """A state -> the next one, under new codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), at[-1], np.int64)
            code, upper, lower = _matrix(b.column(3), len(books), np.int64).copy(), _matrix(b.column(4), len(books), np.float64).copy(), _matrix(b.column(5), len(books), np.float64).copy()
            for j, book in enumerate(books):
                c, u, v = code[:, j].copy(), upper[:, j].copy(), lower[:, j].copy()
                update(x[:, at[j] : at[j + 1]], book, motions[j], c, u, v)
                code[:, j], upper[:, j], lower[:, j] = c, u, v
            yield _state(b, x, code, upper, lower)

    return run


def _sums(sizes: list[int], at: list[int]):
    """A state -> for each task, part and entry that it met: how many parts, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(k, np.int64) for k in sizes]
        total = [np.zeros((k, j - i), np.int64) for k, i, j in zip(sizes, at[:-1], at[1:], strict=True)]
        for b in batches:
            x, code = _matrix(b.column(0), at[-1], np.int64), _matrix(b.column(1), len(sizes), np.int64)
            for j in range(len(sizes)):
                n[j] += np.bincount(code[:, j], minlength=sizes[j])
                np.add.at(total[j], code[:, j], x[:, at[j] : at[j + 1]])
        met = [(j, e) for j in range(len(sizes)) for e in np.flatnonzero(n[j])]
        rows = [[j for j, _ in met], [int(e) for _, e in met], [int(n[j][e]) for j, e in met], [total[j][e].tolist() for j, e in met]]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "entry", "n", "total"])

    return run


def _errors(books: list[np.ndarray], at: list[int]):
    """A state -> vec_id, label, code, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, code = _matrix(b.column(2), at[-1], np.int64), _matrix(b.column(3), len(books), np.int64)
            error = np.zeros(len(x), np.int64)
            for j, book in enumerate(books):
                error += own_distance(x[:, at[j] : at[j + 1]], book, code[:, j])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def mean_entries(state: DataFrame, books: list[np.ndarray], at: list[int]) -> list[np.ndarray]:
    """The codebooks with every entry in use replaced by the floor of its parts' mean.  A task sends one row for each
    entry it met; the driver sees one number for each component of an entry."""
    partial = state.select("x", "code").mapInArrow(_sums([len(b) for b in books], at), "part int, entry int, n long, total array<long>")
    merged = partial.select("part", "entry", "n", F.posexplode("total").alias("place", "v")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out = [b.copy() for b in books]
    for r in merged.collect():  # at most entries x width numbers
        out[r.part][r.entry, r.place] = r.v // r.n
    return out


@dataclass
class Codes:
    """books: an array (entries x width) for each part; rows: vec_id, label, code array<int>, error long."""

    books: list[np.ndarray]
    rows: DataFrame

    def books_sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def kept(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null, not empty and has only finite components."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= LARGEST))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)


def compress(spark: SparkSession, vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codes:
    """vectors (vec_id, embedding, label) -> codebooks, and a code and an error for each row kept.

    - Rows with a null or empty vector or with a null or non-finite component are dropped, and so are those with
      a component of 16384 or more and those of another length than the vector of the least vec_id.  Parts are as
      equal as can be where the length is no multiple of ``parts``.
    - The codebooks start as the parts of the ``entries`` least vec_ids (all, where there are fewer); among equal
      vec_ids the lesser vector is first, a null vec_id comes last.  Repeated rows count as often as they occur.
    - An empty table, or one without a row to keep, gives empty codebooks and no rows.
    - Other columns are ignored; a column of ``vectors`` never meets one of the state.

    Each round reads the written state of the one before, so a lost executor costs a re-read.
    """
    s = Scratch(spark, "codes")
    kind = dict(vectors.dtypes)["label"]
    good = kept(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    first = good.orderBy(*order).limit(1).collect()
    shape = f"vec_id long, label {kind}, code array<int>, error long"
    if not first:
        return Codes([np.empty((0, 0), np.int64) for _ in range(parts)], spark.createDataFrame([], shape))
    width = len(first[0].embedding)
    good = good.where(F.size("embedding") == width)
    start = np.floor(SCALE * np.array([r.embedding for r in good.orderBy(*order).limit(entries).select("embedding").collect()])).astype(np.int64)
    at = cuts(width, parts)
    books = [start[:, i:j].copy() for i, j in zip(at[:-1], at[1:], strict=True)]
    schema = STATE.format(kind=kind)
    state = s.put(good.select("vec_id", "label", "embedding").mapInArrow(_begin(books, at), schema))
    for _ in range(rounds):
        new = mean_entries(state, books, at)
        moved = [motion(a, b) for a, b in zip(books, new, strict=True)]
        books = new
        nxt = s.put(state.mapInArrow(_step(books, moved, at), schema))
        s.drop(state)
        state = nxt
    return Codes(books, state.mapInArrow(_errors(books, at), shape))


def decode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows (code, ...) with ``decoded``: the vector that each code stands for.  A null code gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(b.schema.get_field_index("code"))
            full = codes.is_valid().to_numpy(zero_copy_only=False)
            c = _matrix(codes.drop_null(), len(books), np.int64)
            out = np.concatenate([book[c[:, j]] for j, book in enumerate(books)], 1) / SCALE
            lists, k = [None] * len(codes), 0
            for i in np.flatnonzero(full):
                lists[i], k = out[k].tolist(), k + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.float64()))], [*b.schema.names, "decoded"])

    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit(None).cast("array<double>")).schema)


def op13_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    hexes = F.concat_ws("", F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    rows = Scratch(spark, "codes").put(found.rows.select("vec_id", "label", hexes.alias("code"), "error"))
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(found.books_sha256()).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """CTEs of round k: near{k} assigns parts to book{k}, book{k + 1} has the means."""
    return f"""d{k} AS MATERIALIZED (SELECT r, part, entry, sum((v - c) * (v - c)) AS d FROM x JOIN book{k} USING (part, pos) GROUP BY ALL),
        near{k} AS MATERIALIZED (SELECT r, part, entry, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1),
        mean{k} AS (SELECT part, entry, pos, sum(v) AS t, count(*) AS n FROM x JOIN near{k} USING (r, part) GROUP BY ALL),
        book{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((t - (((t % n) + n) % n)) // n, c) AS c FROM book{k} LEFT JOIN mean{k} USING (part, entry, pos))"""


#: Parts of 16 components: the given vectors have 64.
ORACLE_SQL = f"""WITH good AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    x AS MATERIALIZED (SELECT r, (g - 1) // 16 AS part, (g - 1) % 16 AS pos, CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) AS v FROM (SELECT r, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS g FROM good)),
    book0 AS MATERIALIZED (SELECT part, r AS entry, pos, v AS c FROM x WHERE r < 256), {", ".join(_round(k) for k in range(5))},
    ends AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near4 GROUP BY r)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book4) AS codebooks_sha256 FROM good JOIN ends USING (r)"""
