"""Sampled segmentations: forward filtering and backward sampling over the piece lattice.

The lattice of a text's UTF-8 bytes has an edge for every piece and, as a fallback, for every byte.
Where no piece of the model has two bytes side by side, no edge crosses the place between them, so
the lattice falls apart there into units that are independent of each other, however long they are.
Forward sums (in logarithms) give each end point its mass; segmentations are drawn backwards with
random numbers that depend on the row key and the unit's place only, so they don't change with
partitioning.  Decoding joins the pieces' bytes and returns the very text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import _BASE, _BASE_INV, _BYTE_VALUES, HELD, U, bytes_of, chunks, lean, mix, powers

#: Edges of lattices that a worker keeps for units it meets again; beyond, it starts anew.
KEPT_EDGES = 3_000_000
_SEEN = U(46)
_models: dict = HELD.setdefault("segmentation", {})


class PieceTable:
    """Pieces by byte length; weights are probabilities by merge rank, to the ``power`` (1: as they are,
    towards 0: all segmentations alike)."""

    def __init__(self, path: str, power: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        raw, weight = [b""] * sp.vocab_size(), np.zeros(sp.vocab_size())
        self.by_byte = np.zeros(256, np.int64)
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[1:-1], 16)
                raw[i], self.by_byte[b] = bytes([b]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw[i], weight[i] = sp.id_to_piece(i).replace("▁", " ").encode(), 1 / (1000.0 - sp.get_score(i))
        prob = (weight / max(weight.sum(), 1e-300)) ** power
        prob[self.by_byte] = 1e-6
        self.log_prob = np.log(np.maximum(prob, 1e-300))
        self.size = np.array([len(r) for r in raw])
        self.offset = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.tables = {}
        normal = weight > 0
        self.joined = np.zeros((256, 256), bool)  # bytes that some piece has side by side
        self.longest = int(self.size[normal].max(initial=0))
        self.begins = np.zeros((self.longest + 1, 1 << 64 - int(_SEEN)), bool)  # by hash: may a piece of more than k bytes begin so
        for k in np.unique(self.size[normal]).tolist():
            ids = np.flatnonzero(normal & (self.size == k))
            h = np.zeros(len(ids), np.uint64)
            for j in range(k):
                at = self.bytes[self.offset[ids] + j]
                h += _BYTE_VALUES[at] * powers(_BASE, k + 1)[j]
                if j:
                    self.joined[before, at] = True
                    self.begins[j, part >> _SEEN] = True
                before = at
                part = h.copy()
            order = np.argsort(h)
            seen = np.zeros(self.begins.shape[1], bool)
            seen[h >> _SEEN] = True
            self.tables[k] = (h[order], ids[order], seen)


def piece_table(path: str, power: float) -> PieceTable:
    if (path, power) not in _models:
        _models[path, power] = PieceTable(path, power)
    return _models[path, power]


def _units(model: PieceTable, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of units: document starts, and every place that no piece reaches over."""
    cut = np.ones(len(buf) + 1, bool)
    cut[1:-1] = ~model.joined[buf[:-1], buf[1:]]
    cut[off] = True
    return np.flatnonzero(cut[:-1])


class Lattices:
    """Lattices of distinct units, found by hash: for each state (unit, end) its edges with a ladder of
    state + cumulated probability, so that one search finds a draw's edge."""

    def __init__(self, model: PieceTable):
        self.model = model
        self.clear(0)

    def clear(self, salt: int) -> None:
        self.salt, self.n_edges, self.n_states = salt, 0, 0
        self.key, self.base = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ladder, self.edge_start, self.piece = np.empty(1 << 16), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.first, self.last = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def find(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The base state of every unit; lattices of new ones are built."""
        n = len(buf)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[buf] * powers(_BASE, n))])
        inverse = powers(_BASE_INV, n + 1)
        h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) + mix(np.full(1, U(self.salt))))
        new, at = np.unique(h, return_index=True)
        if self.n_edges > KEPT_EDGES:
            self.clear(self.salt)
        if len(self.key):
            spot = np.searchsorted(self.key, new)
            spot[spot == len(self.key)] = 0
            fresh = self.key[spot] != new
            new, at = new[fresh], at[fresh]
        if len(new):
            base = self._add(buf, total, inverse, start[at], (end - start)[at])
            spot = np.searchsorted(self.key, new)
            self.key, self.base = np.insert(self.key, spot, new), np.insert(self.base, spot, base)
        return self.base[np.searchsorted(self.key, h)]

    def _add(self, buf, total, inverse, us, ul) -> np.ndarray:
        model, nu = self.model, len(us)
        pos = np.arange(ul.sum()) - np.repeat(np.cumsum(ul) - ul, ul)
        unit = np.repeat(np.arange(nu), ul)
        eu, es, ee, ep = [unit], [pos], [pos + 1], [model.by_byte[buf[us[unit] + pos]]]
        left, live = ul[unit] - pos, np.arange(len(pos))
        for k in range(1, model.longest + 1):
            live = live[left[live] >= k]
            if not len(live):
                break
            at = us[unit[live]] + pos[live]
            h = (total[at + k] - total[at]) * inverse[at]
            if k in model.tables:
                table, ids, seen = model.tables[k]
                may = np.flatnonzero(seen[h >> _SEEN])
                spot = np.searchsorted(table, h[may])
                spot[spot == len(table)] = 0
                hit = table[spot] == h[may]
                got = live[may[hit]]
                eu.append(unit[got]), es.append(pos[got]), ee.append(pos[got] + k), ep.append(ids[spot[hit]])
            live = live[model.begins[k][h >> _SEEN]]  # only where a longer piece may begin so
        eu, es, ee, ep = (np.concatenate(x) for x in (eu, es, ee, ep))
        base = np.cumsum(ul + 1) - (ul + 1)  # states of a unit: its start, then each end
        order = _by(base[eu] + ee)  # edges of one state stay in order of their pieces' lengths
        es, ee, ep, eu = es[order], ee[order], ep[order], eu[order]
        state, came = base[eu] + ee, base[eu] + es
        mass = np.full(int((ul + 1).sum()), -np.inf)
        mass[base] = 0.0
        w = model.log_prob[ep]
        level = _by(ee)
        cut = np.concatenate([[0], np.cumsum(np.bincount(ee))])
        for e in range(1, len(cut) - 1):
            z = level[cut[e] : cut[e + 1]]
            v, to = w[z] + mass[came[z]], state[z]
            head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(v, head)
            size = np.diff(np.append(head, len(to)))
            mass[to[head]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, size)), head))
            w[z] = np.exp(v - np.repeat(mass[to[head]], size))
        head = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]]))
        last = np.append(head[1:], len(state)) - 1
        run = np.cumsum(w)
        within = run - np.repeat(np.concatenate([[0.0], run])[head], last - head + 1)
        n, m, k, q = self.n_edges, self.n_states, len(state), len(mass)
        self.ladder, self.edge_start, self.piece = (_room(x, n + k) for x in (self.ladder, self.edge_start, self.piece))
        self.first, self.last = (_room(x, m + q) for x in (self.first, self.last))
        self.ladder[n : n + k] = state + m + np.minimum(within, 1 - 1e-9)
        self.edge_start[n : n + k], self.piece[n : n + k] = es, ep
        self.first[m + state[head]], self.last[m + state[head]] = n + head, n + last
        self.n_edges, self.n_states = n + k, m + q
        return base + m


def _by(x: np.ndarray) -> np.ndarray:
    """A stable order by small whole numbers, 16 bits a pass."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, int(x.max()).bit_length() if len(x) else 0, 16):
        order = order[np.argsort((x[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a longer copy of it."""
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def _draw(found: Lattices, base: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One path of every unit, drawn from its end, all units at once."""
    live = np.argsort(base, kind="stable")  # equal units together: the ladder is read in order
    base, start, seed, now = base[live], start[live], seed[live], (end - start)[live]
    ids, step, ladder = np.full(n, -1, np.int32), 1, found.ladder[: found.n_edges]
    while len(now):
        state = base + now
        u = (mix(seed + U(step)) >> U(11)).astype(np.float64) * 2.0**-53
        edge = np.clip(np.searchsorted(ladder, state + u, "right"), found.first[state], found.last[state])
        now = found.edge_start[edge].astype(np.int64)
        ids[start + now] = found.piece[edge]
        go = now > 0
        base, start, seed, now, step = base[go], start[go], seed[go], now[go], step + 1
    at = np.flatnonzero(ids >= 0)
    return ids[at].astype(np.int64), at


def spelled(model: PieceTable, ids: np.ndarray) -> np.ndarray:
    """The bytes of pieces in order."""
    size = model.size[ids]
    end = np.cumsum(size)
    return model.bytes[np.repeat(model.offset[ids] - (end - size), size) + np.arange(size.sum())]


def sample(model: PieceTable, buf: np.ndarray, off: np.ndarray, key: np.ndarray, found: Lattices | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all documents in order, and the byte place of each piece."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = found or Lattices(model)
    start = _units(model, buf, off)
    end = np.append(start[1:], n)
    doc = np.searchsorted(off, start, "right") - 1
    seed = mix(key[doc] ^ mix((start - off[doc]).astype(np.uint64) + U(0x51)))
    while True:
        ids, at = _draw(found, found.find(buf, start, end), start, end, seed, n)
        if np.array_equal(spelled(model, ids), buf):
            return ids, at
        found.clear(found.salt + 1)  # two units had one hash: another hash


def _encode(path: str, power: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_table(path, power)
        found = Lattices(model)
        for big in batches:
            for b in chunks(big, limit=1_000_000):
                buf, off = bytes_of(b.column(1))
                key = mix(np.asarray(b.column(0).fill_null(0), dtype=np.int64).view(np.uint64) + U(1))
                ids, at = sample(model, buf, off, key, found)
                ptr = np.searchsorted(at, off)
                lists = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    return run


def _decode(path: str, power: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_table(path, power)
        for big in batches:
            lists = big.column(1)
            ptr = np.asarray(lists.offsets, dtype=np.int64)
            at = 0
            while at < len(big):
                to = max(at + 1, int(np.searchsorted(ptr, ptr[at] + 500_000, "right")) - 1)
                b = big.slice(at, to - at)
                at = to
                ids = np.asarray(b.column(1).flatten())
                cut = np.asarray(b.column(1).offsets, dtype=np.int64)
                cut = cut - cut[0]
                total = np.concatenate([[0], np.cumsum(model.size[ids])])
                raw = spelled(model, ids).tobytes()
                where = total[cut]
                texts = pa.array([raw[x:y] for x, y in zip(where[:-1], where[1:], strict=True)], pa.binary()).cast(pa.string())
                crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(cut)), pa.array(crc, pa.int64()), texts], ["doc_id", "n_pieces", "ids_crc32", "text"])

    return run


def encode_sampled(docs: DataFrame, *, model: str | None = None, power: float = 0.2) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids: one sampled segmentation, seeded by doc_id.

    ``model`` is a sentencepiece file with byte fallback.  The public file is a BPE one, which has merge
    ranks and no probabilities; a piece's probability falls with its rank and is raised to ``power``
    (the usual smoothing of sampled segmentations).  Null or empty text has no pieces.  Rows with
    equal doc_id and text get equal pieces, repeated rows one row each; a null doc_id counts as 0.
    Other columns are ignored.  A task holds one text at least, and some 300 bytes for each byte of
    the longest stretch that can't be cut.
    """
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(lean(_encode(model, power), "segmentation"), "doc_id long, ids array<int>")


def decode_pieces(ids: DataFrame, *, model: str | None = None) -> DataFrame:
    """(doc_id, ids) -> doc_id, n_pieces, ids_crc32, text: exactly the text that was encoded; empty or
    null ids give the empty text."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    return ids.select("doc_id", "ids").mapInArrow(lean(_decode(model, 1.0), "segmentation"), "doc_id long, n_pieces long, ids_crc32 long, text string")


def op7_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = decode_pieces(encode_sampled(docs))
    return out.select("doc_id", "n_pieces", "ids_crc32", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("decoded_sha256"))
