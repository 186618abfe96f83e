"""Language identification by a linear-chain conditional random field over words.

Each word is labelled with a language from affix, character n-gram and lexicon features (hashed into
a fixed table) and learned transitions; forward-backward gives posteriors, so code-switched texts
get labels that change inside a line.  A text is one chain, however long it is: it is worked on in
blocks of SPAN words that hand their forward and backward masses on, as matrices, to the next ones.
The document's language is the one with the largest summed posterior over words with letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import U, Words, chunks, lean, mix, words_of

SPAN, BUCKETS = 64, 1 << 17
LATIN, OTHER = np.zeros(256, bool), np.zeros(256, bool)
LATIN[65:91] = LATIN[97:123] = True
OTHER[128:] = True


def features(w: Words, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the words at ``at``: flat, with boundaries."""
    s, e = w.start[at], w.end[at]
    n = e - s
    buf = w.buf.astype(np.uint64) + U(1)
    who, val = [np.arange(len(at))], [mix(h[at] + U(1))]
    pre, suf = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(1, 5):
        ok = np.flatnonzero(n >= k)
        pre[ok] = pre[ok] * U(258) + buf[s[ok] + k - 1]
        suf[ok] = suf[ok] * U(258) + buf[e[ok] - k]
        who += [ok, ok]
        val += [mix(pre[ok] * U(8) + U(2)), mix(suf[ok] * U(8) + U(3))]
    m = np.maximum(n - 2, 0)
    owner = np.repeat(np.arange(len(at)), m)
    pos = np.repeat(s, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    tri = (buf[pos] * U(258) + buf[pos + 1]) * U(258) + buf[pos + 2] if len(pos) else np.empty(0, np.uint64)
    who.append(owner)
    val.append(mix(tri * U(8) + U(4)))
    who, val = np.concatenate(who), np.concatenate(val)
    order = np.argsort(who, kind="stable")
    return (val[order] % U(BUCKETS)).astype(np.int64), np.searchsorted(who[order], np.arange(len(at) + 1))


def has_letter(w: Words, at: np.ndarray) -> np.ndarray:
    """True for words at ``at`` with a letter (Unicode category L)."""
    s, e = w.start[at], w.end[at]
    latin, other = (np.cumsum(np.concatenate([[0], kind[w.buf]])) for kind in (LATIN, OTHER))
    out = latin[e] > latin[s]
    for i in np.flatnonzero(~out & (other[e] > other[s])):
        out[i] = any(c.isalpha() for c in w.buf[s[i] : e[i]].tobytes().decode())
    return out


def emissions(weights: np.ndarray, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label scores of each word, and whether it has a letter; computed once per distinct word of the chunk."""
    _, at, inv = np.unique(h, return_index=True, return_inverse=True)
    f, ptr = features(w, at, h)
    return np.add.reduceat(weights[f], ptr[:-1], axis=0)[inv], has_letter(w, at)[inv]


def posteriors(emit: np.ndarray, length: np.ndarray, trans: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences (sequences x steps x labels); expected transitions too, if asked to count.

    ``before`` and ``after`` are the masses that a neighbouring block hands on: what the first
    word's scores, or the last word's forward mass, are multiplied by.
    """
    n, steps, labels = emit.shape
    t = np.exp(trans - trans.max())
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    live = np.arange(steps)[None, :] < length[:, None]
    e[~live] = 1.0
    a = np.empty_like(e)
    x = e[:, 0] if before is None else e[:, 0] * before
    a[:, 0] = x / x.sum(1, keepdims=True)
    for i in range(1, steps):
        x = (a[:, i - 1] @ t) * e[:, i]
        a[:, i] = x / x.sum(1, keepdims=True)
    b = np.ones((n, labels), emit.dtype) if after is None else after.astype(emit.dtype)
    post = np.empty_like(e)
    pairs = np.zeros((labels, labels))
    for i in range(steps - 1, -1, -1):
        x = a[:, i] * b
        post[:, i] = x / x.sum(1, keepdims=True)
        if i:
            eb = e[:, i] * b
            on = live[:, i]
            if count:
                z = np.einsum("ni,ij,nj->n", a[:, i - 1], t, eb)
                pairs += t * ((a[on, i - 1] / z[on, None]).T @ eb[on])
            late, b = b, eb @ t.T  # past the end the mass stays what it is
            b = np.where(on[:, None], b / b.sum(1, keepdims=True), late)
    return post, pairs


def chain_posteriors(emit: np.ndarray, ptr: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posteriors of all words of all documents (words x labels), each document one chain.

    The product of a block's transition and emission matrices carries forward mass over it; a pass over
    the blocks of all documents at once gives the masses at their borders, and each block is then
    worked on alone.
    """
    start, length = spans(ptr)
    post = np.empty_like(emit)
    if not len(start):
        return post
    L = emit.shape[1]
    doc_blocks = -(-np.diff(ptr) // SPAN)
    rank = np.arange(len(start)) - np.repeat(np.cumsum(doc_blocks) - doc_blocks, doc_blocks)  # place in its document
    t = np.exp(trans - trans.max()).astype(emit.dtype)
    before, after = np.ones((len(start), L), emit.dtype), np.ones((len(start), L), emit.dtype)
    inner = np.flatnonzero(np.repeat(doc_blocks > 1, doc_blocks))
    if len(inner):
        over = np.empty((len(start), L, L), emit.dtype)  # (label before the block, label of its last word)
        for part in np.array_split(inner, -(-len(inner) // 4000)):
            e = np.exp(emit[padded(start[part], length[part])])
            e /= e.max(axis=2, keepdims=True)
            m = t[None] * e[:, 0][:, None, :]
            for i in range(1, e.shape[1]):
                x = (m @ t) * e[:, i][:, None, :]
                x /= x.max(axis=(1, 2), keepdims=True)
                m = np.where((i < length[part])[:, None, None], x, m)
            over[part] = m
        first = inner[rank[inner] == 0]
        one, _ = _forward(emit, start[first], length[first], t)
        mass = np.ones((len(start), L), emit.dtype)
        mass[first] = one
        for k in range(1, int(rank.max()) + 1):
            here = np.flatnonzero(rank == k)
            before[here] = mass[here - 1] @ t
            x = np.einsum("ni,nij->nj", mass[here - 1], over[here])
            mass[here] = x / x.sum(1, keepdims=True)
        for k in range(int(rank.max()), 0, -1):
            here = np.flatnonzero(rank == k)
            x = np.einsum("nij,nj->ni", over[here], after[here])
            after[here - 1] = x / x.sum(1, keepdims=True)
    order = np.argsort(length)
    for part in np.array_split(order, max(1, len(order) // 4000)):
        s, n = start[part], length[part]
        grid = padded(s, n)
        p, _ = posteriors(emit[grid], n, trans, before[part], after[part], count=False)
        live = np.arange(grid.shape[1])[None, :] < n[:, None]
        post[grid[live]] = p[live]
    return post


def _forward(emit: np.ndarray, start: np.ndarray, length: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward mass of the last word of blocks that begin a document."""
    e = np.exp(emit[padded(start, length)])
    e /= e.max(axis=2, keepdims=True)
    a = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, e.shape[1]):
        x = (a @ t) * e[:, i]
        a = np.where((i < length)[:, None], x / x.sum(1, keepdims=True), a)
    return a, length


def spans(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the sequences of all documents."""
    n = np.diff(ptr)
    k = -(-n // SPAN)
    start = np.repeat(ptr[:-1], k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)) * SPAN
    return start, np.minimum(SPAN, np.repeat(ptr[1:], k) - start)


def padded(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(int(length.max()) if len(length) else 1)[None, :]
    return np.minimum(at, (start + length - 1)[:, None])


def train_crf(texts: list[str], langs: list[str], *, epochs: int = 8, seed: int = 3) -> dict:
    """AdaGrad on the conditional likelihood; one sequence in three switches language half-way."""
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs], np.int64)
    L = len(names)
    rng = np.random.default_rng(seed)
    w = words_of(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), lower=True)
    h = w.hashes()
    _, at, inv = np.unique(h, return_index=True, return_inverse=True)
    f, ptr = features(w, at, h) if len(at) else (np.empty(0, np.int64), np.zeros(1, np.int64))
    weights, trans = np.zeros((BUCKETS, L)), np.zeros((L, L))
    gw, gt = np.full((BUCKETS, L), 1e-2), np.full((L, L), 1e-2)
    start, length = spans(w.ptr)
    if not len(start):
        return {"names": names, "weights": weights.astype(np.float32), "trans": trans}
    grid, owner = padded(start, length), label[w.doc[start]]
    reps = np.diff(ptr)
    for _ in range(epochs):
        order = rng.permutation(len(start))
        for i in range(0, len(order), 512):
            o = order[i : i + 512]
            g, n = grid[o].copy(), length[o]
            y = np.repeat(owner[o][:, None], g.shape[1], axis=1)
            mate = rng.permutation(len(o))
            for r in range(0, len(o), 3):
                c = int(min(n[r], n[mate[r]]) * rng.uniform(0.2, 0.8))
                if c:
                    g[r, :c], y[r, :c] = grid[o[mate[r]], :c], owner[o[mate[r]]]
            word = inv[g]
            need, back = np.unique(word, return_inverse=True)
            fa = np.concatenate([f[ptr[u] : ptr[u + 1]] for u in need])
            cut = np.concatenate([[0], np.cumsum(reps[need])])
            score = np.add.reduceat(weights[fa], cut[:-1], axis=0)
            emit = score[back.reshape(word.shape)]
            post, pairs = posteriors(emit, n, trans)
            live = np.arange(g.shape[1])[None, :] < n[:, None]
            d = post.copy()
            np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
            d[~live] = 0
            flat = back.reshape(-1)
            per_word = np.stack([np.bincount(flat, d[:, :, c].reshape(-1), len(need)) for c in range(L)], 1) / len(o)
            step = np.repeat(per_word, np.diff(cut), axis=0)
            uf, ub = np.unique(fa, return_inverse=True)
            gr = np.stack([np.bincount(ub, step[:, c], len(uf)) for c in range(L)], 1) + 1e-5 * weights[uf]
            gw[uf] += gr**2
            weights[uf] -= 0.3 * gr / np.sqrt(gw[uf])
            seen = np.zeros((L, L))
            on = live[:, 1:]
            np.add.at(seen, (y[:, :-1][on], y[:, 1:][on]), 1)
            dt = (pairs - seen) / len(o) + 1e-3 * trans
            gt += dt**2
            trans -= 0.3 * dt / np.sqrt(gt)
    return {"names": names, "weights": weights.astype(np.float32), "trans": trans}


def _label(model: dict):
    names, weights, trans = np.array([*model["names"], "und"], object), model["weights"], model["trans"].astype(np.float32)
    L = len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, limit=600_000):
                w = words_of(b, lower=True)
                total = np.zeros((len(b), max(L, 1)))
                if L and len(w.start):
                    emit, letter = emissions(weights, w, w.hashes())
                    post = chain_posteriors(emit, w.ptr, trans) * letter[:, None]
                    for c in range(L):
                        total[:, c] = np.bincount(w.doc, post[:, c], len(b))
                mass = total.sum(1)
                best = np.where(mass > 0, total.argmax(1), L)
                score = np.where(best < L, total.max(1) / np.maximum(mass, 1e-12), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(names[best]), pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])

    return run


def fit_languages(spark: SparkSession, labelled: DataFrame, *, per_language: int = 600, words: int = 256) -> dict:
    """A CRF from labelled (doc_id, text, lang), on a bounded sample: about ``per_language``
    documents of each language, taken by hash of doc_id, and of each one stretch of ``words`` words
    at a hashed place, as the driver holds the sample.  Every lang value is learnt; the weights
    take BUCKETS floats for each.  Null langs, null texts and texts without words don't count;
    repeated rows count as often as they come, other columns are ignored.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.length("text")).alias("order"))
    counts = [(r.lang, r.n) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]  # one row a language
    if not counts:
        return {"names": [], "weights": np.zeros((BUCKETS, 0), np.float32), "trans": np.zeros((0, 0))}
    top = (1 << 30) - 1
    share = spark.createDataFrame([(lang, int(min(1.0, 1.5 * per_language / n) * top)) for lang, n in counts], "lang string, top long")
    chosen = rows.join(F.broadcast(share), "lang").where(F.pmod("order", F.lit(1 << 30)) <= F.col("top")).select("lang", "text", "order")

    def stretch(batches):
        for b in batches:
            out = []
            for text, order in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = text.encode().split()
                at = order % max(1, len(w) - words + 1)
                out.append(b" ".join(w[at : at + words]).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(2)], ["lang", "text", "order"])

    sample = chosen.mapInArrow(stretch, "lang string, text string, order long").orderBy("order", "lang").limit(2 * per_language * len(counts)).toPandas().sort_values(["order", "lang", "text"], kind="stable")
    return train_crf(sample["text"].tolist(), sample["lang"].tolist())


def identify(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score (the share of the posterior mass).

    ``und`` with score 0 where text is null or has no letter (Unicode category L), or where nothing
    was learnt.  Repeated rows get equal labels, ties go to the first language by name, an empty
    table gives no rows; other columns are ignored.  A task holds one text at least, and some
    hundred bytes a word and language."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(_label(model)), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that have a language; those that come out as ``und`` go.  Each row is judged by
    its own text, whatever its doc_id, so that null and repeated ids take nothing from each other;
    its columns, whatever their names, stay as they are."""
    place = docs.columns.index("text")
    label = _label(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, limit=600_000):
                text = b.column(place).cast(pa.string())
                for got in label(iter([pa.RecordBatch.from_arrays([text, text], ["doc_id", "text"])])):
                    stay = [x != "und" for x in got.column(1).to_pylist()]
                    yield b.slice(0, len(got)).filter(pa.array(stay, pa.bool_()))
                    b = b.slice(len(got))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(docs_id="doc_id"):
    return F.coalesce(F.crc32(F.col(docs_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(spark, docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(spark, docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
