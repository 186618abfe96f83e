"""A log-bilinear neural language model over word classes, trained with noise-contrastive estimation.

P(word | two words before) = P(class | classes before) * P(word | class).  Frequent words are
classes of their own, the rest falls into classes by word ending.  The class model predicts a vector
from the two context vectors and scores every class by a dot product; one batched matrix product
over all contexts gives normalised log-probabilities, so scoring a token is a table look-up.
Within a class words follow their add-one counts.  All counts come from the whole training part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import U, Words, chunks, doc_hash, mix, words_of

CLASSES, ENDINGS, HEAD = 128, 48, 65536
END = 1  # hash value that stands for the end token; class 0
_MERGE = 1_000_000


def endings(w: Words) -> np.ndarray:
    """Class by the last two bytes of each word, 0 .. ENDINGS - 1."""
    last = w.buf[w.end - 1].astype(np.uint64)
    other = np.where(w.end - w.start > 1, w.buf[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    return (mix(last * U(257) + other + U(1)) % U(ENDINGS)).astype(np.int16)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, docs = [], 0

    def merged():
        h, c, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        h, c, e = h[order], c[order], e[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[at], np.add.reduceat(c, at), e[at]

    def out(h, c, e):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(e.astype(np.int16))], ["h", "c", "ending"])

    for big in batches:
        for b in chunks(big):
            w = words_of(b, lower=True)
            docs += len(b)
            if len(w.start):
                h, at, c = np.unique(w.hashes(), return_index=True, return_counts=True)
                parts.append((h, c, endings(w)[at]))
            if sum(len(p[0]) for p in parts) > _MERGE:
                parts = [merged()]
                if len(parts[0][0]) > _MERGE // 2:
                    yield out(*parts.pop())
    if parts:
        yield out(*merged())
    if docs:
        yield out(np.array([END], np.uint64), np.array([docs]), np.array([-1]))


class Vocabulary:
    """The HEAD most frequent words with counts and classes, sorted by hash (a fixed bound)."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        own = {int(x): i + 1 for i, x in enumerate([x for x in h if int(x) != END][: CLASSES - ENDINGS - 1])}
        cls = np.array([0 if int(x) == END else own.get(int(x), -1) for x in h], np.int16)
        order = np.argsort(h)
        self.h, self.c, self.cls = h[order], c[order], cls[order]
        self.own = len(own) + 1

    def look(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and its place in the head or -1."""
        if not len(self.h):
            return CLASSES - ENDINGS + endings(w), np.full(len(h), -1)
        at = np.searchsorted(self.h, h)
        at[at == len(self.h)] = 0
        hit = self.h[at] == h
        cls = np.where(hit & (self.cls[at] >= 0), self.cls[at], CLASSES - ENDINGS + endings(w))
        return cls, np.where(hit, at, -1)


def _contexts(w: Words, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents as class sequences, each closed by class 0: token classes, two before, word spots."""
    nd = len(w.ptr) - 1
    spot = np.arange(len(cls)) + w.doc
    ends = w.ptr[1:] + np.arange(nd)
    seq = np.zeros(len(cls) + nd, np.int64)
    seq[spot] = cls
    first = w.ptr[:-1] + np.arange(nd)
    one = np.concatenate([[0], seq[:-1]])[: len(seq)]
    two = np.concatenate([[0, 0], seq[:-2]])[: len(seq)]
    one[first] = 0
    two[first] = 0
    two[first[first < ends] + 1] = 0
    return seq, one, two, ends


def _triples(vocab: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for big in batches:
            for b in chunks(big):
                w = words_of(b, lower=True)
                cls, _ = vocab.look(w, w.hashes())
                seq, one, two, _ = _contexts(w, cls)
                code, n = np.unique((two * CLASSES + one) * CLASSES + seq, return_counts=True)
                total[code] += n
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], ["code", "n"])

    return run


def draws(n: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Every cell in turn, frequent ones several times, in random order; weights make up for the counts."""
    share = n.sum() / (2 * len(n))
    times = np.ceil(n / share).astype(np.int64)
    order = rng.permutation(np.repeat(np.arange(len(n)), times))
    return order, (n / (times * share))[order]


def train_classes(code: np.ndarray, n: np.ndarray, *, dim: int = 32, batch: int = 2048, noise: int = 16, least: int = 200, seed: int = 5) -> np.ndarray:
    """NCE on weighted class trigrams -> normalised natural log-probabilities [two * C + one, class].

    Training goes through all counted trigrams, so its steps grow with what the corpus has of them (and is
    repeated until ``least`` steps where that is little).
    """
    rng = np.random.default_rng(seed)
    two, one, now = code // (CLASSES * CLASSES), code // CLASSES % CLASSES, code % CLASSES
    uni = np.bincount(now, n, CLASSES) + 0.5
    uni /= uni.sum()
    p = {"r": rng.normal(0, 0.1, (CLASSES, dim)), "q": rng.normal(0, 0.1, (CLASSES, dim)), "a": np.ones(dim), "b": np.full(dim, 0.5), "bias": np.log(uni)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    if len(code):
        row, eye = np.arange(batch)[:, None] * CLASSES, np.eye(CLASSES)
        cum_uni = np.cumsum(uni)
        order, weight = draws(n, rng)
        more = -(-least * batch // len(order))
        order, weight = np.tile(order, more), np.tile(weight, more)
        steps = -(-len(order) // batch)
        order, weight = np.resize(order, steps * batch), np.resize(weight, steps * batch)
        for t in range(1, steps + 1):
            at, wt = order[(t - 1) * batch : t * batch], weight[(t - 1) * batch : t * batch]
            bad = np.minimum(np.searchsorted(cum_uni, rng.random((batch, noise))), CLASSES - 1)
            word = np.concatenate([now[at][:, None], bad], 1)
            r1, r2 = p["r"][one[at]], p["r"][two[at]]
            hat = r1 * p["a"] + r2 * p["b"]
            z = np.take_along_axis(hat @ p["q"].T + p["bias"] - np.log(noise * uni), word, 1)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g[:, 0] -= 1
            g *= wt[:, None]
            dense = np.bincount((row + word).ravel(), g.ravel() / batch, batch * CLASSES).reshape(batch, CLASSES)
            dhat = dense @ p["q"]
            grad = {"q": dense.T @ hat, "bias": dense.sum(0), "r": eye[:, one[at]] @ (dhat * p["a"]) + eye[:, two[at]] @ (dhat * p["b"]), "a": (dhat * r1).sum(0), "b": (dhat * r2).sum(0)}
            rate = 0.03 * (1 - t / (steps + 1)) + 0.001
            for k in p:
                m[k] += 0.1 * (grad[k] - m[k])
                v[k] += 0.01 * (grad[k] ** 2 - v[k])
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
    hat = (p["r"] * p["b"])[:, None, :] + (p["r"] * p["a"])[None, :, :]
    logits = hat.reshape(-1, dim) @ p["q"].T + p["bias"]
    top = logits.max(axis=1, keepdims=True)
    return (logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))).astype(np.float32)


def _score(vocab: Vocabulary, table: np.ndarray, log_z: np.ndarray, log_all: float, n_ends: int):
    log_table, log_c = (table / np.log(10)).astype(np.float32), np.log10(vocab.c + 1.0)
    end_log = np.log10(n_ends + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big):
                w = words_of(b, lower=True)
                h, nd = w.hashes(), len(b)
                cls, at = vocab.look(w, h)
                seq, one, two, ends = _contexts(w, cls)
                first = w.ptr[:-1] + np.arange(nd)
                model = np.add.reduceat(log_table[two * CLASSES + one, seq].astype(float), first) if nd else np.zeros(0)
                known = at >= 0
                lc = np.where(known, log_c[at] if len(log_c) else 0.0, 0.0)
                shared = cls >= CLASSES - ENDINGS
                inside = np.where(shared, lc - log_z[np.maximum(cls - (CLASSES - ENDINGS), 0)], 0.0)
                n = np.diff(w.ptr)
                base = np.bincount(w.doc, lc, nd) + end_log - (n + 1) * log_all
                model = model + np.bincount(w.doc, inside, nd)
                n_known = np.bincount(w.doc, known, nd).astype(np.int64) + int(n_ends > 0)
                version = doc_hash(h, w.ptr)
                rare = np.flatnonzero(~known)
                mark = mix(h[rare] ^ mix(w.doc[rare].astype(np.uint64)))
                _, pick, times = np.unique(mark, return_index=True, return_counts=True)
                pick = rare[pick]
                doc = np.concatenate([np.arange(nd), w.doc[pick]])
                pad = lambda x, kind: pa.array(np.concatenate([x, np.zeros(len(pick), kind)]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc)), pa.array(version.view(np.int64)[doc]), pa.array(np.concatenate([mix(version ^ U(77)), h[pick]]).view(np.int64)), pa.array(np.concatenate([np.zeros(nd, np.int64), times])), pad(np.ones(nd, np.int64), np.int64), pad(n + 1, np.int64), pad(n_known, np.int64), pad(base, float), pad(model, float)],
                    ["doc_id", "version", "h", "times", "docs", "n_tokens", "n_known", "base", "model"],
                )

    return run


def score_documents(spark: SparkSession, docs: DataFrame, train: DataFrame) -> DataFrame:
    """docs (doc_id, text) scored by a model learnt from train (doc_id, text).

    Per row: doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (the
    model), both log10 probabilities.  Words are lower-cased (A-Z) and split at ASCII white space;
    each document closes with one end token.  Null or empty text is the end token alone.  Rows
    that share doc_id and words each get their own row.  Without training rows all counts are 0
    and both scores stay finite.  The one join is on words outside the HEAD most frequent, counted
    per document first, so that no word is a hot key.  An empty table gives no rows; very long texts are read
    in one task, some 100 bytes for each of theirs; other columns are ignored, whatever their names.
    """
    s = Scratch(spark, "lm")
    pick = lambda d: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, train = pick(docs), pick(train)
    counts = s.put(train.mapInArrow(_word_counts, "h long, c long, ending short").groupBy("h").agg(F.sum("c").alias("c"), F.first("ending").alias("ending")))
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("h") == END, F.col("c"))), F.lit(0))).first()
    head = counts.orderBy(F.desc("c"), "h").limit(HEAD).select("h", "c").toArrow()
    vocab = Vocabulary(head["h"].to_numpy().view(np.uint64), head["c"].to_numpy())
    own = vocab.h[vocab.cls >= 0].view(np.int64).tolist()
    sizes = counts.where(~F.col("h").isin(own)).groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    mass = np.ones(ENDINGS)
    for r in sizes:
        if r.ending >= 0:
            mass[r.ending] += r.c + r.n
    grams = train.mapInArrow(_triples(vocab), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most CLASSES ** 3 rows, as columns
    grams = grams.sort_by("code")
    table = train_classes(grams["code"].to_numpy().astype(np.int64), grams["n"].to_numpy())
    del head, grams
    parts = docs.mapInArrow(
        _score(vocab, table, np.log10(mass), float(np.log10(total + distinct + 1)), int(ends)),
        "doc_id long, version long, h long, times long, docs long, n_tokens long, n_known long, base double, model double",
    )
    c = F.coalesce(F.when(F.col("times") > 0, F.col("c")), F.lit(0))
    extra = F.col("times") * F.log10(c + F.lit(1.0))
    both = parts.join(counts.select("h", "c"), "h", "left").groupBy("doc_id", "version").agg(
        F.sum("docs").alias("k"), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_known") + F.sum(F.when(c > 0, F.col("times")).otherwise(0))).alias("n_known"), (F.sum("base") + F.sum(extra)).alias("base"), (F.sum("model") + F.sum(extra)).alias("model")
    )
    k = F.col("k")
    return both.select("doc_id", F.expr("n_tokens div k").alias("n_tokens"), F.expr("n_known div k").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") / k).alias("base_score"), (F.col("model") / k).alias("score"), F.explode(F.sequence(F.lit(1), k)).alias("_copy")).drop("_copy")


def op2_logbilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    out = score_documents(spark, docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
