"""Incremental removal of repeated passages with a log-structured index of window fingerprints.

A window is ``window`` consecutive words.  The index holds sampled fingerprints only: hashes of ``gram``
words that are least in some window (minimizers, about one word in seven).  Equal windows have equal
minimizers, so every repeated window shows up as a fingerprint that two documents hold.

Each batch becomes one immutable run: fingerprints bucketed and sorted by hash, so that later batches
merge-join it without moving it.  Windows around shared fingerprints are verified by 128 bits of two
independent hashes over all their words.  Texts are kept bucketed by row, so that they move once.
Once ``fanout`` runs of one level exist they are compacted into one of the next level.  A versioned
manifest lists the live runs and text batches; an index with a path can be opened again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .manifest import Manifest
from .scratch import Scratch, hadoop_path
from .text import SPACE, Words, bytes_of, chunks, lean, mix, ngrams, ragged, rolling, words_of

WINDOW, GRAM = 20, 8
#: The key of a null doc_id: before all others.
LOW = -(1 << 63)
#: Bytes of text that are looked at together for repeats among themselves.
CHUNK = 3_000_000


def _slide(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over n neighbours from each position, by doubling."""
    have = 1
    while have * 2 <= n:
        a = f(a[:-have], a[have:])
        have *= 2
    return f(a[: len(a) - (n - have)], a[n - have :]) if n > have else a


def minimizers(w: Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of whole windows and the least gram hash in each."""
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _slide(ngrams(h, gram, 11), window - gram + 1, np.minimum)
    at = np.flatnonzero(w.left()[: len(least)] >= window)
    return at, least[at]


def repeated(p: np.ndarray, q: np.ndarray, rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where window (p, q) is held by a document of lower rank too, or came earlier in its own."""
    order = np.argsort(p)
    same = p[order[1:]] == p[order[:-1]]
    many = np.zeros(len(p), bool)
    many[1:] |= same
    many[:-1] |= same
    sub = np.sort(order[many])
    o = sub[np.lexsort((doc[sub], rank[sub], q[sub], p[sub]))]  # stable: positions stay in order
    out = np.zeros(len(p), bool)
    if len(o):
        new = np.ones(len(o), bool)
        new[1:] = (p[o[1:]] != p[o[:-1]]) | (q[o[1:]] != q[o[:-1]])
        head = np.flatnonzero(new)
        lowest = np.repeat(rank[o[head]], np.diff(np.append(head, len(o))))
        out[o] = rank[o] > lowest
        inside = o[1:][~new[1:] & (doc[o[1:]] == doc[o[:-1]])]
        out[inside] = True
    return out


def _ranges(at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring starts as (document, first start, how many)."""
    head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0)])) if len(at) else np.empty(0, np.int64)
    return doc[head], at[head], np.diff(np.append(head, len(at)))


def _by_doc(doc: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list a document from values in order of documents."""
    return ragged(values, np.searchsorted(doc, np.arange(n + 1)), pa.int64())


def _read(b: pa.RecordBatch, window: int, gram: int):
    """Words of a chunk, its windows' starts, minimizers and two hashes, and their documents."""
    w = words_of(b)
    h = w.hashes()
    at, least = minimizers(w, h, window, gram)
    return w, at, least, rolling(h, window)[at], rolling(w.hashes(second=True), window, True)[at], w.doc[at]


def _fingerprints(window: int, gram: int):
    """(rid, key, text) -> rid, key, fps, spots: what repeats inside a chunk is decided there (spots:
    starts and counts of windows), the fingerprints of all other windows go to the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, limit=CHUNK):
                w, at, least, p, q, doc = _read(b, window, gram)
                again = repeated(p, q, np.asarray(b.column(1))[doc], doc)
                d, start, count = _ranges(at[again], doc[again])
                spots = np.stack([start - w.ptr[d], count], 1).reshape(-1)
                doc, least = doc[~again], least[~again]
                change = np.ones(len(doc), bool)
                change[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                doc, least = doc[change], least[change]
                order = np.lexsort((least, doc))
                doc, least = doc[order], least[order]
                new = np.ones(len(doc), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _by_doc(doc[new], least[new], len(b)), _by_doc(np.repeat(d, 2), spots, len(b))], ["rid", "key", "fps", "spots"])

    return run


def _candidates(window: int, gram: int):
    """(rid, key, text, shared, new) -> windows around shared fingerprints.  n is 0 for a window that is still
    open; repeats inside a chunk come as ranges of n windows from pos, which are decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, limit=CHUNK):
                w, at, least, p, q, doc = _read(b, window, gram)
                lists = b.column(3)
                ptr = np.asarray(lists.offsets, dtype=np.int64)
                owner = np.repeat(np.arange(len(b)), np.diff(ptr))
                flat = np.asarray(lists.flatten()).view(np.uint64)
                hit = _pairs_in(doc, least, owner, flat)
                at, p, q, doc = at[hit], p[hit], q[hit], doc[hit]
                key, new = np.asarray(b.column(1)), np.asarray(b.column(4)).astype(bool)
                order = np.lexsort((key, new))
                step = np.concatenate([[0], np.cumsum((np.diff(key[order]) != 0) | (np.diff(new[order].astype(np.int8)) != 0))])
                rank = np.empty(len(b), np.int64)
                rank[order] = step
                again = repeated(p, q, rank[doc], doc)
                known = again & new[doc]
                d, start, count = _ranges(at[known], doc[known])
                lone = mix(start.astype(np.uint64) ^ mix(np.asarray(b.column(0)).view(np.uint64)[d]))  # keys that nothing shares
                p, q, at, doc = p[~again], q[~again], at[~again], doc[~again]
                p, q = np.concatenate([p, lone]), np.concatenate([q, np.zeros(len(lone), np.uint64)])
                at, count, doc = np.concatenate([at, start]), np.concatenate([np.zeros(len(at), np.int64), count]), np.concatenate([doc, d])
                for i in range(0, len(at), 100_000):
                    z = slice(i, i + 100_000)
                    rows = pa.array(doc[z])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p[z].view(np.int64)), pa.array(q[z].view(np.int64)), b.column(4).take(rows), b.column(1).take(rows), b.column(0).take(rows), pa.array((at[z] - w.ptr[doc[z]]).astype(np.int32)), pa.array(count[z].astype(np.int32))],
                        ["p", "q", "new", "key", "rid", "pos", "n"],
                    )

    return run


def _pairs_in(doc: np.ndarray, value: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """True where (doc, value) is among (owner, wanted)."""
    out = np.zeros(len(doc), bool)
    order = np.lexsort((wanted, owner))
    owner, wanted = owner[order], wanted[order]
    known = np.unique(wanted)
    if not len(known):
        return out
    spot = np.searchsorted(known, value)
    spot[spot == len(known)] = 0
    may = np.flatnonzero(known[spot] == value)
    have = owner * len(known) + np.searchsorted(known, wanted)
    ask = doc[may] * len(known) + spot[may]
    at = np.searchsorted(have, ask)
    at[at == len(have)] = 0
    out[may] = have[at] == ask
    return out


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, limit=1_000_000):
                yield _removed(b, window)

    return run


def _removed(b: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """(key, text, spots, ...) with the words of all windows at ``spots`` cut out."""
    w = words_of(b)
    total = len(w.start)
    lists = b.column(2)
    ptr = np.asarray(lists.offsets, dtype=np.int64)
    pairs = np.asarray(lists.flatten(), dtype=np.int64).reshape(-1, 2)
    first = pairs[:, 0] + np.repeat(w.ptr[:-1], np.diff(ptr) // 2)
    gone = np.zeros(total + 1, np.int64)  # +1 where a covered stretch begins, -1 after it
    np.add.at(gone, first, 1)
    np.add.at(gone, first + pairs[:, 1] - 1 + window, -1)
    cover = np.cumsum(gone[:total]) > 0
    n = np.diff(w.ptr)
    lost = np.concatenate([[0], np.cumsum(cover)])
    lost = lost[w.ptr[1:]] - lost[w.ptr[:-1]]
    # Kept words joined by one space: mark the bytes to keep, with one space before each word.
    mark = np.zeros(len(w.buf) + 1, np.int8)
    mark[w.start[~cover]] += 1
    mark[w.end[~cover]] -= 1
    keep = np.cumsum(mark[:-1]).astype(bool)
    texts, sums = [], []
    _, off = bytes_of(b.column(1))
    for d in range(len(n)):
        raw = w.buf[off[d] : off[d + 1]]
        if lost[d]:
            k = keep[off[d] : off[d + 1]].copy()
            s = w.start[w.ptr[d] : w.ptr[d + 1]][~cover[w.ptr[d] : w.ptr[d + 1]]] - off[d]
            k[s[1:] - 1] = True  # at least one space byte lies before every word but the first
            kept = np.where(SPACE[raw], np.uint8(0x20), raw)[k].tobytes()
            texts.append(kept)
        else:
            kept = b" ".join(raw.tobytes().split())
            texts.append(None)
        sums.append(hashlib.sha256(kept).hexdigest())
    out = [b.column(0), pa.array(n), pa.array(lost), pa.array(sums), pa.array(texts, pa.binary()).cast(pa.string()), *b.columns[3:]]
    return pa.RecordBatch.from_arrays(out, ["key", "n_words", "n_removed", "kept_sha256", "kept_text", *b.schema.names[3:]])


class FingerprintIndex:
    """Bucketed runs of (fp, rid) and bucketed texts (rid, key, text, rest) under ``path``.

    ``rid`` is a hash of a row's key and text; it is never trusted without the key.  ``buckets`` (by default the
    session's number of shuffle partitions) is fixed when the index is made.  One writer at a time.
    """

    LISTED = "version long, kind string, name string, level int, buckets int"

    def __init__(self, spark: SparkSession, path: str | None = None, *, window: int = WINDOW, gram: int = GRAM, fanout: int = 4):
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.scratch = Scratch(spark, "substrings")
        self.path = path or f"{self.scratch.root}/index"
        self.manifest = Manifest(spark, f"{self.path}/manifest", self.LISTED)
        self.version = self.manifest.version()
        self.listed = self.manifest.rows()
        self.buckets = self.listed[0]["buckets"] if self.listed else int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: dict[str, str] = {}

    def _run(self, name: str) -> DataFrame:
        return self._open(f"{self.path}/runs/{name}", "fp BIGINT, rid BIGINT", "CLUSTERED BY (fp) SORTED BY (fp)")

    def _open(self, path: str, columns: str, how: str) -> DataFrame:
        """A bucketed table at ``path``, known to this session under a name of its own."""
        if path not in self._tables:
            self._tables[path] = f"proselake_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self._tables[path]} ({columns}) USING parquet {how} INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(self._tables[path])

    def _write_run(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        self._bucketed(rows.repartition(self.buckets, "fp"), f"{self.path}/runs/{name}")
        return name

    def _bucketed(self, rows: DataFrame, path: str) -> DataFrame:
        """rows, already dealt by fp, as a bucketed and sorted table."""
        self._tables[path] = f"proselake_{uuid.uuid4().hex}"
        rows.sortWithinPartitions("fp").write.format("parquet").bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).saveAsTable(self._tables[path])
        self.scratch.sweep()
        return self.spark.table(self._tables[path])

    def levels(self) -> list[list[str]]:
        out: list[list[str]] = []
        for r in self.listed:
            if r["kind"] == "run":
                out += [[] for _ in range(r["level"] + 1 - len(out))]
                out[r["level"]].append(r["name"])
        return out

    def texts(self, batches: list[int] | None = None) -> DataFrame:
        """Rows of the committed batches, or of some."""
        batches = [int(r["name"]) for r in self.listed if r["kind"] == "texts"] if batches is None else batches
        path = f"{self.path}/texts"
        return self.spark.table(self._tables[path]).where(F.col("batch").isin(batches))

    def _keep_texts(self, docs: DataFrame, batch: int) -> None:
        path = f"{self.path}/texts"
        if path not in self._tables and any(r["kind"] == "texts" for r in self.listed):
            rest = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields]
            self._open(path, ", ".join([*rest, "batch INT"]), "PARTITIONED BY (batch) CLUSTERED BY (rid)")
            self.spark.catalog.recoverPartitions(self._tables[path])
        name = self._tables.setdefault(path, f"proselake_{uuid.uuid4().hex}")
        rows = docs.withColumn("batch", F.lit(batch)).repartition(self.buckets, "rid")
        rows.write.format("parquet").mode("append").partitionBy("batch").bucketBy(self.buckets, "rid").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.scratch.sweep()

    def ingest(self, docs: DataFrame) -> DataFrame:
        """docs (rid, key, text, further columns) -> (rid, key, spots): starts and counts of windows met before.

        "Before" is an earlier batch, a smaller key of this one, or an earlier place of the same row.
        """
        s, batch = self.scratch, 1 + max((int(r["name"]) for r in self.listed if r["kind"] == "texts"), default=0)
        self._keep_texts(docs, batch)
        prints = self.texts([batch]).select("rid", "key", "text").mapInArrow(lean(_fingerprints(self.window, self.gram)), "rid long, key long, fps array<long>, spots array<long>")
        prints = s.put(prints.where("size(fps) + size(spots) > 0"))
        name = self._write_run(prints.select(F.explode("fps").alias("fp"), "rid"))
        new, older = self._run(name), [self._run(r) for level in self.levels() for r in level]
        shared, met = new.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "n > 1"
        for i, r in enumerate(older):
            shared = shared.join(r.select("fp").distinct().withColumn(f"in{i}", F.lit(True)), "fp", "left")
            met += f" or in{i}"
        shared = self._bucketed(shared.where(met), f"{s.root}/shared-{batch}")
        hits = [new.join(shared.select("fp"), "fp").withColumn("new", F.lit(True))]
        hits += [r.join(shared.where(f"in{i}").select("fp"), "fp").withColumn("new", F.lit(False)) for i, r in enumerate(older)]
        hits = reduce(DataFrame.unionAll, hits).groupBy("rid").agg(F.collect_set("fp").alias("shared"), F.max("new").alias("new"))
        committed = [int(r["name"]) for r in self.listed if r["kind"] == "texts"]
        around = self.texts([*committed, batch]).select("rid", "key", "text").join(hits.hint("shuffle_hash"), "rid")
        found = around.select("rid", "key", "text", "shared", "new").mapInArrow(lean(_candidates(self.window, self.gram)), "p long, q long, new boolean, key long, rid long, pos int, n int")
        first = F.min(F.struct("new", "key")).over(Window.partitionBy("p", "q"))
        again = found.withColumn("first", first).where("n > 0 or (new and (not first.new or key > first.key))")
        again = again.groupBy("rid", "key").agg(F.flatten(F.collect_list(F.array(F.col("pos").cast("long"), F.greatest("n", F.lit(1)).cast("long")))).alias("spots"))
        again = s.put(again)
        kept = [*self.listed, {"kind": "texts", "name": str(batch), "level": 0, "buckets": self.buckets}, {"kind": "run", "name": name, "level": 0, "buckets": self.buckets}]
        self._commit(kept)
        self._compact()
        return prints.where("size(spots) > 0").select("rid", "key", "spots").unionAll(again)

    def _commit(self, listed: list[dict]) -> None:
        self.manifest.commit(listed, self.version)
        self.version, self.listed = self.version + 1, listed

    def _compact(self) -> None:
        """Merges ``fanout`` runs of a level into one of the next, as often as there are so many."""
        while full := [i for i, names in enumerate(self.levels()) if len(names) >= self.fanout]:
            level, names = full[0], self.levels()[full[0]][: self.fanout]
            merged = self._write_run(reduce(DataFrame.unionAll, [self._run(n) for n in names]))
            rest = [r for r in self.listed if r["kind"] != "run" or r["name"] not in names]
            self._commit([*rest, {"kind": "run", "name": merged, "level": level + 1, "buckets": self.buckets}])
            for n in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(f'{self.path}/runs/{n}')}")
                release_path(self.spark, f"{self.path}/runs/{n}")


def release_path(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(rid, key) of a row."""
    key = F.coalesce(doc_id.cast("long"), F.lit(LOW))
    return F.xxhash64(key, text), key


def _removals(spark: SparkSession, docs: DataFrame, keep: list[str], window: int, gram: int, batches: int, fanout: int) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, kept_text, text and ``rest`` (the columns to keep) of each row."""
    text = F.col("text").cast("string")
    rid, key = row_keys(F.col("doc_id"), text)
    rest = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("rest")] if keep else []
    docs = docs.select(rid.alias("rid"), key.alias("key"), text.alias("text"), *rest)
    cuts = docs.agg(F.percentile_approx("key", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    index = FingerprintIndex(spark, window=window, gram=gram, fanout=fanout)
    edges, spots = [None, *cuts, None], []
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        part = F.lit(True)
        if a is not None:
            part &= F.col("key") > a
        if z is not None:
            part &= F.col("key") <= z
        spots.append(index.ingest(docs.where(part)))
    for level in index.levels():
        for name in level:
            release_path(spark, f"{index.path}/runs/{name}")
    spots = reduce(DataFrame.unionAll, spots).groupBy("rid", "key").agg(F.flatten(F.collect_list("spots")).alias("spots"))
    full = index.texts().join(spots.withColumnsRenamed({"rid": "r", "key": "k"}).hint("shuffle_hash"), F.expr("rid = r and key = k"), "left")
    also = ["rest", F.col("text").alias("old")] if keep else []
    full = full.select("key", "text", F.coalesce("spots", F.array().cast("array<long>")).alias("spots"), *also)
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType()), *full.schema.fields[3:]])
    return full.mapInArrow(lean(_remove(window)), out)


def remove_repeats(spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, batches: int = 3, fanout: int = 2) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, kept_text (null: unchanged).

    Removes each word covered by a window whose words also start earlier: in a document with a
    smaller doc_id, or earlier in the same one.  Windows are judged on the input.  The table goes
    through the index in ``batches`` ranges of doc_id, as arrivals would.

    Null or empty texts have no words; an empty table gives no rows.  A null doc_id sorts before all
    others.  Rows that share a doc_id are none of them "earlier" than another, so repeated rows get
    equal results.  Columns besides these two are ignored.  A task holds one text at least, and some
    hundred bytes for each of its words.
    """
    out = _removals(spark, docs, [], window, gram, batches, fanout)
    return out.select(F.when(F.col("key") != LOW, F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")


def strip_repeats(spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, batches: int = 3, fanout: int = 2) -> DataFrame:
    """docs with repeated passages cut out of text.  Unchanged documents keep their very text; a
    document of which nothing is left goes.  Each row is changed by its own text, whatever other rows
    share its doc_id; other columns, whatever their names, travel with the row; n_chars, where
    present, follows the text.  Empty tables, null and empty texts as in ``remove_repeats``."""
    keep = [c for c in docs.columns if c != "text"]
    out = _removals(spark, docs, keep, window, gram, batches, fanout).where("n_removed = 0 or n_removed < n_words")
    columns = {c: F.col("rest").getField(c) for c in keep} | {"text": F.coalesce("kept_text", "old").cast(docs.schema["text"].dataType)}
    if "n_chars" in keep:
        columns["n_chars"] = F.when(F.col("kept_text").isNotNull(), F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def op5_fingerprint_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(spark, docs).drop("kept_text")
