"""Secret scans with corpus-wide ownership frequency.

Candidates of every text are hashed; over the corpus each hash is counted by distinct repositories
(documents' texts) and owners (sources).  A value that many owners or many repositories share is an
example that people copy; a value that stays with few of both, and looks random, is taken for live.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .text import lean

#: Kinds and patterns of the base rules.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the method adds: long tokens of mixed letters and digits, and private-key headers.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
KINDS = ["assign", "access", "hex", "token", "key"]
_HINT = re.compile(r"(?i)(?:sswor|passwd|secret|token|api_?key)", re.ASCII)
ENTROPY = 3.0
#: Widely copied: from so many owners on, or so many repositories (more than the near copies of one leaked text).
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def scan(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """(kind, start, end, value) of base matches, and of what the method may add."""
    base = []
    if _HINT.search(text):
        base += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    more = []
    if _DIGIT.search(text):
        base += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
        more += [(3, m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    elif _LONG_HEX.search(text):
        base += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        more += [(4, m.start(), m.end(), m[0]) for m in KEY.finditer(text)]
    base.sort(key=lambda x: (x[1], x[0]))
    taken = {(s, e) for _, s, e, _ in base}
    starts, reach = [s for _, s, _, _ in base], list(accumulate((e for _, _, e, _ in base), max))
    covered = lambda s, e: (k := bisect_right(starts, s)) and reach[k - 1] >= e
    more = [x for x in more if (x[1], x[2]) not in taken and not covered(x[1], x[2])]
    return base, more


_DIGIT = re.compile(r"[0-9]", re.ASCII)
_LONG_HEX = re.compile(r"[a-f]{24}")
SCANNED = "doc_id long, version string, base array<struct<kind:int,start:int,end:int,hash:string>>, more array<struct<kind:int,start:int,end:int,hash:string,random:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
    more_kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("random", pa.bool_())]))
    for b in batches:
        base, more, version = [], [], []
        for text in b.column(1):
            text = text.as_py() or ""
            p, q = scan(text)
            version.append(hashlib.blake2b(text.encode(), digest_size=12).hexdigest())
            base.append([{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()} for k, s, e, v in p])
            more.append([{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest(), "random": k == 4 or entropy(v) >= ENTROPY} for k, s, e, v in q])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(version, pa.string()), pa.array(base, base_kind), pa.array(more, more_kind)], ["doc_id", "version", "base", "more"])


def find_secrets(spark: SparkSession, docs: DataFrame, *, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, version (of the text), base, added, n_example, n_live, counts.

    ``base`` and ``added`` are arrays of (kind, start, end) in code points, ``end`` exclusive, kinds
    numbered as in KINDS.  Added spans look random and belong to fewer than ``example_owners``
    distinct sources and fewer than ``example_repositories`` distinct texts.  n_example and n_live
    count a document's candidates (base ones included): shared by that many of either, or not.
    ``counts`` gives (start, kind, end, owners, repositories) of every candidate.  A null source
    counts as one more owner, and a table without sources is judged by its texts;
    null or empty text has no candidates.  Repeated rows are scanned each for itself, and count
    as one repository.  An empty table gives no rows; very long texts are scanned in one task, in time that grows with
    their length; other columns are ignored, whatever their names.
    """
    s = Scratch(spark, "secrets")
    owner = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), owner.alias("owner"))
    rows = s.put(rows.select("doc_id", "text", "owner").mapInArrow(lean(_with_owner), SCANNED + ", owner string"))
    every = F.explode(F.concat(F.transform("base", lambda x: x["hash"]), F.transform("more", lambda x: x["hash"])))
    seen = rows.select("version", "owner", every.alias("hash")).distinct()
    owners = seen.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("version").alias("repositories"))
    spans = rows.where("size(base) + size(more) > 0").select("doc_id", "version", F.explode(F.concat(F.transform("base", lambda x: _as_span(x, False)), F.transform("more", lambda x: _as_span(x, True)))).alias("x")).select("doc_id", "version", "x.*").distinct()
    wide = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    judged = spans.join(owners, "hash").groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_list(F.when(F.col("extra") & F.col("random") & ~wide, F.struct("start", "kind", "end")))).alias("added"),
        F.count(F.when(wide, 1)).alias("n_example"),
        F.count(F.when(~wide, 1)).alias("n_live"),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories"))).alias("counts"),
    )
    judged = s.put(judged.withColumn("_doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).drop("doc_id"))
    out = rows.withColumn("_doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(judged, ["_doc", "version"], "left")
    base = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    added = F.transform(F.coalesce("added", F.array()), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select("doc_id", "version", base.alias("base"), added.alias("added"), F.coalesce("n_example", F.lit(0)).alias("n_example"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("counts", F.array().cast(judged.schema["counts"].dataType)).alias("counts"))


def _as_span(x, extra: bool):
    return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hash"].alias("hash"), (x["random"] if extra else F.lit(True)).alias("random"), F.lit(extra).alias("extra"))


def _with_owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for out in _scan(iter([b.select(["doc_id", "text"])])):
            yield pa.RecordBatch.from_arrays([*out.columns, b.column(2)], [*out.schema.names, "owner"])


def _label(x):
    return F.concat_ws(":", F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))


def redact_secrets(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs with every found span replaced by ``[SECRET]`` in text (overlapping spans as one);
    documents without spans keep their very text, n_chars follows where present.  Every row comes back
    once, judged by its own text, whatever other rows share its doc_id.  An empty table stays empty; other
    columns come back as they are, whatever their names."""
    s = Scratch(spark, "redact")
    found = find_secrets(spark, docs, **options).where("size(base) + size(added) > 0")
    found = s.put(found.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"), "version").dropDuplicates(["doc", "version"]))

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for text, parts in zip(texts, spans, strict=True):
            if parts is not None and text is not None:
                done, keep = 0, []
                for start, end in sorted((p["start"], p["end"]) for p in parts):
                    if start >= done:
                        keep += [text[done:start], "[SECRET]"]
                    done = max(done, end)
                text = "".join([*keep, text[done:]])
            out.append(text)
        return spans.__class__(out, dtype=object)

    @F.pandas_udf("string")
    def version(texts):
        return texts.map(lambda t: hashlib.blake2b((t or "").encode(), digest_size=12).hexdigest())

    marked = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), version(F.col("text").cast("string")).alias("version"))
    both = marked.join(found, ["doc", "version"], "left").select("row", "spans", cut(F.col("row.text"), F.col("spans")).alias("done"))
    kinds = {f.name.lower(): f.dataType for f in docs.schema.fields}
    size = F.when(F.col("spans").isNotNull(), F.length("done").cast(kinds.get("n_chars", T.LongType()))).otherwise(F.col("row.n_chars") if "n_chars" in kinds else F.lit(None))
    new = {"text": F.col("done"), "n_chars": size}
    return both.select(*((new[c.lower()] if c.lower() in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op10_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    text = lambda spans: F.concat_ws(",", F.transform(spans, _label))
    every = F.sort_array(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(text("base"), 256).alias("base_sha256"), text(every).alias("spans"), "n_example", "n_live")
