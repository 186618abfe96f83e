"""Fingerprint groups, divergence of sources and vector codes against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text: str | None, size: int) -> int:
    w = WORD.findall((text or "").translate(AZ))
    sh = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked) -> dict:
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        up[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def least_ids(fp: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint) -> the least doc_id that each reaches."""
    have = sorted({f for _, f in fp})
    of = classes(have, [(a, b) for i, a in enumerate(have) for b in have[:i] if (a ^ b).bit_count() <= 3])
    least: dict = {}
    for d, f in fp:
        if d is not None:
            least[of[f]] = min(d, least.get(of[f], d))
    return [(d, f"{f:016x}", least.get(of[f])) for d, f in fp]


def prose(seed: int = 3) -> list:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    out = []
    for _ in range(5):
        base = [rng.choice(vocab) for _ in range(rng.randint(120, 300))]
        for _ in range(40):
            out.append(" ".join(base))
            base[rng.randrange(len(base))] = rng.choice(vocab)
    out += ["", None, "\n\t ", "one", "ONE", "two Words", "a  b\tc", "😀 é", " ".join(rng.choice(vocab) for _ in range(30_000)), "la " * 5000]
    out += [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40))) for _ in range(60)] + [out[0]] * 9
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, f"l{i % 2}", f"s{i % 3}", 7, "x") for i, t in enumerate(prose())]
    rows += [rows[4], (None, rows[7][1], None, None, None, None), (None, "quite alone in here it is", "", "", 0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp int, term string").repartition(4)


def test_fingerprint_groups(spark, texts):
    from proselake.llm.simhash import near_fingerprints

    got = near_fingerprints(spark, texts, shingle=3).collect()
    want = least_ids([(r.doc_id, plain_fingerprint(r.text, 3)) for r in texts.collect()])
    assert sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert near_fingerprints(spark, texts.limit(0)).collect() == []
    assert near_fingerprints(spark, texts).count() == texts.count()


def test_fingerprint_query(spark):
    from proselake.llm.simhash import op11_simhash_groups

    sf = "/root/testdata/sf0.001"
    want = least_ids([(r.doc_id, plain_fingerprint(r.text, 3)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert sorted(tuple(r) for r in op11_simhash_groups(spark, sf).collect()) == sorted(want)


def clouds(n: int = 900) -> np.ndarray:
    """Fingerprints in dense clouds around a few centres, and some far from all."""
    rng = random.Random(9)
    found = set()
    for _ in range(4):
        c = rng.getrandbits(64)
        while len(found) % (n // 4 + 1) < n // 4:
            found.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))))
        found.add(c)
    return np.array(sorted(found | {rng.getrandbits(64) for _ in range(50)}), np.uint64)


def test_spanning_forest_and_grid():
    from proselake.llm.simhash import cells, enough_bands, spanning

    fp = clouds()
    linked = [(int(a), int(b)) for i, a in enumerate(fp) for b in fp[:i] if (int(a) ^ int(b)).bit_count() <= 3]
    want = classes([int(f) for f in fp], linked)
    u, v = spanning(fp)
    got = classes([int(f) for f in fp], list(zip(u.tolist(), v.tolist(), strict=True)))
    same = lambda of: {frozenset(k for k in of if of[k] == r) for r in of.values()}
    assert same(got) == same(want) and len(u) == len(fp) - len(same(want))
    assert all((a ^ b).bit_count() <= 3 for a, b in zip(u.tolist(), v.tolist(), strict=True))
    at = {int(f): i for i, f in enumerate(fp)}
    for bands in (5, 6, 8, 10, 12):  # every link has a cell in common, whatever the number of bands
        key = cells(fp, bands)
        assert all((key[at[a]] == key[at[b]]).any() for a, b in linked)
    assert [enough_bands(n) for n in (0, 10**5, 10**8, 10**11)] == [5, 5, 8, 12]


def test_hot_cells_fall_into_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from proselake.llm import simhash

    def as_written(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([int(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64))], ["doc_id", "fp"])

    fp = clouds()
    monkeypatch.setattr(simhash, "CELL", 20)
    rows = spark.createDataFrame([(i, str(f)) for i, f in enumerate(fp.tolist())], "doc_id long, text string")
    monkeypatch.setattr(simhash, "_fingerprints", lambda size: as_written)
    got = {r.doc_id: r.component_id for r in simhash.near_fingerprints(spark, rows.repartition(3)).select("doc_id", F.col("component_id")).collect()}
    want = {d: c for d, _, c in least_ids(list(enumerate(fp.tolist())))}
    assert got == want


def plain_divergence(rows, least, top):
    rows = [(la or "", so or "", TERM.findall((t or "").translate(AZ))) for t, la, so in rows]
    known, total, count = Counter(), Counter(), Counter()
    for la, so, w in rows:
        known.update((la, t) for t in set(w))
        total.update((la, t) for t in w)
        count.update((la, so, t) for t in w)
    kept = defaultdict(list)
    for la, t in sorted(known):
        if known[la, t] >= least:
            kept[la].append(t)
    groups = defaultdict(set)
    for la, so, _ in rows:
        groups[la].add(so)
    out = []
    for la, sources in groups.items():
        terms = kept[la]
        share = lambda c, terms=terms: {t: 1 + 10**9 * (c(t) + 5) // (sum(map(c, terms)) + 5 * len(terms)) for t in terms}
        q = share(lambda t, la=la: total[la, t])
        p = {so: share(lambda t, la=la, so=so: count[la, so, t]) for so in sources}
        for so in sources:
            pairs = sorted(((-sum(abs(p[so][t] - p[o][t]) for t in terms), o) for o in sources if o != so), key=lambda x: (x[0], x[1].encode()))
            best = sorted(((q[t] - p[so][t], t) for t in terms if count[la, so, t] and p[so][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(la, so, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)] + [(la, so, "term", t, -v, k) for k, (v, t) in enumerate(best, 1)]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    from proselake.llm import divergence as d

    rng = random.Random(5)
    words = ["Tea", "tee", "é", "ÉA", "ß", "x", "Zoo", "ant", "bee", "cow", "日本", "dot", "elk", "fox", "gnu"]
    rows = [(" ".join(rng.choice(words[: 5 + i % 11]) + rng.choice([" ", "1", "-", "\n"]) for _ in range(rng.randint(0, 30))), f"l{i % 3}", f"s{i % 7}") for i in range(150)]
    rows += [(None, "l0", "s1"), ("", None, None), ("tea", None, ""), ("lone word", "only", "one"), ("", "bare", "a"), (None, "bare", "b"), *rows[:5], ("tea " * 4000, "l1", "s1")]
    docs = spark.createDataFrame([(*r, 1, "v") for r in rows], "text string, lang string, source string, n int, term string").repartition(4)
    want = plain_divergence(rows, 6, 4)
    take = lambda: sorted(tuple(r) for r in d.divergence(spark, docs, least=6, top=4).collect())
    assert take() == want and {r[2] for r in want} == {"pair", "term"}
    monkeypatch.setattr(d, "BLOCK", 2)  # several blocks of sources, several shards a language
    monkeypatch.setattr(d, "SHARD", 3)
    assert take() == want
    assert d.divergence(spark, docs.limit(0)).collect() == []


def test_counts_are_merged_and_turns_keep_keys_whole():
    from proselake.llm import divergence as d

    b = pa.record_batch({"lang": ["a", "a", "b"], "source": ["s", "s", "s"], "text": ["Tea tea, x", "tea", None]})
    got = d._merged([d.count_chunk(b), d.count_chunk(b)]).to_pylist()
    assert sorted((r["lang"], r["term"], r["n"], r["docs"]) for r in got) == [("a", "tea", 6, 4), ("a", "x", 2, 2)]
    rows = pa.record_batch({"k": [1] * 5 + [2] * 9 + [3], "x": list(range(15))})
    run = d.by_sql("SELECT k, count(*) AS n FROM t GROUP BY k", ["k"])
    turn, d.TURN = d.TURN, 4
    try:
        out = [r for part in run(iter([rows.slice(i, 3) for i in range(0, 15, 3)])) for r in part.to_pylist()]
    finally:
        d.TURN = turn
    assert sorted((r["k"], r["n"]) for r in out) == [(1, 5), (2, 9), (3, 1)]


def plain_codes(rows, parts, entries, rounds):
    rows = [(i, v, la) for i, v, la in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == w]
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    cut = [w * j // parts for j in range(parts + 1)]
    part = [[v[a:b] for v in ints] for a, b in zip(cut, cut[1:], strict=False)]
    books = [[list(x) for x in p[:entries]] for p in part]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for j, book in enumerate(books):
            of = defaultdict(list)
            for x in part[j]:
                of[nearest(x, book)].append(x)
            books[j] = [[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if e in of else x for e, x in enumerate(book)]
    code = [[nearest(part[j][r], books[j]) for j in range(parts)] for r in range(len(rows))]
    error = [sum(far(part[j][r], books[j][code[r][j]]) for j in range(parts)) for r in range(len(rows))]
    return [(i, la, c, e) for (i, _, la), c, e in zip(rows, code, error, strict=True)], books


def vectors(n=300, w=10, seed=2):
    rng = random.Random(seed)
    rows = [(i * 3 % 307, [rng.choice([rng.gauss(0, 0.3), rng.randint(-2, 2) / 64]) for _ in range(w)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [rows[5], (rows[6][0], rows[9][1], 4), (None, rows[3][1], 1), (900, None, 1), (901, [], 1), (902, [None] + [0.0] * (w - 1), 1), (903, [math.nan] * w, 2), (904, [math.inf] * w, 2), (905, [0.5] * (w + 1), 1), *[(i, [0.25] * w, 1) for i in range(-9, 40)]]
    return rows


@pytest.mark.parametrize("entries", [7, 40, 1000])
def test_vector_codes(spark, entries):
    from proselake.llm.codes import compress, decode

    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, code int, x int").repartition(3)
    got = compress(spark, df, entries=entries)
    want, books = plain_codes(rows, 4, entries, 4)
    assert [b.tolist() for b in got.books] == books
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    assert sorted(((r.vec_id, r.label, list(r.code), r.error) for r in got.rows.collect()), key=key) == sorted(want, key=key)
    back = {tuple(r.code): r.decoded for r in decode(got.rows, got.books).collect()}
    for code, v in back.items():
        assert v == [x / 1024 for j, c in enumerate(code) for x in books[j][c]]
    assert compress(spark, df.limit(0)).rows.collect() == []


def test_bounds_spare_scans_and_hold():
    from proselake.llm.codes import distances, motion, scan, update

    rng = np.random.default_rng(1)
    centres = rng.integers(-800, 800, (12, 6))
    x = centres[rng.integers(0, 12, 4000)] + rng.integers(-40, 40, (4000, 6))
    old = x[:30].copy()
    code, upper, lower = scan(x, old)
    full = 0
    for _ in range(5):
        new = np.array([x[code == e].sum(0) // max(1, (code == e).sum()) if (code == e).any() else old[e] for e in range(30)])
        full = update(x, new, motion(old, new), code, upper, lower)
        d = distances(x, new)
        row = np.arange(len(x))
        assert (code == d.argmin(1)).all() and (upper >= np.sqrt(d[row, code])).all()
        d[row, code] = np.inf
        assert (lower <= np.sqrt(d.min(1))).all()
        old = new
    assert full < len(x) // 2
    big = np.array([[2**24, -(2**24)] * 3])
    assert distances(big, -big)[0, 0] == 6 * (2**25) ** 2


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_hamerly_codes"])
def test_new_queries_with_sql(spark, name):
    from proselake.llm import queries as q

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(q.oracle_sql()[name])
    got = q.queries()[name](spark, sf).select(want.columns).collect()
    assert got and sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_codes_query_digest(spark):
    from proselake.llm.codes import op13_hamerly_codes

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(60).collect()]
    assert rows and all(len(r.codebooks_sha256) == 64 and len(r.code) == 8 for r in op13_hamerly_codes(spark, sf).limit(3).collect())
    from proselake.llm.codes import compress

    want, books = plain_codes(rows, 4, 16, 2)
    got = compress(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=16, rounds=2)
    assert got.books_sha256() == hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
