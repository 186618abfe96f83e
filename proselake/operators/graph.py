"""Operators on dependency trees, as array expressions over one sentence.

A parse is a row (doc_id, sent_idx, text, start, end, tokens) with tokens an array of (id, form, upos, head,
deprel, start, end), ids from 1, head 0 for the root.  ``with_paths`` adds what all operators share: for each
token its lower-case form, its children's ids and its ancestors from its head up, cycles cut.  The looks below say the
same of all sentences of a block at once (see ``trees``), and give rows without nodes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions.text import let
from proselake.operators import shallow
from proselake.operators.trees import Block, Trees

TOKENS = "array<struct<id:int,form:string,upos:string,head:int,deprel:string,start:int,end:int>>"

# Words and relations of the detectors.
SINGULAR, PLURAL = ["it", "its"], ["they", "them", "their"]
NEUTRAL_NOUNS = ["data", "people", "team", "group", "staff", "media", "company", "user"]
ARGUMENT = r"^(?:nsubj|obj|iobj|root|csubj|appos|conj|nmod|obl|xcomp|ccomp)(?::|$)"
PARALLEL = ["only", "just", "merely", "simply", "also", "too"]
EDITORIAL = ["showcasing", "highlighting", "underscoring", "emphasizing", "emphasising", "reflecting", "symbolizing", "symbolising", "cementing", "solidifying", "reinforcing", "exemplifying", "demonstrating", "fostering", "cultivating", "signaling", "signalling", "embodying", "epitomizing", "epitomising", "illustrating", "affirming", "reshaping", "redefining"]
COPULA = ["stand", "stands", "stood", "serve", "serves", "served", "act", "acts", "acted", "function", "functions", "functioned", "emerge", "emerges", "emerged", "represent", "represents", "remain", "remains", "remained", "constitute", "constitutes", "embody", "embodies"]
LIGHT = ["play", "plays", "played", "serve", "serves", "served", "occupy", "occupies", "occupied", "hold", "holds", "held", "assume", "assumes", "assumed", "fill", "fills", "filled"]
ROLES = ["role", "part", "function"]
IMPORTANT = ["important", "critical", "crucial", "essential", "vital", "key", "necessary", "noteworthy", "worth", "worthwhile", "useful", "helpful", "significant", "imperative", "interesting"]
COGNITION = ["note", "mention", "remember", "understand", "consider", "recognize", "recognise", "realize", "realise", "appreciate", "emphasize", "emphasise", "highlight", "acknowledge", "stress", "underscore", "clarify", "point"]
SETUP = ["thing", "note", "caveat", "ask", "flag", "point", "question", "request", "disclaimer"]
ACCOUNTABLE = ["approved", "blamed", "censored", "changed", "chosen", "concealed", "decided", "denied", "determined", "dismissed", "excluded", "forced", "hidden", "ignored", "made", "omitted", "overlooked", "punished", "raised", "rejected", "reported", "suppressed"]
SOFTENERS = ["pretty", "quite", "fairly", "somewhat", "rather", "relatively", "reasonably"]
HEDGE_VERBS, HEDGE_MODALS = ["seem", "seems", "seemed", "sound", "sounds", "sounded", "appear", "appears", "appeared"], ["might", "may", "could"]
LIGHT_VERBS = ["make", "makes", "made", "making", "take", "takes", "took", "taking", "conduct", "conducts", "conducted", "conducting", "perform", "performs", "performed", "performing", "provide", "provides", "provided", "providing", "carry", "carries", "carried", "undertake", "undertook", "undertaken", "reach", "reached", "come", "came", "give", "gives", "gave", "given"]
DEVERBAL = ["decision", "decisions", "assessment", "assessments", "evaluation", "evaluations", "analysis", "analyses", "recommendation", "recommendations", "determination", "conclusion", "conclusions", "improvement", "improvements", "consideration", "investigation", "investigations", "examination", "comparison", "comparisons", "implementation", "assumption", "assumptions", "adjustment", "adjustments", "contribution", "contributions", "observation", "observations", "description", "explanation"]
TRANSITION_LEADS, STRONG_LEADS = ["after", "and", "before", "but", "for", "no", "not", "now", "then", "until", "yet"], ["no", "not", "then", "until"]
BARE = ["it", "that", "this", "these", "those", "they"]
BACK_REFERENCES = ["it", "they", "this", "that"]
WH = ["how", "what", "why"]


NODES = "array<struct<id:int,form:string,upos:string,head:int,deprel:string,start:int,end:int,low:string,kids:array<int>,anc:array<int>,sub:array<int>,run:int>>"
#: Sentences that a task holds as Python objects at a time.
SLICE = 256
_INT = pa.int32()
_NODES = pa.list_(pa.struct([("id", _INT), ("form", pa.string()), ("upos", pa.string()), ("head", _INT), ("deprel", pa.string()), ("start", _INT), ("end", _INT), ("low", pa.string()), ("kids", pa.list_(_INT)), ("anc", pa.list_(_INT)), ("sub", pa.list_(_INT)), ("run", _INT)]))


def _linked(tokens: list[dict] | None) -> list[dict] | None:
    """Tokens with what ``with_paths`` adds; where heads form a cycle, a path ends before it meets a token again."""
    if not tokens:
        return None
    head, kids, below = {}, {}, {t["id"]: [t["id"]] for t in tokens}
    base = {t["id"]: (t["deprel"] or "").split(":", 1)[0] for t in tokens}
    for t in tokens:
        head.setdefault(t["id"], t["head"])
        kids.setdefault(t["head"], []).append(t["id"])
    out = []
    for t in tokens:
        path, met, up = [], {t["id"]}, t["head"]
        while up and up not in met:
            path.append(up)
            met.add(up)
            if up in below:
                below[up].append(t["id"])
            up = head.get(up, 0)
        run = next((k for k, i in enumerate(path, 1) if base.get(i) != base[t["id"]]), len(path) + 1)
        out.append({**t, "low": t["form"].lower(), "kids": kids.get(t["id"], []), "anc": path, "run": run})
    return [{**t, "sub": sorted(below[t["id"]])} for t in out]


def with_paths(parses: DataFrame) -> DataFrame:
    """parses with ``nodes``: tokens with low, kids (ids in order), anc (ancestor ids, nearest first), sub (ids of the
    token and all below it) and run (how many tokens from it up, itself included, have its relation in a row).

    One pass a sentence; the paths take as much room as its tokens' depths together.  Ids are 1, 2, 3 and so on.
    """

    @F.arrow_udf(NODES)
    def nodes(tokens: pa.Array) -> pa.Array:
        # Slice by slice, as tokens take far more room as Python's than as Arrow's.
        parts = [pa.array([_linked(t.as_py()) for t in tokens.slice(k, SLICE)], _NODES) for k in range(0, len(tokens), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], _NODES)

    return parses.withColumn("nodes", nodes(F.col("tokens")))


def by_id(nodes: Column, i) -> Column:
    return F.get(nodes, i - 1)


def root(nodes: Column) -> Column:
    return F.get(F.filter(nodes, lambda t: t["head"] == 0), F.lit(0))


def is_rel(t: Column, rel: str) -> Column:
    return (t["deprel"] == rel) | t["deprel"].startswith(rel + ":")


def children(nodes: Column, t: Column) -> Column:
    return F.transform(t["kids"], lambda i: by_id(nodes, i))


def children_by(nodes: Column, t: Column, rel: str) -> Column:
    return F.filter(children(nodes, t), lambda o: is_rel(o, rel))


def child(nodes: Column, t: Column, rel: str) -> Column:
    return F.get(children_by(nodes, t, rel), F.lit(0))


def has_child(nodes: Column, t: Column, rel: str) -> Column:
    return F.exists(children(nodes, t), lambda o: is_rel(o, rel))


def some(nodes: Column, t: Column, test) -> Column:
    """Has t a child for which test holds?"""
    return F.exists(children(nodes, t), test)


def those(nodes: Column, t: Column, test) -> Column:
    """The children of t for which test holds."""
    return F.filter(children(nodes, t), test)


def subtree(nodes: Column, t: Column) -> Column:
    """t and all below it, by id."""
    return F.transform(t["sub"], lambda i: by_id(nodes, i))


def span_of(toks: Column) -> Column:
    return F.struct(F.array_min(F.transform(toks, lambda t: t["start"])).alias("start"), F.array_max(F.transform(toks, lambda t: t["end"])).alias("end"))


def below(nodes: Column, t: Column, rel: str) -> Column:
    """Tokens that hang from t by a chain of one relation (or its subtypes), by id."""
    return F.filter(subtree(nodes, t), lambda o: (o["id"] != t["id"]) & is_rel(o, rel) & (F.array_position(o["anc"], t["id"]) <= o["run"]))


def _token_rows(b: Block, **more: pa.Array) -> pa.RecordBatch:
    t = b.trees
    cols = {"doc_id": b.doc_id.take(pa.array(t.sent)), "sent_idx": b.column(0, pa.int64()).take(pa.array(t.sent)), "id": pa.array(t.id, pa.int64()), **more}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _at(values: pa.Array, places: np.ndarray) -> pa.Array:
    """values at places, null where a place is -1."""
    return values.take(pa.array(places, mask=places < 0))


CHILDREN = "sent_idx long, id long, kids string, first_kid string, head_form string, has_subject boolean, depth long"


def children_look(b: Block) -> pa.RecordBatch:
    """Each token with its children, its head and how deep it lies."""
    t = b.trees
    heads, kids = t.kids()
    n = len(t.head)
    first = np.full(n, -1)
    first[heads[::-1]] = kids[::-1]
    has = np.zeros(n, bool)
    has[heads[t.is_rel("nsubj")[kids]]] = True
    _, below = t.climbed(np.arange(n))
    depth = np.bincount(below, minlength=n)
    return _token_rows(b, kids=t.joined_ids(heads, kids), first_kid=_at(t.form.array(), first), head_form=_at(t.form.array(), t.up), has_subject=pa.array(has), depth=pa.array(depth, pa.int64()))


SUBTREES = "sent_idx long, id long, ids string, start_at long, end_at long"


def subtree_look(b: Block) -> pa.RecordBatch:
    """Each token with all below it and their span."""
    t = b.trees
    own = np.arange(len(t.head))
    tops, below = t.climbed(own)
    tops, below = np.append(tops, own), np.append(below, own)
    order = np.lexsort((below, tops))
    tops, below = tops[order], below[order]
    begins = np.searchsorted(tops, own)
    over = lambda f, x: f.reduceat(x[below], begins) if len(own) else own
    return _token_rows(b, ids=t.joined_ids(tops, below), start_at=pa.array(over(np.minimum, t.start), pa.int64()), end_at=pa.array(over(np.maximum, t.end), pa.int64()))


def chained(t: Trees, rel: str) -> tuple[np.ndarray, np.ndarray]:
    """(top, token) for tokens that hang from a top by a chain of one relation (or its subtypes), in order."""
    held = t.is_rel(rel)
    return t.climbed(np.flatnonzero(held), held)


def subjects_from(t: Trees) -> np.ndarray:
    """For each token the one whose subjects it has: itself, or the nearest head up a chain of conj that has some."""
    heads, _ = t.kids(t.is_rel("nsubj"))
    goes_on = t.is_rel("conj") & (t.up >= 0)
    goes_on[heads] = False
    to = np.arange(len(t.head))
    moves = np.flatnonzero(goes_on & ~t.lost)
    while len(moves):
        to[moves] = t.up[to[moves]]
        moves = moves[goes_on[to[moves]]]
    for i in np.flatnonzero(goes_on & t.lost).tolist():
        to[i] = next((j for j in t.path(i) if not goes_on[j]), ([i, *t.path(i)])[-1])
    return to


CHAINS = "sent_idx long, id long, joined string, compounds string, subjects string"


def chain_look(b: Block) -> pa.RecordBatch:
    """Each token with what is joined to it, its compounds and its subjects, also those it takes over."""
    t = b.trees
    subjects = t.joined_ids(*t.kids(t.is_rel("nsubj")))
    return _token_rows(b, joined=t.joined_ids(*chained(t, "conj")), compounds=t.joined_ids(*chained(t, "compound")), subjects=subjects.take(pa.array(subjects_from(t))))


CHECKS = "sent_idx long, root_id long, valid boolean"


def check_look(b: Block) -> pa.RecordBatch:
    """Each sentence with its first root, and whether its heads make one tree."""
    t = b.trees
    root = np.full(len(t.counts), -1)
    roots = np.flatnonzero(t.head == 0)[::-1]
    root[t.sent[roots]] = t.id[roots]
    return pa.RecordBatch.from_arrays([b.doc_id, b.column(0, pa.int64()), pa.array(root, pa.int64(), mask=root < 0), pa.array(t.valid())], ["doc_id", "sent_idx", "root_id", "valid"])


def is_tree(heads: list[int] | None) -> bool:
    """One root, heads in range, no token its own head, every token below the root."""
    n = len(heads or [])
    if not n or None in heads or sum(h == 0 for h in heads) != 1 or any(h < 0 or h > n or h == i for i, h in enumerate(heads, 1)):
        return False
    safe = [False] * (n + 1)
    safe[0] = True
    for i in range(1, n + 1):
        path, up = [], i
        while not safe[up]:
            if len(path) > n:  # a cycle
                return False
            path.append(up)
            up = heads[up - 1]
        for k in path:
            safe[k] = True
    return True


def valid_tree(heads: Column) -> Column:
    """Do an array's heads make one tree?  Null and empty arrays don't."""

    @F.arrow_udf("boolean")
    def valid(rows: pa.Array) -> pa.Array:
        return pa.array([is_tree(r.as_py()) for r in rows], pa.bool_())

    return valid(heads)


def noun_fits(t: Column, plural: bool) -> Column:
    looks = t["low"].endswith("s") & ~t["low"].rlike("(?:ss|us|is)$")
    fits = t["low"].isin(NEUTRAL_NOUNS) | (t["upos"] == "PROPN") | (looks if plural else ~looks)
    return t["upos"].isin("NOUN", "PROPN") & t["deprel"].rlike(ARGUMENT) & fits


def _references(nodes: Column) -> dict[str, Column]:
    """What a sentence offers a pronoun, and its own pronouns: all that windows over sentences need of its nodes."""
    fits = lambda plural, words: F.exists(nodes, lambda t: noun_fits(t, plural) | t["low"].isin(words))
    first = lambda plural: F.array_min(F.transform(F.filter(nodes, lambda t: noun_fits(t, plural)), lambda t: t["start"]))
    return {"fits_one": fits(False, SINGULAR), "fits_many": fits(True, PLURAL), "first_one": first(False), "first_many": first(True)}


def _last_fitting() -> dict[str, Column]:
    """The last sentences before with something that fits, over what ``_references`` gives."""
    w = Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda flag: F.last(F.when(F.col(flag), F.col("sent_idx")), ignorenulls=True).over(w)
    return {"one": last("fits_one"), "many": last("fits_many")}


def _distance(low: Column, start: Column) -> Column:
    plural = low.isin(PLURAL)
    own = F.coalesce(F.when(plural, F.col("first_many")).otherwise(F.col("first_one")) < start, F.lit(False))
    return F.when(own, 0).otherwise(F.col("sent_idx") - F.when(plural, F.col("many")).otherwise(F.col("one")))


def reference_distance(pathed: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, id, distance) of each personal pronoun: sentences back to what it may mean, 0 in its
    own, null if nothing fits; an as-of join backwards, as the last fitting sentence before.  Nodes are not shuffled."""
    n = F.col("nodes")
    said = F.transform(F.filter(n, lambda t: t["low"].isin(SINGULAR + PLURAL)), lambda t: F.struct(t["id"].alias("id"), t["low"].alias("low"), t["start"].alias("start")))
    s = pathed.select("doc_id", "sent_idx", said.alias("said"), *(c.alias(k) for k, c in _references(n).items())).withColumns(_last_fitting())
    p = s.select("doc_id", "sent_idx", "one", "many", "first_one", "first_many", F.explode_outer("said").alias("t")).where("t is not null")
    return p.select("doc_id", "sent_idx", F.col("t.id").alias("id"), _distance(F.col("t.low"), F.col("t.start")).cast("long").alias("distance"))


_LOOKS_MANY, _ARGUMENT = re.compile("(?<!ss)(?<!us)(?<!is)s$"), re.compile(ARGUMENT)


class Offers:
    """What sentences offer a pronoun, as ``_references`` and ``_last_fitting`` say, from block to block: for one and for many
    whether a sentence fits, where its first fitting noun begins, and the last sentence before it in its text that fits (-1
    where there is none)."""

    def __init__(self):
        self.no, self.last = -1, [-1, -1]

    def __call__(self, b: Block) -> list[tuple[np.ndarray, np.ndarray]]:
        t, n = b.trees, len(b.sents)
        upos, low = t.upos.among(("NOUN", "PROPN")), t.low
        noun = upos & t.deprel.told(lambda r: _ARGUMENT.search(r) is not None)
        always, many = low.among(NEUTRAL_NOUNS) | t.upos.among(("PROPN",)), low.told(lambda w: _LOOKS_MANY.search(w) is not None)
        idx = np.array([s[0] for s in b.sents], np.int64)
        begins = np.searchsorted(b.text_no, b.text_no)  # each text's first sentence here
        out = []
        for k, (looks, words) in enumerate(((~many, SINGULAR), (many, PLURAL))):
            fits = noun & (always | looks)
            first = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(first, t.sent[fits], t.start[fits])
            said = np.bincount(t.sent[fits | low.among(words)], minlength=n) > 0
            upto = np.maximum.accumulate(np.where(said, np.arange(n), -1))
            before = np.append(-1, upto[:-1])[:n]
            last = np.where(before >= begins, idx[before], np.where(b.text_no == self.no, self.last[k], -1))
            out.append((first, last))
            if n:
                end = b.text_no[-1]
                self.last[k] = int(idx[upto[-1]]) if upto[-1] >= begins[-1] else self.last[k] if end == self.no else -1
        if n:
            self.no = b.text_no[-1]
        return out


DISTANCES = "sent_idx long, id long, plural boolean, distance long"


class Distances:
    """A task's look: ``reference_distance`` of each personal pronoun within its own text, and whether it means many."""

    def __init__(self):
        self.offers = Offers()

    def __call__(self, b: Block) -> pa.RecordBatch:
        t, offers = b.trees, self.offers(b)
        plural = t.low.among(PLURAL)
        said = np.flatnonzero(plural | t.low.among(SINGULAR))
        sent, plural, idx = t.sent[said], plural[said], np.array([s[0] for s in b.sents], np.int64)
        first, last = (np.where(plural, many[sent], one[sent]) for one, many in zip(*offers, strict=True))
        own = first < t.start[said]
        cols = [pa.array(idx[sent]), pa.array(t.id[said], pa.int64()), pa.array(plural), pa.array(np.where(own, 0, idx[sent] - last), pa.int64(), mask=~own & (last < 0))]
        return pa.RecordBatch.from_arrays([b.doc_id.take(pa.array(sent)), *cols], ["doc_id", "sent_idx", "id", "plural", "distance"])


def distances_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, sent_idx, id, plural, distance of their shallow parses' pronouns, in the same pass."""
    return shallow.looked(docs, Distances, f"doc_id {dict(docs.dtypes)['doc_id']}, {DISTANCES}")


def last_fitting(pathed: DataFrame) -> DataFrame:
    """doc_id, one, many: a document's last sentences that offer something to a pronoun."""
    s = pathed.select("doc_id", "sent_idx", *(c.alias(k) for k, c in _references(F.col("nodes")).items()))
    return s.groupBy("doc_id").agg(*(F.max(F.when(F.col(f"fits_{k}"), F.col("sent_idx"))).alias(k) for k in ("one", "many")))


def hit(rule: str, toks: Column, confidence) -> Column:
    """One finding over the tokens."""
    return let(span_of(toks), lambda s: F.struct(F.lit(rule).alias("rule"), s["start"].alias("start"), s["end"].alias("end"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence")))


def _each(nodes: Column, test, found) -> Column:
    return F.transform(F.filter(nodes, test), found)


def sentence_rules(nodes: Column, text: Column, n_words: Column) -> Column:
    """Findings of the rules that look at one sentence; see ``graph_findings`` for grades that look further."""
    out = []
    same = lambda t: those(nodes, t, lambda o: is_rel(o, "conj") & (o["upos"] == t["upos"]))
    out.append(_each(nodes, lambda t: t["upos"].isin("ADJ", "ADV") & t["deprel"].isin("amod", "advmod", "root", "conj") & (F.size(same(t)) >= 2), lambda t: hit("rule-of-three", F.concat(F.array(t), same(t)), "low")))

    def contrast(y):
        x = by_id(nodes, y["head"])
        lows = lambda t: F.transform(children(nodes, t), lambda c: c["low"])
        return (y["deprel"] == "conj") & (child(nodes, y, "cc")["low"] == "but") & F.arrays_overlap(lows(x), F.array(F.lit("not"), F.lit("neither"))) & F.arrays_overlap(F.concat(lows(x), lows(y)), F.array(*(F.lit(w) for w in PARALLEL)))

    out.append(_each(nodes, lambda y: F.coalesce(contrast(y), F.lit(False)), lambda y: hit("negative-parallelism", F.concat(subtree(nodes, by_id(nodes, y["head"])), subtree(nodes, y)), "low")))
    trailing = lambda g: g["deprel"].isin("advcl", "acl") & (g["upos"] == "VERB") & g["low"].isin(EDITORIAL) & (g["id"] > g["head"]) & (by_id(nodes, g["id"] - 1)["form"] == ",")
    out.append(_each(nodes, lambda g: F.coalesce(trailing(g), F.lit(False)), lambda g: hit("participial-appendage", subtree(nodes, g), "low")))
    as_noun = lambda v: those(nodes, v, lambda o: is_rel(o, "obl") & o["upos"].isin("NOUN", "PROPN") & some(nodes, o, lambda c: (c["deprel"] == "case") & (c["low"] == "as")))
    out.append(_each(nodes, lambda v: (v["upos"] == "VERB") & v["low"].isin(COPULA) & has_child(nodes, v, "nsubj") & (F.size(as_noun(v)) > 0), lambda v: hit("copula-avoidance", F.concat(F.array(v), subtree(nodes, F.get(as_noun(v), F.lit(0)))), "medium")))
    role = lambda v: F.get(those(nodes, v, lambda o: is_rel(o, "obj") & o["low"].isin(ROLES)), F.lit(0))
    out.append(_each(nodes, lambda v: (v["upos"] == "VERB") & v["low"].isin(LIGHT) & F.coalesce(some(nodes, role(v), lambda a: is_rel(a, "amod") & (a["upos"] == "ADJ")), F.lit(False)), lambda v: hit("light-verb-role", F.concat(F.array(v), subtree(nodes, role(v))), "low")))
    clears = lambda a: (a["upos"] == "ADJ") & a["low"].isin(IMPORTANT) & has_child(nodes, a, "cop") & (child(nodes, a, "nsubj")["low"] == "it") & some(nodes, a, lambda c: c["deprel"].isin("xcomp", "csubj", "advcl", "acl") & (c["upos"] == "VERB") & c["low"].isin(COGNITION))
    out.append(_each(nodes, lambda a: F.coalesce(clears(a), F.lit(False)), lambda a: hit("throat-clearing", F.concat(F.array(child(nodes, a, "nsubj")), subtree(nodes, a)), "medium")))
    setup = lambda r: (r["head"] == 0) & (r["upos"] == "NOUN") & r["low"].isin(SETUP) & text.endswith(".") & (n_words >= 5) & some(nodes, r, lambda c: c["deprel"].isin("acl:relcl", "acl")) & ~some(nodes, r, lambda c: c["deprel"].isin("cop", "parataxis", "conj"))
    out.append(_each(nodes, setup, lambda r: hit("setup-fragment", nodes, "medium")))
    out.append(_each(nodes, lambda a: (a["upos"] == "ADJ") & some(nodes, a, lambda c: (c["deprel"] == "advmod") & c["low"].isin(SOFTENERS)), lambda a: hit("qualifier-softener", F.array(F.get(those(nodes, a, lambda c: (c["deprel"] == "advmod") & c["low"].isin(SOFTENERS)), F.lit(0)), a), "medium")))
    plain = lambda t: t["form"].rlike("^[a-z][a-z-]*$")
    piles = lambda h: (h["upos"] == "NOUN") & plain(h) & let(below(nodes, h, "compound"), lambda m: (F.size(m) >= 3) & ~F.exists(m, lambda c: ~plain(c)))
    verbal = F.exists(nodes, lambda t: t["upos"].isin("VERB", "AUX"))
    out.append(F.when(verbal, _each(nodes, piles, lambda h: hit("stacked-nouns", F.concat(below(nodes, h, "compound"), F.array(h)), "medium"))).otherwise(F.array().cast("array<struct<rule:string,start:int,end:int,confidence:string>>")))
    buried = lambda t: (t["upos"] == "VERB") & t["low"].isin(LIGHT_VERBS) & child(nodes, t, "obj")["low"].isin(DEVERBAL)
    out.append(_each(nodes, lambda t: F.coalesce(buried(t), F.lit(False)), lambda t: hit("nominalization", F.array(t, child(nodes, t, "obj")), "medium")))
    modal = lambda v: F.get(those(nodes, v, lambda c: (c["deprel"] == "aux") & c["low"].isin(HEDGE_MODALS)), F.lit(0))
    seeming = lambda v: F.get(those(nodes, v, lambda c: c["deprel"].isin("nsubj", "expl") & c["low"].isin("it", "this")), F.lit(0))
    out.append(_each(nodes, lambda v: v["low"].isin(HEDGE_VERBS) & modal(v).isNotNull() & seeming(v).isNotNull(), lambda v: hit("hedge-opener", F.array(seeming(v), modal(v), v), "high")))

    def fragment(r):
        lead = F.get(F.filter(nodes, lambda t: ~t["upos"].isin("PUNCT", "SYM")), F.lit(0))["low"]
        return (r["head"] == 0) & (n_words <= 4) & text.endswith(".") & ~r["upos"].isin("VERB", "AUX") & lead.isin(TRANSITION_LEADS) & some(nodes, r, lambda c: c["deprel"].isin("case", "advmod", "cc", "mark"))

    lead_strong = F.get(F.filter(nodes, lambda t: ~t["upos"].isin("PUNCT", "SYM")), F.lit(0))["low"].isin(STRONG_LEADS)
    out.append(_each(nodes, lambda r: F.coalesce(fragment(r), F.lit(False)), lambda r: hit("dramatic-fragment", nodes, F.when(lead_strong, "medium").otherwise("low"))))

    def question(r):
        first = F.get(nodes, F.lit(0))
        follows = F.exists(nodes, lambda t: (t["upos"] == "VERB") & F.coalesce(by_id(nodes, t["id"] + 1)["upos"].isin("AUX", "NOUN", "PROPN", "VERB"), F.lit(False)))
        return (r["head"] == 0) & text.rlike("\\.[\"')\\]]*$") & (r["upos"] == "VERB") & (first["head"] == r["id"]) & first["low"].isin(WH) & first["deprel"].isin("obj", "advmod") & ~((first["low"] == "what") & follows) & ~some(nodes, r, lambda c: c["deprel"] == "aux")

    out.append(_each(nodes, lambda r: F.coalesce(question(r), F.lit(False)), lambda r: hit("wh-fragment", nodes, "medium")))

    def opener(r):
        cont = F.get(those(nodes, r, lambda c: c["deprel"].isin("conj", "parataxis")), F.lit(0))
        shape_a = (r["upos"] == "VERB") & (r["id"] <= 3) & some(nodes, r, lambda c: c["deprel"].isin("nsubj:pass", "nsubj")) & ~some(nodes, r, lambda c: c["deprel"].isin("aux", "aux:pass", "cop"))
        shape_b = (r["upos"] == "NOUN") & (r["id"] <= 2) & some(nodes, r, lambda c: (c["deprel"] == "acl") & (c["upos"] == "VERB") & (c["id"] == r["id"] + 1))
        subject = child(nodes, cont, "nsubj")
        at = _first_id(nodes, cont)
        before = F.size(F.filter(nodes, lambda t: (t["id"] < at) & (t["upos"] != "PUNCT")))
        return (r["head"] == 0) & (shape_a | shape_b) & (subject["upos"] == "PRON") & subject["low"].isin(BACK_REFERENCES) & (before <= 4) & (F.coalesce(by_id(nodes, at)["form"] == ",", F.lit(False)) | F.coalesce(by_id(nodes, at - 1)["form"] == ",", F.lit(False)))

    head_of = lambda r: F.get(those(nodes, r, lambda c: c["deprel"].isin("conj", "parataxis")), F.lit(0))
    out.append(_each(nodes, lambda r: F.coalesce(opener(r), F.lit(False)), lambda r: hit("agentless-opener", let(_first_id(nodes, head_of(r)), lambda at: F.filter(nodes, lambda t: (t["id"] < at) & (t["upos"] != "PUNCT"))), "medium")))
    return F.concat(*out)


def _first_id(nodes: Column, t: Column) -> Column:
    return F.array_min(F.transform(subtree(nodes, t), lambda o: o["id"]))


def signs(pathed: DataFrame, *more: str) -> DataFrame:
    """pathed -> doc_id, sent_idx, start, end and what each sentence's own tree finds: all that the rules need of it."""
    n = F.col("nodes")
    words = F.size(F.filter(n, lambda t: ~t["upos"].isin("PUNCT", "SYM")))
    found = {"own": sentence_rules(n, F.col("text"), words), "passive": _passive(n), "bare": F.coalesce(_opens_bare(n), F.lit(False)), **_references(n)}
    return pathed.select("doc_id", "sent_idx", "start", "end", *more, *(c.alias(k) for k, c in found.items()))


def placed_signs(parses: DataFrame) -> DataFrame:
    """``signs`` of all sentences, with the last before each that fit a pronoun (one, many)."""
    return signs(with_paths(parses)).withColumns(_last_fitting())


def graph_findings(parses: DataFrame) -> DataFrame:
    """parses -> doc_id, sent_idx, rule, start, end, confidence of all graph rules.

    Contrasts and short fragments count over the document: from two on they are medium.  Passives look
    back for what a pronoun means; three sentences in a row that open with a bare pronoun make one finding.
    Nodes are looked at once; only what the sentences found goes by document, in one shuffle.
    """
    return judged(placed_signs(parses))


def judged(s: DataFrame) -> DataFrame:
    """Findings from ``placed_signs``; sentences without any sign may be left out."""
    counted = {"negative-parallelism": "n_contrasts", "dramatic-fragment": "n_fragments"}
    every = Window.partitionBy("doc_id")
    s = s.withColumns(_bare_island() | {k: F.sum(F.coalesce(F.size(F.filter("own", lambda f: f["rule"] == rule)), F.lit(0))).over(every) for rule, k in counted.items()})  # noqa: B023
    s = s.withColumns(_bare_run())
    many = lambda f: F.coalesce(*(F.when(f["rule"] == rule, F.col(k) >= 2) for rule, k in counted.items()), F.lit(False))
    as_hit = lambda rule, start, end, grade: F.struct(F.lit(rule).alias("rule"), start.alias("start"), end.alias("end"), grade.alias("confidence"))
    own = F.transform("own", lambda f: F.struct(f["rule"].alias("rule"), f["start"].alias("start"), f["end"].alias("end"), F.when(many(f), "medium").otherwise(f["confidence"]).alias("confidence")))
    hidden = F.filter("passive", lambda f: f["verb"].isin(ACCOUNTABLE) | ~_near(f["subject"], f["at"]))
    passive = F.transform(hidden, lambda f: as_hit("passive-actor-hiding", f["span"]["start"], f["span"]["end"], _passive_grade(f["verb"], f["subject"])))
    runs = F.array(as_hit("referential-compression", F.col("run_start"), F.col("run_end"), F.lit("low")))
    none = F.array().cast("array<struct<rule:string,start:int,end:int,confidence:string>>")
    rows = F.concat(F.coalesce(own, none), F.coalesce(passive, none), F.when(F.col("bare") & (F.col("run_place") == 1) & (F.col("run_n") >= RUN), runs).otherwise(none))
    return s.select("doc_id", "sent_idx", F.explode_outer(rows).alias("f")).where("f is not null").select("doc_id", "sent_idx", "f.*")


SIGNS = f"sent_idx int, start int, end int, text string, tokens {TOKENS}, one int, many int"


def may_find(t: Trees, n_sents: int) -> np.ndarray:
    """Sentences in which ``sentence_rules`` or ``_passive`` may find something, by what each rule can't do without."""
    upos, low, form = t.upos.among, t.low.among, t.form
    here = lambda which: np.bincount(t.sent[which], minlength=n_sents)
    both = lambda a, b: (here(a) > 0) & (here(b) > 0)
    above = np.append(np.arange(len(t.head)), 0)[t.up] if len(t.head) else t.up
    has_up, verb, conj = t.up >= 0, upos(("VERB",)), t.is_rel("conj")
    rel = lambda *names: t.deprel.among(names)
    adj, root = upos(("ADJ",)), t.head == 0
    joined = np.bincount(t.up[conj & has_up], minlength=len(t.head))
    word = ~upos(("PUNCT", "SYM"))
    places = np.flatnonzero(word)
    lead = places[np.unique(t.sent[places], return_index=True)[1]]
    leads, firsts = np.zeros(len(t.head), bool), t.id == 1
    leads[lead] = True
    parts = [
        here(upos(("ADJ", "ADV")) & rel("amod", "advmod", "root", "conj") & (joined >= 2)) > 0,
        both(rel("conj"), low(("but",))) & both(low(("not", "neither")), low(PARALLEL)),
        here(verb & rel("advcl", "acl") & low(EDITORIAL)) > 0,
        both(verb & low(COPULA), low(("as",))),
        both(verb & low(LIGHT), low(ROLES)),
        both(adj & low(IMPORTANT), low(("it",))),
        here(root & upos(("NOUN",)) & low(SETUP)) > 0,
        here(rel("advmod") & low(SOFTENERS) & has_up & adj[above]) > 0,
        here(t.is_rel("compound")) >= 3,
        both(verb & low(LIGHT_VERBS), low(DEVERBAL)),
        both(low(HEDGE_VERBS), low(HEDGE_MODALS)),
        (here(word) <= 4) & (here(leads & low(TRANSITION_LEADS)) > 0) & (here(root & ~upos(("VERB", "AUX"))) > 0),
        here(firsts & low(WH) & has_up & verb[above] & root[above]) > 0,
        here(t.is_rel("nsubj") & upos(("PRON",)) & low(BACK_REFERENCES) & has_up & rel("conj", "parataxis")[above]) > 0,
        here(rel("nsubj:pass") & has_up & verb[above]) > 0,
    ]
    bare = here(leads & low(BARE) & (t.is_rel("nsubj") | rel("expl"))) > 0
    return np.logical_or.reduce([*parts, bare])


class Signs:
    """A task's look: the sentences in which a rule may find something, and the last before each that fit a pronoun."""

    def __init__(self):
        self.offers = Offers()

    def __call__(self, b: Block) -> pa.RecordBatch:
        offers, some = self.offers(b), np.flatnonzero(may_find(b.trees, len(b.sents)))
        rows = shallow._as_rows(b).take(pa.array(some))
        last = [pa.array(x[some], pa.int32(), mask=x[some] < 0) for _, x in offers]
        names = ["doc_id", "sent_idx", "start", "end", "text", "tokens"]
        return pa.RecordBatch.from_arrays([rows.column(k) for k in names] + last, [*names, "one", "many"])


def signs_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> sentences of their shallow parses that may have a sign, found in the pass that parses them."""
    return shallow.looked(docs, Signs, f"doc_id {dict(docs.dtypes)['doc_id']}, {SIGNS}")


def _passive(n: Column) -> Column:
    """Passives without an agent: (verb, subject, at: the subject's start, span)."""
    subject = lambda v: F.get(those(n, v, lambda c: (c["deprel"] == "nsubj:pass")), F.lit(0))
    test = lambda v: (v["upos"] == "VERB") & subject(v).isNotNull() & some(n, v, lambda c: c["deprel"] == "aux:pass") & ~((v["low"] == "made") & (subject(v)["low"] == "it")) & ~((v["low"] == "used") & some(n, v, lambda c: c["deprel"].isin("xcomp", "advcl"))) & ~some(n, v, lambda c: c["deprel"].isin("obl:agent", "nmod:agent"))
    return F.transform(F.filter(n, lambda v: F.coalesce(test(v), F.lit(False))), lambda v: F.struct(v["low"].alias("verb"), subject(v)["low"].alias("subject"), subject(v)["start"].alias("at"), span_of(subtree(n, v)).alias("span")))


def _near(low: Column, start: Column) -> Column:
    """Is it a pronoun that may mean something in its own sentence or the two before?"""
    return F.coalesce(low.isin(SINGULAR + PLURAL) & (_distance(low, start) <= 2), F.lit(False))


def _passive_grade(verb: Column, subject: Column) -> Column:
    return F.when(verb.isin(ACCOUNTABLE) & (subject != "you"), "medium").otherwise("low")


def passives(pathed: DataFrame) -> DataFrame:
    """Passives without an agent; low unless the verb is one of accountability and the subject is not "you"."""
    s = pathed.select("doc_id", "sent_idx", _passive(F.col("nodes")).alias("passive"), *(c.alias(k) for k, c in _references(F.col("nodes")).items())).withColumns(_last_fitting())
    v = s.withColumn("f", F.explode_outer("passive")).where("f is not null")
    v = v.where(F.col("f.verb").isin(ACCOUNTABLE) | ~_near(F.col("f.subject"), F.col("f.at")))
    return v.select("doc_id", "sent_idx", F.lit("passive-actor-hiding").alias("rule"), "f.span.start", "f.span.end", _passive_grade(F.col("f.verb"), F.col("f.subject")).alias("confidence"))


#: Sentences in a row with a bare opener that make a finding.
RUN = 3


def _opens_bare(n: Column) -> Column:
    first = F.get(F.filter(n, lambda t: ~t["upos"].isin("PUNCT", "SYM")), F.lit(0))
    return first["low"].isin(BARE) & (is_rel(first, "nsubj") | (first["deprel"] == "expl"))


def _bare_island() -> dict[str, Column]:
    """Sentences in a row share what their ordinal is ahead of the number of bare ones up to them; null for others."""
    upto = Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, 0)
    return {"island": F.when(F.col("bare"), F.col("sent_idx") - F.count_if(F.col("bare")).over(upto))}


def _bare_run() -> dict[str, Column]:
    w = Window.partitionBy("doc_id", "island")
    return {"run_place": F.row_number().over(w.orderBy("sent_idx")), "run_n": F.count(F.lit(1)).over(w), "run_start": F.min("start").over(w), "run_end": F.max("end").over(w)}


def bare_openers(pathed: DataFrame, least: int = RUN) -> DataFrame:
    """Runs of sentences that open with a bare pronoun as subject (gaps and islands)."""
    s = pathed.select("doc_id", "sent_idx", "start", "end", F.coalesce(_opens_bare(F.col("nodes")), F.lit(False)).alias("bare")).where("bare")
    runs = s.withColumns(_bare_island()).groupBy("doc_id", "island").agg(F.min("sent_idx").alias("sent_idx"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= least).select("doc_id", "sent_idx", F.lit("referential-compression").alias("rule"), "start", "end", F.lit("low").alias("confidence"))
