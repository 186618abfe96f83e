"""A shallow parser: parts of speech by word lists and endings, heads by the nearest word that can take a word.

It stands in where no trained parser is at hand, so that operators on trees can go over whole corpora; its trees are
valid and repeatable, and no more true than its rules.  A sentence's tree is found in one pass to the right and one
to the left, so its cost grows with its length; all verbs hang from the first, which keeps trees of long lines low.
``parse_text`` goes token by token; a task goes over the tokens of many sentences at once, with the same trees.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from proselake.functions.places import WHITE_SIGNS, cut_paragraphs, cut_sentences
from proselake.operators.trees import Block, Coded, Look, Trees, expanded, offsets

CLOSED = {
    "DET": "a an the this that these those each every some any no der die das ein eine le la les un une el los las".split(),
    "PRON": "i you he she it we they them us him her who what which ich er sie es wir il elle nous vous ils yo ella".split(),
    "ADP": "of in on at by with from for to as into over under about von mit auf bei aus de du en dans pour par sur con por para".split(),
    "CCONJ": "and or but nor und oder aber et ou mais y o pero".split(),
    "SCONJ": "because if when while although unless whether weil wenn dass que quand si cuando".split(),
    "AUX": "is are was were be been being am will would can could may might must shall should do does did has have had ist sind war est sont es son fue".split(),
    "ADV": "not never also only just then now here there very too nicht auch nur ne pas aussi no ya muy".split(),
}
#: Endings by part of speech, for words of more than three letters; the first that fits counts.
ENDINGS = [("ADV", "ly|ment"), ("VERB", "ing|ed|en|er|ir|ar|ez|ons|ate|ify|ise|ize"), ("ADJ", "ous|ful|ive|able|ible|al|ic|less|ish|ig|lich|eux|oso|osa")]
NOMINAL = ("NOUN", "PROPN", "PRON")
WORD_OR_SIGN = r"[^\W_]+(?:['’][^\W_]+)*|[^" + WHITE_SIGNS + "]"
TREE = "array<struct<id:int,form:string,upos:string,head:int,deprel:string,start:int,end:int>>"
SENTENCE = f"array<struct<sent_idx:int,par_idx:int,start:int,end:int,par_start:int,par_end:int,text:string,tokens:{TREE}>>"

_TOKEN = re.compile(WORD_OR_SIGN)
_LISTED = {w: tag for tag, words in reversed(CLOSED.items()) for w in words}
_SPLIT = re.compile(f"({WORD_OR_SIGN})")
_ENDING = [(tag, tuple(ends.split("|"))) for tag, ends in ENDINGS]
_INT = pa.int32()
_TREE = pa.list_(pa.struct([("id", _INT), ("form", pa.string()), ("upos", pa.string()), ("head", _INT), ("deprel", pa.string()), ("start", _INT), ("end", _INT)]))
_SENTENCE = pa.list_(pa.struct([("sent_idx", _INT), ("par_idx", _INT), ("start", _INT), ("end", _INT), ("par_start", _INT), ("par_end", _INT), ("text", pa.string()), ("tokens", _TREE)]))
_TOKEN_FIELDS = [f.name for f in _TREE.value_type]
_SENTENCE_FIELDS = [f.name for f in _SENTENCE.value_type][:-1]


@functools.lru_cache(maxsize=100_000)
def tag(form: str, first: bool) -> str:
    low = form.lower()
    if low in _LISTED:
        return _LISTED[low]
    if not form[0].isalnum():
        return "PUNCT"
    if form[0].isdecimal():
        return "NUM"
    if len(low) > 3:
        for name, ending in _ENDING:
            if low.endswith(ending):
                return name
    return "PROPN" if not first and "A" <= form[0] <= "Z" else "NOUN"


def heads(tags: list[str]) -> list[tuple[int, str]]:
    """(head, relation) of each token, ids from 1; the root is the first verb, else the first noun, else the first token."""
    n = len(tags)
    first = lambda kinds: next((i + 1 for i, t in enumerate(tags) if t in kinds), 0)
    root = first(("VERB",)) or first(NOMINAL) or 1
    next_verb, next_noun, verb, noun = [0] * n, [0] * n, 0, 0
    for i in range(n - 1, -1, -1):
        next_verb[i], next_noun[i] = verb, noun
        if tags[i] == "VERB":
            verb = i + 1
        elif tags[i] in NOMINAL:
            noun = i + 1
    out, verb, noun, joined, led = [], 0, 0, 0, 0
    for i, t in enumerate(tags):
        content, nv, nn = max(verb, noun), next_verb[i], next_noun[i]
        if i + 1 == root:
            arc = (0, "root")
        elif t in NOMINAL:
            if joined > content and noun:
                arc = (noun, "conj")
            elif led > content and content:
                arc = (content, "obl" if content == verb else "nmod")
            elif verb:
                arc = (verb, "obj")
            else:
                arc = (nv, "nsubj") if nv else (root, "nmod")
        elif t == "VERB":
            arc = (root, "conj" if joined > content else "advcl")
        elif t in ("DET", "ADJ", "NUM", "ADP"):
            arc = (nn or root, {"DET": "det", "ADJ": "amod", "NUM": "nummod", "ADP": "case"}[t])
        elif t == "CCONJ":
            ahead = [k for k in (nv, nn) if k]
            arc = (min(ahead) if ahead else root, "cc")
        elif t in ("AUX", "SCONJ"):
            arc = (nv or root, "aux" if t == "AUX" else "mark")
        elif t == "ADV":
            arc = (nv or verb or root, "advmod")
        else:
            arc = (root, "punct")
        out.append(arc)
        if t == "VERB":
            verb = i + 1
        elif t in NOMINAL:
            noun = i + 1
        elif t == "CCONJ":
            joined = i + 1
        elif t == "ADP":
            led = i + 1
    return out


def parsed_tokens(text: str, at: int) -> list[tuple]:
    """Tokens of a sentence that starts at ``at``, as tuples in order of ``TREE``."""
    found = [(m.group(), m.start() + at, m.end() + at) for m in _TOKEN.finditer(text)]
    tags = [tag(f, i == 0) for i, (f, _, _) in enumerate(found)]
    arcs = heads(tags) if tags else []
    return [(i + 1, f, t, h, r, a, z) for i, ((f, a, z), t, (h, r)) in enumerate(zip(found, tags, arcs, strict=True))]


def parse_sentence(text: str, at: int) -> list[dict]:
    """Tokens of a sentence that starts at ``at``."""
    return [dict(zip(_TOKEN_FIELDS, t, strict=True)) for t in parsed_tokens(text, at)]


def placed_sentences(text: str) -> Iterator[tuple]:
    """(sent_idx, par_idx, start, end, par_start, par_end, text) of each sentence, with the last paragraph that it overlaps."""
    s_text, s_start, s_end = cut_sentences(text)
    _, p_start, p_end = cut_paragraphs(text)
    for i, (t, a, z) in enumerate(zip(s_text, s_start, s_end, strict=True)):
        k = bisect_left(p_start, z) - 1
        held = k >= 0 and k >= bisect_right(p_end, a)
        yield i, k if held else None, a, z, p_start[k] if held else None, p_end[k] if held else None, t


def parse_text(text: str) -> list[dict]:
    """Sentences of a text with their tokens, and the last paragraph that each overlaps."""
    return [{**dict(zip(_SENTENCE_FIELDS, s, strict=False)), "tokens": parse_sentence(s[-1], s[2])} for s in placed_sentences(text)]


KINDS = [*CLOSED, "VERB", "ADJ", "NOUN", "PROPN", "NUM", "PUNCT"]
RELS = ["root", "conj", "obl", "nmod", "obj", "nsubj", "advcl", "det", "amod", "nummod", "case", "cc", "aux", "mark", "advmod", "punct"]
_KIND, _REL = {t: i for i, t in enumerate(KINDS)}, {r: i for i, r in enumerate(RELS)}


def all_tags(form: Coded, at: np.ndarray) -> np.ndarray:
    """``tag`` of each token as its place in KINDS; ``at`` says where sentences begin."""
    out = np.array([_KIND[tag(w, False)] for w in form.values] or [0], np.int8)[form.codes]
    first = at[:-1][np.diff(at) > 0]
    out[first[out[first] == _KIND["PROPN"]]] = _KIND["NOUN"]  # only a capital tells them apart, which a first word has anyway
    return out


def all_heads(tags: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``heads`` of all sentences at once: (head, relation as its place in RELS) of each token."""
    n, counts = len(tags), np.diff(at)
    sent = expanded(counts)
    begin, stop = at[:-1][sent], at[1:][sent]
    here = np.arange(n)
    of = {k: tags == _KIND[k] for k in KINDS}
    noun, verb = of["NOUN"] | of["PROPN"] | of["PRON"], of["VERB"]

    def last(which: np.ndarray) -> np.ndarray:
        """The id of the last such token before each in its sentence, else 0."""
        x = np.empty(n, np.int64)
        x[:1] = -1
        x[1:] = np.maximum.accumulate(np.where(which, here, -1))[:-1]
        return np.where(x >= begin, x - begin + 1, 0)

    def first(which: np.ndarray) -> np.ndarray:
        """Where the first such token from each place on is, n if there is none."""
        return np.append(np.minimum.accumulate(np.where(which, here, n)[::-1])[::-1], n)

    def following(x: np.ndarray) -> np.ndarray:
        return np.where(x[1:] < stop, x[1:] - begin + 1, 0)

    next_v, next_n = first(verb), first(noun)
    nv, nn, v, m = following(next_v), following(next_n), last(verb), last(noun)
    whole, ends = at[:-1], at[1:]
    lead = np.where(next_v[whole] < ends, next_v[whole], np.where(next_n[whole] < ends, next_n[whole], whole)) - whole + 1
    root = lead[sent]
    content, joined, led = np.maximum(v, m), last(of["CCONJ"]), last(of["ADP"])
    after_joint, or_root = joined > content, lambda x: np.where(x > 0, x, root)
    ahead = np.where((nv > 0) & (nn > 0), np.minimum(nv, nn), np.maximum(nv, nn))
    is_root = here - begin + 1 == root
    rules = [  # the first that holds counts
        (is_root, 0, "root"),
        (noun & after_joint & (m > 0), m, "conj"),
        (noun & (led > content) & (content > 0) & (content == v), content, "obl"),
        (noun & (led > content) & (content > 0), content, "nmod"),
        (noun & (v > 0), v, "obj"),
        (noun & (nv > 0), nv, "nsubj"),
        (noun, root, "nmod"),
        (verb & after_joint, root, "conj"),
        (verb, root, "advcl"),
        *((of[k], or_root(nn), r) for k, r in (("DET", "det"), ("ADJ", "amod"), ("NUM", "nummod"), ("ADP", "case"))),
        (of["CCONJ"], or_root(ahead), "cc"),
        (of["AUX"], or_root(nv), "aux"),
        (of["SCONJ"], or_root(nv), "mark"),
        (of["ADV"], np.where(nv > 0, nv, or_root(v)), "advmod"),
    ]
    which = np.full(n, len(rules), np.int8)
    for k in range(len(rules) - 1, -1, -1):
        which[rules[k][0]] = k
    head, rel = root.copy(), np.array([*(_REL[r] for *_, r in rules), _REL["punct"]], np.int8)[which]
    for k, (_, to, _) in enumerate(rules):
        mine = which == k
        head[mine] = to[mine] if isinstance(to, np.ndarray) else to
    return head, rel


def _block(docs: list, nos: list[int], sents: list[tuple], pieces: list[str], counts: list[int], kind: pa.DataType) -> Block:
    """pieces: what stands before the first token, that token, what stands after it, the next one, ... of each sentence."""
    at = offsets(np.array(counts, np.int64))
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    sent = expanded(np.diff(at))
    form = 2 * np.arange(at[-1]) + sent + 1
    before = np.append(0, ends)[2 * at[:-1] + np.arange(len(counts))]  # signs of the sentences before
    shift = (np.array([s[2] for s in sents], np.int64) - before)[sent]
    words = Coded.of(pa.array([pieces[k] for k in form.tolist()], pa.string()))
    tags = all_tags(words, at)
    head, rel = all_heads(tags, at)
    return Block(pa.array(docs, kind), np.array(nos, np.int64), sents, Trees(at, head, ends[form - 1] + shift, ends[form] + shift, words, Coded(tags, KINDS), Coded(rel, RELS)))


def blocks(batches: Iterator[pa.RecordBatch], most: int, whole: bool = False) -> Iterator[Block]:
    """Sentences of the texts (doc_id, text) in order, handed on as soon as they have ``most`` tokens together: with
    ``whole`` only after a text's last one, else whenever a sentence ends."""
    no = 0
    for b in batches:
        kind, held, texts, size = b.schema.field(0).type, ([], [], [], [], []), [], 0
        ready = lambda: replace(_block(*held, kind), **({"texts": pa.array(texts, kind), "first_no": no - len(texts) + 1} if whole else {}))  # noqa: B023, E731
        for doc, value in zip(b.column(0), b.column(1), strict=True):
            doc, no = doc.as_py(), no + 1
            texts.append(doc)
            for s in placed_sentences(value.as_py() or ""):
                pieces = _SPLIT.split(s[-1])
                n = len(pieces) // 2
                for have, new in zip(held, (doc, no, s, pieces, n), strict=True):
                    have.extend(new) if have is held[3] else have.append(new)
                size += n + 1
                if size >= most and not whole:
                    yield ready()
                    held, texts, size = ([], [], [], [], []), [], 0
            if size >= most:
                yield ready()
                held, texts, size = ([], [], [], [], []), [], 0
        if held[0] or whole and texts:
            yield ready()


def _as_rows(b: Block) -> pa.RecordBatch:
    t = b.trees
    cols = {"id": pa.array(t.id, _INT), "form": t.form.array(), "upos": t.upos.array(), "head": pa.array(t.head, _INT), "deprel": t.deprel.array(), "start": pa.array(t.start, _INT), "end": pa.array(t.end, _INT)}
    flat = pa.StructArray.from_arrays([cols[f.name] for f in _TREE.value_type], fields=list(_TREE.value_type))
    tokens = pa.ListArray.from_arrays(pa.array(t.at, _INT), flat)
    placed = [b.column(k, f.type) for k, f in enumerate(list(_SENTENCE.value_type)[:-1])]
    return pa.RecordBatch.from_arrays([b.doc_id, *placed, tokens], ["doc_id", *_SENTENCE_FIELDS, "tokens"])


def _parsed(most: int, look: Callable[[], Look] = lambda: _as_rows, whole: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(look(), blocks(batches, most, whole))

    return run


def parses(docs: DataFrame, most: int = 50_000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, sent_idx, par_idx, start, end, par_start, par_end, text, tokens; a row for each
    sentence.  Null and empty texts give none; repeated rows give theirs again.  A task hands on its sentences as soon as
    they have ``most`` tokens together, so that it holds one text and these, however many texts it goes through."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_parsed(most), f"doc_id {kind}, {SENTENCE[len('array<struct<') : -2]}")


def looked(docs: DataFrame, look: Callable[[], Look], ddl: str, most: int = 50_000, whole: bool = False) -> DataFrame:
    """docs (doc_id, text) -> what a look says of their parses, in the same pass: trees don't leave the task.  Each task
    makes a look of its own, which may carry on from block to block; with ``whole`` it sees texts whole."""
    return docs.select("doc_id", "text").mapInArrow(_parsed(most, look, whole), ddl)
