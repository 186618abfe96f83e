"""The reading trace: what a reader holds in mind, sentence by sentence, as an ordered fold over each document.

A document's parses go through one ``Reader``: things and relations named become frames that fade after two sentences or
are let go at a heading or after a summing-up; promises of later explanation stay open until their topic returns, and
standards of judgment until they are defined.  ``moments`` gives a row for each sentence; the same reader, its state kept
as JSON, reads a stream of sentences (``moments_stream``).  The rules below are column expressions over moments.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from proselake.operators import shallow
from proselake.operators.trees import Block, Trees, expanded, offsets

# Cues, promises and standards, and how long frames last.
CUES = {
    "summary": r"\b(?:in short|in summary|to summarise|to summarize|overall)\b",
    "synthesis": r"\b(?:the result is|the outcome is|this means|taken together)\b",
    "orientation": r"\b(?:at this point|by then|from here|returning to|back to|as (?:noted|described) earlier)\b|^\s*(?:earlier|previously)\b",
}
PROMISE = r"\b(?:(?:we|this (?:section|document|article|guide)) (?:will|shall) (?:explain|describe|define|show|cover|discuss|revisit|address|consider)|(?:explained|described|defined|shown|covered|discussed|addressed) (?:later|below|in (?:the )?following section))\b"
NO_TOPICS = ["article", "document", "guide", "point", "section", "thing"]
STANDARDS = {
    "appropriate": r"\bappropriate(?:ly)?\b", "clear": r"\bclear(?:ly)?\b", "complete": r"\bcomplete(?:ly)?\b", "defensible": r"\bdefensible\b", "enough": r"\benough\b", "material": r"\bmaterial(?:ly)?\b", "reasonable": r"\breasonabl(?:e|y)\b",
    "relevant": r"\brelevan(?:t|ce|cy)\b", "significant": r"\bsignificant(?:ly)?\b", "small": r"\bsmall(?:er|est)?\b", "strong": r"\bstrong(?:er|est)?\b", "sufficient": r"\bsufficient(?:ly)?\b", "suitable": r"\bsuitable\b", "weak": r"\bweak(?:er|est)?\b",
}
DEFINED = r"(?:{0}\s+(?:means|is defined as|refers to)|(?:define|measure|judge|determine|calculate)\s+(?:what counts as\s+)?{0}\s+(?:as|by|using|from)|{0}\s*:)"
MODALS = ["must", "need", "ought", "shall", "should"]
CLAUSES = ["root", "conj", "advcl", "ccomp", "xcomp", "parataxis", "acl"]
IRREGULAR = {"analyses": "analysis", "criteria": "criterion", "indices": "index", "people": "person"}
UNCHANGED = ["series", "species"]
FADE, RETURN = 2, 4

_CUE = {k: re.compile(p, re.I) for k, p in CUES.items()}
_PROMISE = re.compile(PROMISE, re.I)
_STANDARD = {k: (re.compile(p, re.I), re.compile(DEFINED.format(k), re.I)) for k, p in STANDARDS.items()}
_ANY_STANDARD = re.compile("|".join(STANDARDS.values()), re.I)
#: A word of each of these is in whatever the patterns of cues and promises match.
_CUE_WORD = re.compile("short|summar|overall|result|outcome|means|together|point|then|here|returning|back|noted|described|earlier|previously", re.I)
_PROMISE_WORD = re.compile("explain|describe|define|show|cover|discuss|revisit|address|consider", re.I)
_IES, _ES, _FINAL_S = re.compile("[^aeiou]ies$"), re.compile("(?:[sxz]|ch|sh)es$"), re.compile("(?<![sui])s$")
_I, _S = pa.int32(), pa.string()
_GAP = pa.list_(pa.struct([("key", _S), ("gap", _I)]))
_IDEA = pa.list_(pa.struct([("label", _S), ("topics", pa.list_(_S)), ("start", _I), ("sentence", _I)]))
_STAND = pa.list_(pa.struct([("term", _S), ("text", _S), ("start", _I), ("end", _I), ("sentence", _I)]))
_CLAUSE = pa.list_(pa.struct([("predicate", _S), ("subjects", pa.list_(_S)), ("objects", pa.list_(pa.struct([("key", _S), ("role", _S)])))]))
LOAD = ["pushes", "reinforcements", "pops", "reactivations", "entity_frames", "relation_frames", "idea_frames", "standard_frames", "role_changes", "inflow"]
#: A moment, without its document.
MOMENT = pa.schema([
    ("sentence", _I), ("unit", _I), ("start", _I), ("end", _I), ("introduced", pa.list_(_S)), ("reinforced", pa.list_(_S)), ("returned", _GAP), ("new_relations", pa.list_(_S)), ("old_relations", pa.list_(_S)), ("returned_relations", _GAP),
    ("role_changes", pa.list_(pa.struct([("entity", _S), ("from", _S), ("to", _S)]))), ("released", pa.list_(_S)), ("released_relations", pa.list_(_S)), ("ideas", _IDEA), ("standards", _STAND), ("load", pa.struct([(k, _I) for k in LOAD])),
    ("entities", pa.list_(_S)), ("relations", pa.list_(_S)), ("clauses", _CLAUSE), ("names", pa.list_(_S)), ("new_unit", pa.bool_()), ("after_heading", pa.bool_()), ("cues", pa.list_(_S)),
])


@functools.lru_cache(maxsize=100_000)
def entity_key(form: str, upos: str) -> str:
    """Lower case; obvious English plurals of nouns as singular."""
    low = form.lower()
    if upos != "NOUN" or low in UNCHANGED:
        return low
    if low in IRREGULAR:
        return IRREGULAR[low]
    if _IES.search(low):
        return low[:-3] + "y"
    if _ES.search(low):
        return low[:-2]
    return low[:-1] if len(low) > 3 and _FINAL_S.search(low) else low


class Tree:
    """A sentence's tokens with their children by relation."""

    def __init__(self, tokens: list[dict]):
        self.tokens = tokens
        self.by_id = {t["id"]: t for t in tokens}
        self.kids: dict[int, list[dict]] = {}
        self.named: dict[int, list[dict]] = {}
        for t in tokens:
            self.kids.setdefault(t["head"], []).append(t)

    @staticmethod
    def rel(t: dict) -> str:
        return t["deprel"].split(":", 1)[0]

    def joined(self, t: dict) -> list[dict]:
        """t and what hangs from it by chains of conj, level by level."""
        out, met, wave = [], set(), [t]
        while wave:
            out += (fresh := [x for x in wave if x["id"] not in met])
            met |= {x["id"] for x in fresh}
            wave = [k for x in fresh for k in self.kids.get(x["id"], []) if self.rel(k) == "conj"]
        return out

    def taking(self, t: dict, *rels: str) -> list[dict]:
        """Dependents of t in these relations, one relation after the other, each with what is joined to it."""
        return [x for r in rels for k in self.kids.get(t["id"], []) if self.rel(k) == r for x in self.joined(k)]

    def subjects(self, t: dict) -> list[dict]:
        """Subjects of t, or of the nearest verb up a chain of conj that has some."""
        met: set[int] = set()
        while True:
            if t["id"] not in self.named:  # many verbs of a long line go back to the same one
                self.named[t["id"]] = self.taking(t, "nsubj", "csubj")
            if found := self.named[t["id"]]:
                return found
            if met and self.rel(t) != "conj" or t["id"] in met:
                return []
            met.add(t["id"])
            if t["head"] not in self.by_id:
                return []
            t = self.by_id[t["head"]]

    def clauses(self) -> list[tuple[dict, list[dict], list[tuple[dict, str]]]]:
        """(predicate, subjects, objects with their roles) of each clause."""
        roles = {"obj": "object", "iobj": "indirect-object", "obl": "oblique"}
        heads = [t for t in self.tokens if t["upos"] in ("VERB", "AUX") and self.rel(t) in CLAUSES]
        return [(p, self.subjects(p), [(x, name) for r, name in roles.items() for x in self.taking(p, r)]) for p in heads]

    def demands(self) -> bool:
        """Does it say what must be done: a modal at its root, or a verb without subject that comes first?"""
        root = next((t for t in self.tokens if t["head"] == 0), None)
        if root is None:
            return False
        kids = self.kids.get(root["id"], [])
        if any(self.rel(k) == "aux" and k["form"].lower() in MODALS for k in kids):
            return True
        first = next((t for t in self.tokens if t["upos"] != "PUNCT"), None)
        return root["upos"] == "VERB" and not any(self.rel(k) in ("nsubj", "csubj") for k in kids) and first is root


@dataclass
class Frames:
    """Keys in mind with the sentence they were last named in, and all keys ever named."""

    held: dict[str, int] = field(default_factory=dict)
    last: dict[str, int] = field(default_factory=dict)

    def let_go(self, at: int, every: bool) -> list[str]:
        gone = [k for k, i in self.held.items() if every or at - i > FADE]
        for k in gone:
            del self.held[k]
        return gone

    def name(self, keys: list[str], at: int) -> tuple[int, int, list[tuple[str, int, bool]]]:
        """How many of these keys are pushed and how many reinforced, one after the other; and those that were named before,
        with the sentences since, and whether that reactivates them."""
        held, last, pushes, kept, back = self.held, self.last, 0, 0, []
        for key in keys:
            if (before := last.get(key)) is None:
                pushes += 1
            else:
                kept += (holds := key in held)
                back.append((key, at - before - 1, not holds))
            held[key] = last[key] = at
        return pushes, kept, back


@dataclass
class Said:
    """What a sentence's part in its unit says: keys of its nouns; of each clause predicate, subjects, and objects with
    roles; names; words of judgment, if it says what must be done.  The flags tell whether a pattern may match in it."""

    nouns: list[str]
    spoken: list[tuple[str, list[str], list[tuple[str, str]]]]
    names: list[str]
    judged: list[tuple[str, int, int]]
    valued: bool = True
    promising: bool = True
    cued: bool = True


@dataclass
class Reader:
    """The state between two sentences of a document."""

    things: Frames = field(default_factory=Frames)
    relations: Frames = field(default_factory=Frames)
    roles: dict[str, str] = field(default_factory=dict)
    ideas: list[dict] = field(default_factory=list)
    standards: dict[str, dict] = field(default_factory=dict)
    defined: list[str] = field(default_factory=list)
    unit: int | None = None
    end: int | None = None
    cues: list[str] = field(default_factory=list)

    def save(self) -> str:
        return json.dumps({**self.__dict__, "things": self.things.__dict__, "relations": self.relations.__dict__})

    @classmethod
    def load(cls, saved: str) -> Reader:
        d = json.loads(saved)
        return cls(**{**d, "things": Frames(**d["things"]), "relations": Frames(**d["relations"])})

    def read(self, s: dict) -> dict | None:
        """Takes in a sentence (sent_idx, par_idx, start, end, par_start, par_end, text, tokens, headings: ends of headings
        before it) and gives its moment; a sentence outside all units is passed over."""
        if s["par_idx"] is None:
            return None
        start, end = unit_part(s["start"], s["end"], s["par_start"], s["par_end"])
        tree = Tree(s["tokens"])
        mine = [t for t in tree.tokens if t["start"] >= start and t["end"] <= end]
        key = lambda t: entity_key(t["form"], t["upos"])
        clauses = [c for c in tree.clauses() if c[0]["start"] >= start and c[0]["end"] <= end]
        said = Said(
            [key(t) for t in mine if t["upos"] in ("NOUN", "PROPN")],
            [(key(p), [key(x) for x in subj], [(key(x), r) for x, r in obj]) for p, subj, obj in clauses],
            [t["form"].lower() for t in mine if t["upos"] == "PROPN"],
            [(t["form"], t["start"], t["end"]) for t in mine if t["upos"] in ("ADJ", "ADV") and _ANY_STANDARD.search(t["form"])] if tree.demands() else [],
        )
        heading = self.end is not None and any(a >= self.end and z <= s["start"] for a, z in s.get("headings") or [])
        return self.take(s["sent_idx"], s["par_idx"], start, end, s["text"][start - s["start"] : end - s["start"]], said, heading)

    def open(self, at: int, start: int, text: str, keys: list[str], said: Said) -> tuple[int, int]:
        """Opens and closes standards and promises; how many of both."""
        pushes = pops = 0
        valued = said.valued and _ANY_STANDARD.search(text) is not None
        for term, (use, definition) in _STANDARD.items() if valued else ():
            if use.search(text) and definition.search(text):
                self.defined.append(term) if term not in self.defined else None
                pops += self.standards.pop(term, None) is not None
        for form, a, z in said.judged:
            term = next((k for k, (use, _) in _STANDARD.items() if use.search(form)), None)
            if term and term not in self.defined and term not in self.standards:
                self.standards[term] = {"term": term, "text": form, "start": a, "end": z, "sentence": at}
                pushes += 1
        if self.ideas:
            still = [i for i in self.ideas if i["sentence"] == at or not set(i["topics"]) & set(keys)]
            pops += len(self.ideas) - len(still)
            self.ideas = still
        if said.promising and _PROMISE.search(text):
            self.ideas.append({"label": text.strip(), "topics": [k for k in keys if k not in NO_TOPICS], "start": start, "sentence": at})
            pushes += 1
        return pushes, pops

    def take(self, at: int, unit: int, start: int, end: int, text: str, said: Said, heading: bool = False, only: list[str] | None = None) -> dict:
        """The moment of what a sentence's part in its unit says; ``only`` names the fields to give."""
        every = heading or bool(self.cues)
        released, released_relations = self.things.let_go(at, every), self.relations.let_go(at, every)

        keys = list(dict.fromkeys(k for k in said.nouns if k))
        pushes, pops = self.open(at, start, text, keys, said)
        pops += len(released) + len(released_relations)

        new = [k for k in keys if k not in self.things.last]
        new_things, kept_things, things = self.things.name(keys, at)
        changes, relations, roles = [], [], self.roles
        for predicate, subjects, objects in said.spoken:
            for who in subjects:
                if (old := roles.get(who)) and old != "subject":
                    changes.append((who, old, "subject"))
                roles[who] = "subject"
            for who, role in objects:
                if (old := roles.get(who)) and old != role:
                    changes.append((who, old, role))
                roles[who] = role
            if subjects:
                told = [f"->{predicate}->{y}" for y, _ in objects] or [f"->{predicate}"]
                relations += [x + o for x in subjects for o in told]
        fresh = [r for r in relations if r not in self.relations.last]
        new_keys, fresh_keys = set(new), set(fresh)  # a long line has many thousand relations
        new_told, kept_told, back = self.relations.name(relations, at)
        pushes, again = pushes + new_things + new_told, sum(a for *_, a in things) + sum(a for *_, a in back)
        cues = [k for k, p in _CUE.items() if p.search(text)] if said.cued else []
        fields = {
            "sentence": lambda: at, "unit": lambda: unit, "start": lambda: start, "end": lambda: end, "introduced": lambda: new, "reinforced": lambda: [k for k in keys if k not in new_keys],
            "returned": lambda: [{"key": k, "gap": g} for k, g, _ in things if g + 1 >= RETURN], "new_relations": lambda: fresh, "old_relations": lambda: [r for r in relations if r not in fresh_keys],
            "returned_relations": lambda: [{"key": r, "gap": g} for r, g, a in back if a], "role_changes": lambda: [{"entity": who, "from": old, "to": role} for who, old, role in changes], "released": lambda: released, "released_relations": lambda: released_relations,
            "ideas": lambda: [dict(i) for i in self.ideas], "standards": lambda: [dict(x) for x in self.standards.values()],
            "load": lambda: dict(zip(LOAD, (pushes, kept_things + kept_told, pops, again, len(self.things.held), len(self.relations.held), len(self.ideas), len(self.standards), len(changes), pushes + again - pops), strict=True)),
            "entities": lambda: list(self.things.held), "relations": lambda: list(self.relations.held),
            "clauses": lambda: [{"predicate": p, "subjects": subj, "objects": [{"key": x, "role": r} for x, r in obj]} for p, subj, obj in said.spoken],
            "names": lambda: said.names, "new_unit": lambda: self.unit is not None and self.unit != unit, "after_heading": lambda: heading, "cues": lambda: cues,
        }
        out = {k: fields[k]() for k in only or fields}
        self.unit, self.end, self.cues = unit, end, cues
        return out


def unit_part(start: int, end: int, par_start: int, par_end: int) -> tuple[int, int]:
    """The part of a sentence that lies in its unit."""
    return max(start, par_start), min(end, par_end)


def _plain(values: pa.Array) -> list:
    return values.to_pylist() if values.null_count or not pa.types.is_integer(values.type) else values.to_numpy().tolist()


def _sentences(rows: pa.Table) -> list[dict]:
    """Rows of parses as dicts: ``to_pylist``, field by field, as going through each token's struct takes longer than reading."""
    tokens = rows.column("tokens").combine_chunks()
    flat = tokens.flatten()
    names = [f.name for f in flat.type]
    every = [dict(zip(names, t, strict=True)) for t in zip(*(_plain(c) for c in flat.flatten()), strict=True)]
    out, at = rows.drop_columns("tokens").to_pylist(), 0
    for s, n in zip(out, pc.list_value_length(tokens).to_pylist(), strict=True):
        s["tokens"] = every[at : at + (n or 0)]
        at += n or 0
    return out


SENTENCE_FIELDS = ["sent_idx", "par_idx", "start", "end", "par_start", "par_end", "text", "tokens"]


def _ddl(only: pa.Schema = MOMENT) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema

    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in from_arrow_schema(only).fields)


def moments(parses: DataFrame, only: list[str] | None = None) -> DataFrame:
    """parses (doc_id, sent_idx, par_idx, start, end, par_start, par_end, text, tokens, and headings, an array of (start, end)
    pairs, where there are some) -> doc_id and a moment for each sentence that lies in a paragraph, in one pass over
    each document's sentences in order.  A document is a group, as large as its own sentences; sentences with equal
    ordinals are read in order of their start.  ``only`` names the fields to give, as most of a moment's room is in its lists."""
    told = pa.schema(told_fields(only))
    columns = ["doc_id", *SENTENCE_FIELDS, *(["headings"] if "headings" in parses.columns else [])]
    kind = dict(parses.dtypes)["doc_id"]
    out = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.string()), *told])

    def read(sentences: pa.Table) -> pa.Table:
        reader, rows = Reader(), []
        for s in sorted(_sentences(sentences), key=lambda s: (s["sent_idx"], s["start"])):
            if m := reader.read(s):
                rows.append({"doc_id": s["doc_id"], **{k: m[k] for k in told.names}})
        return pa.Table.from_pylist(rows, out)

    # As many partitions as there are shuffle partitions, and two for each core: reading takes far longer than its bytes tell.
    spark = parses.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return parses.select(*columns).repartition(n, "doc_id").groupBy("doc_id").applyInArrow(read, f"doc_id {kind}, {_ddl(told)}")


def _roles(t: Trees) -> tuple[dict[int, list[int]], dict[int, list[tuple[int, str]]]]:
    """Subjects and objects with their roles of each token that has some, each with what is joined to it, as ``Tree`` has them."""
    conj: dict[int, list[int]] = {}
    for head, kid in zip(*(x.tolist() for x in t.kids(t.is_rel("conj"))), strict=True):
        conj.setdefault(head, []).append(kid)

    def joined(i: int) -> list[int]:
        if i not in conj:
            return [i]
        out, met, wave = [], set(), [i]
        while wave:
            out += (fresh := [x for x in wave if x not in met])
            met |= set(fresh)
            wave = [k for x in fresh for k in conj.get(x, ())]
        return out

    subjects, objects = {}, {}
    for rel, role in (("nsubj", None), ("csubj", None), ("obj", "object"), ("iobj", "indirect-object"), ("obl", "oblique")):
        for head, kid in zip(*(x.tolist() for x in t.kids(t.is_rel(rel))), strict=True):
            if role is None:
                subjects.setdefault(head, []).extend(joined(kid))
            else:
                objects.setdefault(head, []).extend((x, role) for x in joined(kid))
    return subjects, objects


def _takers(t: Trees, subjects: dict[int, list[int]]) -> np.ndarray:
    """For each token the one whose subjects it takes: itself, or the nearest up a chain of conj that has some; -1 if none has."""
    has, chain, to = np.zeros(len(t.head), bool), t.is_rel("conj"), np.arange(len(t.head))
    has[list(subjects)] = True
    going = np.flatnonzero(~has)  # any token goes up once, as in ``Tree.subjects``, and further only from a conj
    for _ in range(int(t.counts.max(initial=0))):
        to[going] = t.up[to[going]]
        going = going[to[going] >= 0]
        going = going[~has[to[going]]]
        over = ~chain[to[going]]
        to[going[over]] = -1
        going = going[~over]
        if not len(going):
            break
    to[going] = -1  # round and round
    return to


def keyed(t: Trees, some: np.ndarray) -> tuple[list[str], list[int]]:
    """Different keys, and the place among them of ``entity_key`` of each of some tokens."""
    n = len(t.upos.values)
    pairs, at = np.unique(t.form.codes[some].astype(np.int64) * n + t.upos.codes[some], return_inverse=True)
    keys = [entity_key(t.form.values[p // n], t.upos.values[p % n]) for p in pairs.tolist()]
    place = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    return list(place), np.array([place[k] for k in keys], np.int64)[at].tolist() if keys else []


@functools.lru_cache(maxsize=100_000)
def _hints(form: str) -> int:
    """Bits of the patterns that may match where this word is: standards, promises, cues."""
    return sum(1 << k for k, p in enumerate((_ANY_STANDARD, _PROMISE_WORD, _CUE_WORD)) if p.search(form))


def _parts(b: Block) -> tuple[list[bool], np.ndarray, np.ndarray]:
    """Which sentences lie in a unit, and where the part of each that does begins and ends; 0 and -1 for others."""
    inside = [s[1] is not None for s in b.sents]
    parts = np.array([unit_part(s[2], s[3], s[4], s[5]) if y else (0, -1) for s, y in zip(b.sents, inside, strict=True)], np.int64).reshape(-1, 2)
    return inside, parts[:, 0], parts[:, 1]


def read_block(b: Block) -> Iterator[tuple[int, tuple]]:
    """What ``Reader.take`` takes of each sentence of a block that lies in a unit, with its place in the block."""
    t, (inside, start, end) = b.trees, _parts(b)
    mine = (t.start >= start[t.sent]) & (t.end <= end[t.sent])
    words, code = keyed(t, np.arange(len(t.head)))
    keys, low = [words[c] for c in code], t.low
    subjects, objects = _roles(t)
    taker = _takers(t, subjects).tolist()
    clause = t.upos.among(("VERB", "AUX")) & t.deprel.told(lambda r: r.split(":", 1)[0] in CLAUSES)

    def by_sentence(which: np.ndarray) -> tuple[list[int], list[int]]:
        found = np.flatnonzero(which)
        return found.tolist(), np.searchsorted(found, t.at).tolist()

    hints = t.form.told(_hints, np.int8)
    any_of = lambda bit: (np.bincount(t.sent[hints & bit > 0], minlength=len(b.sents)) > 0).tolist()
    nouns, noun_at = by_sentence(mine & t.upos.among(("NOUN", "PROPN")))
    preds, pred_at = by_sentence(mine & clause)
    names, name_at = by_sentence(mine & t.upos.among(("PROPN",)))
    judged, judged_at = by_sentence(mine & t.upos.among(("ADJ", "ADV")) & (hints & 1 > 0))
    flags = zip(any_of(1), any_of(2), any_of(4), strict=True)
    starts, ends, form, lows = start.tolist(), end.tolist(), t.form, low.values
    for k, (s, f) in enumerate(zip(b.sents, flags, strict=True)):
        if not inside[k]:
            continue
        spoken = []
        for p in preds[pred_at[k] : pred_at[k + 1]]:
            spoken.append((keys[p], [keys[x] for x in subjects.get(taker[p], ())], [(keys[x], r) for x, r in objects.get(p, ())]))
        words = judged[judged_at[k] : judged_at[k + 1]]
        said = Said(
            [keys[i] for i in nouns[noun_at[k] : noun_at[k + 1]]], spoken, [lows[form.codes[i]] for i in names[name_at[k] : name_at[k + 1]]],
            [(form.values[form.codes[i]], int(t.start[i]), int(t.end[i])) for i in words] if words and Tree(_as_tokens(t, k)).demands() else [], *f,
        )
        yield k, (s[0], s[1], starts[k], ends[k], s[6][starts[k] - s[2] : ends[k] - s[2]], said)


def _named(key: np.ndarray, row: np.ndarray, times: np.ndarray, at: np.ndarray, gone: np.ndarray, release: np.ndarray, stop: np.ndarray) -> dict[str, np.ndarray]:
    """What ``Frames`` do in each row of some texts: key, of one text, is named ``times`` in row; in order of both, a pair once.
    For each row, at is its ordinal, gone counts the rows up to it that let go everything, release is the first row after it
    that lets go what was last named in it (the number of rows if there is none), and stop where its text ends."""
    n = len(at)
    count = lambda rows, weights=None: np.bincount(rows, weights, minlength=n + 1)[:n].astype(np.int64)
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    before, following = np.roll(row, 1), np.where(np.roll(again, -1), np.roll(row, -1), n)
    gap = at[row] - at[before]
    held = again & (gap <= FADE) & (gone[row] == gone[before])
    release = release[row]
    ends = np.minimum(np.minimum(release, following), stop[row])
    return {
        "push": count(row[~again]), "reinforce": count(row[held]) + count(row, times - 1), "reactivate": count(row[again & ~held]), "new": count(row, np.where(again, 0, times)),
        "old": count(row[again]), "returned": count(row[again & (gap >= RETURN)]), "released": count(release[release <= following]), "frames": np.cumsum(count(row) - count(ends)),
    }


def _as_tokens(t: Trees, k: int) -> list[dict]:
    at = range(int(t.at[k]), int(t.at[k + 1]))
    return [{"id": int(t.id[i]), "form": t.form.values[t.form.codes[i]], "upos": t.upos.values[t.upos.codes[i]], "head": int(t.head[i]), "deprel": t.deprel.values[t.deprel.codes[i]], "start": int(t.start[i]), "end": int(t.end[i])} for i in at]


class Reading:
    """A task's look: reads its texts one after the other, from block to block, and gives the fields of ``only`` of each
    moment, ``sized`` ones as their lengths."""

    def __init__(self, only: list[str], sized: tuple[str, ...] = ()):
        self.only, self.sized, self.no, self.reader = only, sized, None, Reader()

    def moments(self, b: Block) -> Iterator[tuple[int, dict]]:
        no = b.text_no.tolist()
        for k, told in read_block(b):
            if no[k] != self.no:
                self.no, self.reader = no[k], Reader()
            yield k, self.reader.take(*told, only=self.only)

    def __call__(self, b: Block) -> pa.RecordBatch:
        at, rows = [], []
        for k, m in self.moments(b):
            at.append(k)
            rows.append(m)
        size = lambda c: pa.array([len(m[c]) for m in rows], _I)
        cols = [size(f.name) if f.name in self.sized else pa.array([m[f.name] for m in rows], f.type) for f in told_fields(self.only)]
        return pa.RecordBatch.from_arrays([b.doc_id.take(pa.array(at, pa.int64())), *cols], ["doc_id", *(f.name for f in told_fields(self.only))])


class Loads:
    """A task's look, for blocks of whole texts: the lengths of a moment's lists and its load, as ``Reading`` gives them, counted
    over all sentences of a block at once; only promises and standards are followed one by one."""

    SIZED = ("introduced", "reinforced", "returned", "new_relations", "returned_relations", "released")
    ONLY = ["sentence", "unit", "start", "end", *SIZED, "load", "new_unit", "cues"]

    def __call__(self, b: Block) -> pa.RecordBatch:
        t, (inside, start, end) = b.trees, _parts(b)
        rows = np.flatnonzero(inside)
        if not len(rows):
            return Reading(self.ONLY, self.SIZED)(b)
        n, row_of = len(rows), np.cumsum(inside) - 1  # only asked of sentences in a unit
        text = b.text_no[rows]
        stop = np.searchsorted(text, text, "right")
        at, unit = (np.array([b.sents[k][c] for k in rows.tolist()], np.int64) for c in (0, 1))
        mine = (t.start >= start[t.sent]) & (t.end <= end[t.sent])
        words, code = keyed(t, np.arange(len(t.head)))
        code = np.array(code, np.int64)
        key = np.where(np.array([w != "" for w in [*words, ""]])[code], code, -1) if len(code) else code

        # Things: a pair of key and row once.
        noun = np.flatnonzero(mine & t.upos.among(("NOUN", "PROPN")) & (key >= 0))
        width = max(len(words), 1)
        pairs = np.unique((b.text_no[t.sent[noun]] * width + key[noun]) * n + row_of[t.sent[noun]])
        thing, thing_row = pairs // n, pairs % n
        by_row = np.argsort(thing_row, kind="stable")
        keys_of, key_at = (thing[by_row] % width).tolist(), np.searchsorted(thing_row[by_row], np.arange(n + 1)).tolist()

        cues, opened = self._one_by_one(b, rows, start, end, mine, words, keys_of, key_at)
        said_cue = np.array([bool(c) for c in cues], bool)
        first = np.ones(n, bool)
        first[1:] = text[1:] != text[:-1]
        every = np.append(False, said_cue[:-1])[:n] & ~first
        gone = np.cumsum(every)
        # The first row after each, in its text, that lets go everything or lies more than FADE sentences on.
        upcoming = np.append(np.minimum.accumulate(np.where(every, np.arange(n), n)[::-1])[::-1], n)[1:]
        place = text * (at.max(initial=0) + FADE + 2) + at
        release = np.minimum(upcoming, np.searchsorted(place, place + FADE, "right"))
        release = np.where(release < stop, release, n)
        things = _named(thing, thing_row, np.ones(len(thing), np.int64), at, gone, release, stop)

        relations, changes = self._spoken(t, mine, code, width, b.text_no, row_of, n)
        told = _named(*relations, at, gone, release, stop)
        started, closed, ideas, standards = (np.array(x, np.int64) for x in zip(*opened, strict=True)) if opened else [np.zeros(0, np.int64)] * 4
        pushes, again = started + things["push"] + told["push"], things["reactivate"] + told["reactivate"]
        pops = closed + things["released"] + told["released"]
        load = dict(zip(LOAD, (pushes, things["reinforce"] + told["reinforce"], pops, again, things["frames"], told["frames"], ideas, standards, changes, pushes + again - pops), strict=True))
        new_unit = np.append(False, unit[1:] != unit[:-1])[:n] & ~first
        out = {
            "sentence": at, "unit": unit, "start": start[rows], "end": end[rows], "introduced": things["push"], "reinforced": things["old"], "returned": things["returned"],
            "new_relations": told["new"], "returned_relations": told["reactivate"], "released": things["released"], "new_unit": new_unit,
        }
        cols = [pa.array(out[f.name], pa.bool_() if f.name == "new_unit" else _I) if f.name in out else pa.array(cues, f.type) if f.name == "cues" else pa.StructArray.from_arrays([pa.array(load[k], _I) for k in LOAD], LOAD) for f in told_fields(self.ONLY)]
        return pa.RecordBatch.from_arrays([b.doc_id.take(pa.array(rows)), *cols], ["doc_id", *(f.name for f in told_fields(self.ONLY))])

    def _one_by_one(self, b: Block, rows, start, end, mine, words: list[str], keys_of: list[int], key_at: list[int]) -> tuple[list[list[str]], list[tuple[int, int, int, int]]]:
        """Cues of each row; and standards and promises opened, closed and open in it, promises and standards apart."""
        t, hints = b.trees, b.trees.form.told(_hints, np.int8)
        flags = np.bitwise_or.reduceat(np.append(hints, 0), t.at[:-1]) * (t.counts > 0) if len(b.sents) else np.zeros(0, np.int8)
        judging = np.flatnonzero(mine & t.upos.among(("ADJ", "ADV")) & (hints & 1 > 0))
        judged_at = np.searchsorted(judging, t.at).tolist()
        no, reader, cues, opened = None, Reader(), [], []
        for r, (k, bits, text_no, a, z) in enumerate(zip(rows.tolist(), flags[rows].tolist(), b.text_no[rows].tolist(), start[rows].tolist(), end[rows].tolist(), strict=True)):
            if text_no != no:
                no, reader = text_no, Reader()
            pushes = pops = 0
            found: list[str] = []
            if bits or reader.ideas:
                s = b.sents[k]
                text = s[6][a - s[2] : z - s[2]]
                if bits & 4:
                    found = [c for c, p in _CUE.items() if p.search(text)]
                if bits & 3 or reader.ideas:
                    here = judging[judged_at[k] : judged_at[k + 1]].tolist()
                    judged = [(t.form.values[t.form.codes[i]], int(t.start[i]), int(t.end[i])) for i in here] if here and Tree(_as_tokens(t, k)).demands() else []
                    said = Said([], [], [], judged, bool(bits & 1), bool(bits & 2))
                    pushes, pops = reader.open(s[0], a, text, [words[c] for c in keys_of[key_at[r] : key_at[r + 1]]], said)
            cues.append(found)
            opened.append((pushes, pops, len(reader.ideas), len(reader.standards)))
        return cues, opened

    @staticmethod
    def _spoken(t: Trees, mine, code, width: int, text_no, row_of, n: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Relations as (key, row, times) in order, and the changes of role in each row."""
        subjects, objects = _roles(t)
        taker = _takers(t, subjects)
        pred = np.flatnonzero(mine & t.upos.among(("VERB", "AUX")) & t.deprel.told(lambda r: r.split(":", 1)[0] in CLAUSES))
        row, text = row_of[t.sent[pred]], text_no[t.sent[pred]]
        subs, objs = [subjects.get(i, ()) for i in taker[pred].tolist()], [objects.get(i, ()) for i in pred.tolist()]
        n_sub, n_obj = (np.fromiter(map(len, x), np.int64, len(x)) for x in (subs, objs))
        sub = code[np.fromiter((i for x in subs for i in x), np.int64, int(n_sub.sum()))]
        obj = code[np.fromiter((i for x in objs for i, _ in x), np.int64, int(n_obj.sum()))]
        role = np.fromiter((_ROLE[r] for x in objs for _, r in x), np.int64, len(obj))
        sub_at, obj_at = offsets(n_sub), offsets(n_obj)

        # Each subject with each object, or with none.
        wide = np.maximum(n_obj, 1)
        c = expanded(n_sub * wide)
        k = np.arange(len(c)) - offsets(n_sub * wide)[c]
        x = sub[sub_at[c] + k // wide[c]]
        y = np.where(n_obj[c] > 0, np.append(obj, 0)[np.minimum(obj_at[c] + k % wide[c], len(obj))] + 1, 0)
        _, told = np.unique(code[pred][c] * (width + 1) + y, return_inverse=True)
        _, relation = np.unique(x * (told.max(initial=0) + 1) + told, return_inverse=True)
        _, key = np.unique(text[c] * (relation.max(initial=0) + 1) + relation, return_inverse=True)
        pairs, times = np.unique(key * n + row[c], return_counts=True)

        # Who takes which role, clause by clause, subjects first.
        who, as_role = np.concatenate([sub, obj]), np.concatenate([np.zeros(len(sub), np.int64), role])
        clause = np.concatenate([expanded(n_sub), expanded(n_obj)])
        order = np.lexsort((np.concatenate([np.zeros(len(sub)), np.ones(len(obj))]), clause))
        who, as_role, clause = (text[clause] * width + who)[order], as_role[order], clause[order]
        order = np.argsort(who, kind="stable")
        who, as_role, clause = who[order], as_role[order], clause[order]
        changed = np.flatnonzero((who[1:] == who[:-1]) & (as_role[1:] != as_role[:-1])) + 1
        return (pairs // n, pairs % n, times), np.bincount(row[clause[changed]], minlength=n).astype(np.int64)


_ROLE = {"subject": 0, "object": 1, "indirect-object": 2, "oblique": 3}


def loads_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> lengths and loads of ``moments`` of their shallow parses (see ``Loads``), in the same pass."""
    fields = pa.schema([pa.field(f.name, _I) if f.name in Loads.SIZED else f for f in told_fields(Loads.ONLY)])
    return shallow.looked(docs, Loads, f"doc_id {dict(docs.dtypes)['doc_id']}, {_ddl(fields)}", whole=True)


class Things:
    """A task's look: of each sentence in a unit, how many things it brings in, takes up, and takes up after RETURN
    sentences or more; that needs the names alone."""

    def __init__(self):
        self.no, self.last = None, {}

    def __call__(self, b: Block) -> pa.RecordBatch:
        t, (inside, start, end) = b.trees, _parts(b)
        noun = np.flatnonzero(t.upos.among(("NOUN", "PROPN")) & (t.start >= start[t.sent]) & (t.end <= end[t.sent]))
        words, code = keyed(t, noun)
        begins, no, at, rows = np.searchsorted(noun, t.at).tolist(), b.text_no.tolist(), [], []
        for k, s in enumerate(b.sents):
            if not inside[k]:
                continue
            if no[k] != self.no:
                self.no, self.last = no[k], {}
            new = kept = back = 0
            for key in {words[c] for c in code[begins[k] : begins[k + 1]]} - {""}:
                if (before := self.last.get(key)) is None:
                    new += 1
                else:
                    kept, back = kept + 1, back + (s[0] - before >= RETURN)
                self.last[key] = s[0]
            at.append(k)
            rows.append((s[0], new, kept, back))
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays([b.doc_id.take(pa.array(at, pa.int64())), *cols], ["doc_id", "sentence", "n_introduced", "n_reinforced", "n_returned"])


def things_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, sentence, n_introduced, n_reinforced, n_returned, in the pass that parses the texts."""
    return shallow.looked(docs, Things, f"doc_id {dict(docs.dtypes)['doc_id']}, sentence long, n_introduced long, n_reinforced long, n_returned long")


def told_fields(only: list[str] | None) -> list[pa.Field]:
    return [f for f in MOMENT if only is None or f.name in only]


class ReadingState(StatefulProcessor):
    """``moments`` over a stream: the reader of a document waits as JSON between batches.  Sentences of a batch are read in
    order; one whose ordinal is not after the last one read comes too late and is passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reader", "reader string, sentence int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        saved, last = self.state.get() if self.state.exists() else (None, -1)
        reader, out = Reader.load(saved) if saved else Reader(), []
        for s in sorted((json.loads(x) for part in rows for x in part["sentence"]), key=lambda s: s["sent_idx"]):
            if s["sent_idx"] <= last:
                continue
            last = s["sent_idx"]
            s = {"par_idx": None, "par_start": None, "par_end": None, **s}
            if m := reader.read(s):
                out.append((key[0], json.dumps(m)))
        self.state.update((reader.save(), last))
        yield pd.DataFrame(out, columns=["doc_id", "moment"])

    def close(self) -> None:
        pass


def moments_stream(parses: DataFrame) -> DataFrame:
    """A stream of parses -> the same rows as ``moments``, as their sentences come in."""
    rows = parses.select("doc_id", F.to_json(F.struct(*SENTENCE_FIELDS)).alias("sentence"))
    told = rows.groupBy("doc_id").transformWithStateInPandas(ReadingState(), "doc_id long, moment string", "Append", "None")
    return told.select("doc_id", F.from_json("moment", _ddl()).alias("m")).select("doc_id", "m.*")


def _order() -> Window:
    return Window.partitionBy("doc_id").orderBy("sentence")


def _found(df: DataFrame, rule: str, start, end, confidence) -> DataFrame:
    grade = F.lit(confidence) if isinstance(confidence, str) else confidence
    return df.select("doc_id", F.lit(rule).alias("rule"), F.col(start).alias("start"), F.col(end).alias("end"), grade.alias("confidence"))


def sustained_pressure(m: DataFrame) -> DataFrame:
    """Of twenty sentences or more, windows of three that hold twenty frames, take in eight a sentence and change four roles
    without a release between them, where there are three and six in a hundred of them: the three heaviest apart."""
    load = F.col("load")
    frames = load["entity_frames"] + load["relation_frames"] + load["idea_frames"] + load["standard_frames"]
    w = _order().rowsBetween(-2, 0)
    back = lambda c, k: F.lag(c, k, False).over(_order())
    cut = (F.col("after_heading") | back("after_heading", 1)) | (back(F.size("cues") > 0, 1) | back(F.size("cues") > 0, 2))
    s = m.select("doc_id", "sentence", "end", F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n"), F.count(F.lit(1)).over(w).alias("k"), F.first("start").over(w).alias("start"), F.first("sentence").over(w).alias("first"), F.avg(frames).over(w).alias("held"), F.avg(load["pushes"] + load["reactivations"]).over(w).alias("inflow"), F.sum(load["role_changes"]).over(w).alias("roles"), cut.alias("cut"))
    s = s.where("n >= 20 and k = 3 and not cut").withColumn("over", F.expr("held >= 20 and inflow >= 8 and roles >= 4"))
    every = Window.partitionBy("doc_id")
    s = s.withColumns({"heavy": F.count_if("over").over(every), "rate": F.avg(F.col("over").cast("int")).over(every)}).where("over and heavy >= 3 and rate >= 0.06")
    rows = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-(F.col("held") + F.col("inflow") + F.col("roles"))).alias("rank"), "first", "sentence", "start", "end"))).alias("x"))
    apart = lambda kept, r: F.when((F.size(kept) < 3) & ~F.exists(kept, lambda o: (r["first"] <= o["sentence"]) & (r["sentence"] >= o["first"])), F.concat(kept, F.array(r))).otherwise(kept)
    kind = rows.schema["x"].dataType.simpleString()
    best = rows.select("doc_id", F.explode(F.aggregate("x", F.array().cast(kind), apart)).alias("b")).select("doc_id", "b.*")
    return _found(best, "sustained-buffer-pressure", "start", "end", "low")


def _first_of(m: DataFrame, *columns: Column) -> DataFrame:
    """The first moment of each document among those of m."""
    return m.groupBy("doc_id").agg(F.min_by(F.struct(*columns), "sentence").alias("x")).select("doc_id", "x.*")


def idea_stack(m: DataFrame) -> DataFrame:
    """The first moment with three open promises, or one open for eight sentences."""
    oldest = F.get("ideas", F.lit(0))
    hit = m.where((F.size("ideas") >= 3) | ((F.size("ideas") > 0) & (F.col("sentence") - oldest["sentence"] >= 8)))
    return _found(_first_of(hit, oldest["start"].alias("start"), F.col("end")), "unresolved-idea-stack", "start", "end", "low")


def decision_stack(m: DataFrame) -> DataFrame:
    """The first moment with four open standards of judgment; high from six on."""
    hit = m.where(F.size("standards") >= 4)
    x = _first_of(hit, F.array_min(F.transform("standards", lambda s: s["start"])).alias("start"), F.col("end"), F.size("standards").alias("n"))
    return _found(x, "undefined-decision-stack", "start", "end", F.when(F.col("n") >= 6, "high").otherwise("medium"))


def unoriented_returns(m: DataFrame) -> DataFrame:
    """Sentences in which two names and a relation come back without a word of orientation; a relation is told once."""
    named = F.size(F.filter("returned", lambda r: F.array_contains("names", r["key"])))
    hit = m.where(~F.col("after_heading") & ~F.array_contains("cues", "orientation") & (named >= 2) & (F.size("returned_relations") > 0))
    rows = hit.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sentence", "start", "end", F.transform("returned_relations", lambda r: r["key"]).alias("keys")))).alias("x"))
    zero = F.struct(F.array().cast("array<string>").alias("told"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda a, r: F.when(F.size(F.array_except(r["keys"], a["told"])) > 0, F.struct(F.array_union(a["told"], r["keys"]).alias("told"), F.concat(a["out"], F.array(F.struct(r["start"].alias("start"), r["end"].alias("end")))).alias("out"))).otherwise(a)
    return _found(rows.select("doc_id", F.explode(F.aggregate("x", zero, step)["out"]).alias("f")).select("doc_id", "f.*"), "unoriented-reactivation", "start", "end", "medium")


def _pileup(window: list[dict], most: int | None = None) -> tuple[int, int, int, int]:
    """Relations, directed pairs, role changes and participants of some moments, as far as there are no more than most."""
    pairs, roles, n, changes = set(), {}, 0, 0
    for c in (c for m in window for c in m["clauses"]):
        for who, role in [*((x, "subject") for x in c["subjects"]), *((o["key"], o["role"]) for o in c["objects"])]:
            changes += roles.get(who, role) != role
            roles[who] = role
        found = [(x, o["key"]) for x in c["subjects"] for o in c["objects"]]
        n += len(found)
        pairs |= set(found)
        if most is not None and len(roles) > most:
            break
    return n, len(pairs), changes, len(roles)


def pileup_windows(rows: list[dict]) -> list[tuple[int, int, str]]:
    """Windows that grow to seven moments or 900 signs and end at a release; one that is found is skipped whole."""
    out, at = [], 0
    while at < len(rows):
        size = 1
        while size < 7 and at + size < len(rows):
            m = rows[at + size]
            if m["after_heading"] or rows[at + size - 1]["cues"] or m["end"] - rows[at]["start"] > 900:
                break
            size += 1
        n, pairs, changes, who = _pileup(rows[at : at + size], 8)
        if n >= 6 and pairs >= 4 and changes >= 3 and who <= 8:
            out.append((rows[at]["start"], rows[at + size - 1]["end"], "high" if n >= 9 and changes >= 5 else "medium"))
            at += size
        else:
            at += 1
    return out


def relation_pileups(m: DataFrame) -> DataFrame:
    """Passages that change six relations among few participants, over each document's moments in order."""
    kind = dict(m.dtypes)["doc_id"]
    out = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.string()), ("start", _I), ("end", _I), ("confidence", _S)])

    def find(rows: pa.Table) -> pa.Table:
        told = sorted(rows.to_pylist(), key=lambda r: r["sentence"])
        return pa.Table.from_pylist([{"doc_id": told[0]["doc_id"], "start": a, "end": z, "confidence": c} for a, z, c in pileup_windows(told)], out)

    found = m.select("doc_id", "sentence", "start", "end", "clauses", "after_heading", "cues").groupBy("doc_id").applyInArrow(find, f"doc_id {kind}, start int, end int, confidence string")
    return _found(found, "relationship-pileup", "start", "end", F.col("confidence"))


def trace_findings(m: DataFrame) -> DataFrame:
    """Findings (doc_id, rule, start, end, confidence) of all rules on moments; write moments first, as each rule reads them."""
    parts = [f(m) for f in (sustained_pressure, idea_stack, decision_stack, unoriented_returns, relation_pileups)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pressed(rows: list[dict]) -> list[tuple[int, int]]:
    """``sustained_pressure`` of one document."""
    windows = []
    for a, b, c in zip(rows, rows[1:], rows[2:], strict=False) if len(rows) >= 20 else ():
        if not (c["after_heading"] or b["after_heading"] or b["cues"] or a["cues"]):
            load = [m["load"] for m in (a, b, c)]
            held = sum(x["entity_frames"] + x["relation_frames"] + x["idea_frames"] + x["standard_frames"] for x in load) / 3
            inflow, roles = sum(x["pushes"] + x["reactivations"] for x in load) / 3, sum(x["role_changes"] for x in load)
            windows.append((held >= 20 and inflow >= 8 and roles >= 4, -(held + inflow + roles), a["sentence"], c["sentence"], a["start"], c["end"]))
    heavy, kept = sorted(w[1:] for w in windows if w[0]), []
    for w in heavy if len(heavy) >= 3 and len(heavy) / len(windows) >= 0.06 else ():
        if len(kept) < 3 and not any(w[1] <= o[2] and w[2] >= o[1] for o in kept):
            kept.append(w)
    return [(w[3], w[4]) for w in kept]


def document_findings(rows: list[dict]) -> list[tuple[str, int, int, str]]:
    """(rule, start, end, confidence) of the rules above on the moments of one document in order."""
    out = [("sustained-buffer-pressure", a, z, "low") for a, z in _pressed(rows)]
    if m := next((m for m in rows if (i := m["ideas"]) and (len(i) >= 3 or m["sentence"] - i[0]["sentence"] >= 8)), None):
        out.append(("unresolved-idea-stack", m["ideas"][0]["start"], m["end"], "low"))
    if m := next((m for m in rows if len(m["standards"]) >= 4), None):
        out.append(("undefined-decision-stack", min(s["start"] for s in m["standards"]), m["end"], "high" if len(m["standards"]) >= 6 else "medium"))
    told: set[str] = set()
    for m in rows:
        if m["returned_relations"] and not m["after_heading"] and "orientation" not in m["cues"] and sum(r["key"] in m["names"] for r in m["returned"]) >= 2:
            keys = {r["key"] for r in m["returned_relations"]}
            if keys - told:
                out.append(("unoriented-reactivation", m["start"], m["end"], "medium"))
                told |= keys
    return out + [("relationship-pileup", a, z, c) for a, z, c in pileup_windows(rows)]


class Findings(Reading):
    """A task's look: findings of the rules on moments, text by text; blocks hold texts whole."""

    def __init__(self):
        super().__init__(["sentence", "start", "end", "returned", "returned_relations", "ideas", "standards", "load", "clauses", "names", "after_heading", "cues"])

    def __call__(self, b: Block) -> pa.RecordBatch:
        at, found = [], []
        for _, text in groupby(self.moments(b), key=lambda x: b.text_no[x[0]]):
            places, rows = zip(*text, strict=True)
            new = document_findings(list(rows))
            found += new
            at += [places[0]] * len(new)
        cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((_S, _I, _I, _S))]
        return pa.RecordBatch.from_arrays([b.doc_id.take(pa.array(at, pa.int64())), *cols], ["doc_id", "rule", "start", "end", "confidence"])


def findings_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> ``trace_findings`` of their shallow parses, in the pass that parses them: neither moments nor
    parses leave a task, which holds one text's moments at a time.  A row is a text of its own."""
    return shallow.looked(docs, Findings, f"doc_id {dict(docs.dtypes)['doc_id']}, rule string, start int, end int, confidence string", whole=True)
