"""Where things are in a text: one Arrow pass that finds sentences, paragraphs and the matches of named patterns.

Every step is a scan or a binary search over sorted offsets, so a text's cost grows with its length.  What a match means
is left to column expressions; this only says where it is, in which sentence and paragraph, and what stands before it.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# White space, stops with closers and paragraph breaks that texts are cut by.
WHITE_SIGNS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
STOP = r"[.!?]+[\"'”’»)\]}]*"
PARAGRAPH_BREAK = "\n[\t ]*\n"

_CUT = re.compile(f"{STOP}(?=[{WHITE_SIGNS}]|\\Z)|\u2029|\n(?=\n)")
_GAP = re.compile(PARAGRAPH_BREAK)
HIT = "array<struct<start:int,end:int,i:int,p:int,match:string,before:string>>"
PIECE = "array<struct<text:string,start:int,end:int>>"
LINK = "array<struct<p:int,i:int,j:int,sim:double,novel:int>>"
_INT = pa.int32()
_HIT = pa.struct([("start", _INT), ("end", _INT), ("i", _INT), ("p", _INT), ("match", pa.string()), ("before", pa.string())])
_PIECE = pa.struct([("text", pa.string()), ("start", _INT), ("end", _INT)])
_LINK = pa.struct([("p", _INT), ("i", _INT), ("j", _INT), ("sim", pa.float64()), ("novel", _INT)])


_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile("[a-z]+")
#: Becomes a plain k in lower case, so that runs of letters there are not those of the text.
KELVIN = "\u212a"


def compiled(pattern: str) -> re.Pattern:
    """ASCII classes and word edges, as in other dialects, unless the pattern begins with (?u)."""
    return re.compile(pattern, 0 if pattern.startswith("(?u)") else re.ASCII)


def lowered(text: str) -> str:
    """The text in lower case, sign by sign."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_AZ)


@dataclass(frozen=True)
class Finder:
    """A pattern; one that ignores case and names no capital is matched on the lower-case text, which is faster."""

    pattern: re.Pattern
    low: bool
    grouped: bool
    words: frozenset[str] | None = None
    sign: re.Pattern | None = None

    @classmethod
    def of(cls, pattern: str, words: frozenset[str] | None = None, sign: str | None = None, fold: bool = True) -> Finder:
        low = fold and "(?i)" in pattern and not re.search("[A-Z]", re.sub(r"\\.|\(\?P", "", pattern))
        found = compiled(pattern.replace("(?i)", "") if low else pattern)
        return cls(found, low, "at" in found.groupindex, words, compiled(sign) if sign else None)

    def may(self, runs: set[str] | None, text: str) -> bool:
        """Can the pattern match in a text with these runs of letters?  Null runs are unknown."""
        if runs is None or (self.words is None and self.sign is None):
            return True
        return (self.words is not None and not self.words.isdisjoint(runs)) or (self.sign is not None and self.sign.search(text) is not None)


def _pieces(text: str, cuts) -> tuple[list[str], list[int], list[int]]:
    """Trimmed, non-empty pieces of a text between (end of a piece, start of the next)."""
    texts, starts, ends, at = [], [], [], 0
    for stop, nxt in cuts:
        piece = text[at:stop]
        body = piece.lstrip(WHITE_SIGNS)
        start = at + len(piece) - len(body)
        body = body.rstrip(WHITE_SIGNS)
        if body:
            texts.append(body)
            starts.append(start)
            ends.append(start + len(body))
        at = nxt
    return texts, starts, ends


def cut_sentences(text: str) -> tuple[list[str], list[int], list[int]]:
    """Cut after stops and closers before white space or the end, after U+2029, and before an empty line."""
    return _pieces(text, [*((m.end(), m.end()) for m in _CUT.finditer(text)), (len(text), len(text))])


def cut_paragraphs(text: str) -> tuple[list[str], list[int], list[int]]:
    """Blocks between blank lines."""
    return _pieces(text, [*((m.start(), m.end()) for m in _GAP.finditer(text)), (len(text), len(text))])


def _shorter(word: str) -> str:
    word = re.sub("'(?:s|re|ve|ll|d|m)$", "", word) if "'" in word else word
    n = len(word)
    if n > 6 and word.endswith("ing"):
        return word[:-3]
    if n > 5 and word.endswith(("ed", "es")):
        return word[:-2]
    return word[:-1] if n > 4 and word.endswith("s") else word


#: A word's stem; words recur, so that most are looked up.
stem = functools.lru_cache(maxsize=1 << 16)(_shorter)
_LONG_WORD = re.compile("[a-z][a-z'-]{2,}")


@dataclass(frozen=True)
class Alike:
    """Pieces that share stems of words of three letters that are no stop words.  Of the up to four pieces before, but not
    nearer than the lag, a piece is linked with the one that shares most stems of the shorter one, the earliest of
    equals, if both have ``least`` stems, share five, and the share is ``share`` or more.  Each of sents (those of
    a paragraph) and pars is (least, lag, share)."""

    stop: frozenset[str]
    sents: tuple[int, int, float]
    pars: tuple[int, int, float]

    def stems(self, text: str, least: int) -> frozenset[str]:
        words = _LONG_WORD.findall(text.lower())
        return frozenset(map(stem, words)) - self.stop if len(words) >= least else frozenset()

    @staticmethod
    def links(stems: list[frozenset[str]], least: int, lag: int, share: float) -> Iterator[tuple[int, int, float, int]]:
        """(place, place of the likest one before, share, stems that are new)."""
        for i, mine in enumerate(stems):
            if len(mine) < least:
                continue
            best = None
            for j in range(max(i - 4, 0), i - lag + 1):
                other = stems[j]
                if len(other) >= least and (n := len(mine & other)) >= 5:
                    sim = n / min(len(mine), len(other))
                    if best is None or sim > best[2]:
                        best = i, j, sim, len(mine) - n
            if best is not None and best[2] >= share:
                yield best


@dataclass(frozen=True)
class Patterns:
    """anywhere: matched over whole texts; heads: at the start of each sentence; tails: in what follows a share of the
    text (``tail``).  A group named at is what counts as the match's place.  ``before`` is how many characters in front
    of a match, of its own paragraph, are kept; per_paragraph ones come as an array for each paragraph.

    ``words`` and ``signs`` tell where a pattern need not be looked for: every match holds one of the words, as a whole
    run of letters a to z, or a place that fits the sign (looked for with a line end in front of the text).  ``counts``
    are counted in each paragraph without what ``skip`` matches.  ``alike`` links sentences and paragraphs that share
    stems."""

    anywhere: dict[str, str]
    heads: dict[str, str] = field(default_factory=dict)
    tails: dict[str, str] = field(default_factory=dict)
    tail: float = 0.65
    before: dict[str, int] = field(default_factory=dict)
    per_paragraph: frozenset[str] = frozenset()
    words: dict[str, frozenset[str]] = field(default_factory=dict)
    signs: dict[str, str] = field(default_factory=dict)
    counts: dict[str, str] = field(default_factory=dict)
    skip: str | None = None
    alike: Alike | None = None

    @property
    def names(self) -> list[str]:
        return [*self.anywhere, *self.heads, *self.tails]

    def ddl(self) -> str:
        hits = (f"{n}:array<{HIT}>" if n in self.per_paragraph else f"{n}:{HIT}" for n in self.names)
        block = "".join(f",n_{n}:int" for n in self.counts)
        links = f"same_sents:{LINK},same_pars:{LINK}," if self.alike else ""
        return f"struct<sents:{PIECE},pars:array<struct<text:string,start:int,end:int,first:int,size:int{block}>>,{links}{','.join(hits)}>"

    def block(self) -> pa.StructType:
        return pa.struct([*_PIECE, ("first", _INT), ("size", _INT), *((f"n_{n}", _INT) for n in self.counts)])

    def finders(self, of: dict[str, str]) -> dict[str, Finder]:
        return {n: Finder.of(p, self.words.get(n), self.signs.get(n), of is not self.counts) for n, p in of.items()}


class _Lists:
    """Rows of a list column of structs under way."""

    def __init__(self, kind: pa.StructType):
        self.kind, self.columns, self.ends = kind, [[] for _ in kind], [0]

    def add(self, *columns: list) -> None:
        for have, new in zip(self.columns, columns, strict=True):
            have += new

    def extend(self, rows: list[tuple]) -> None:
        if rows:
            self.add(*map(list, zip(*rows, strict=True)))

    def close(self) -> None:
        self.ends.append(len(self.columns[0]))

    def array(self) -> pa.Array:
        rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.kind, strict=True)], fields=list(self.kind))
        return pa.ListArray.from_arrays(pa.array(self.ends, _INT), rows)


#: Texts and signs that a task holds as Python objects at a time.
SLICE, SIGNS = 256, 4_000_000


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """texts, some at a time: places take far more room as Python's objects than as Arrow's."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if k > at and (k - at >= SLICE or held + n > SIGNS):
            yield texts.slice(at, k - at)
            at, held = k, 0
        held += n
    yield texts.slice(at)


def in_slices(texts: pa.Array, of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """of(texts), some texts at a time."""
    return pa.concat_arrays([of(some) for some in slices(texts)])


def _where(starts: list[int], ends: list[int], at: int) -> int | None:
    k = bisect_right(starts, at) - 1
    return k if k >= 0 and at < ends[k] else None


def scan(texts: pa.Array, patterns: Patterns) -> pa.StructArray:
    """A text column -> sents, pars, links and a list of hits for each pattern; null counts as empty."""
    find, heads, tails, counts = (patterns.finders(of) for of in (patterns.anywhere, patterns.heads, patterns.tails, patterns.counts))
    block, skip, alike = patterns.block(), patterns.skip and compiled(patterns.skip), patterns.alike
    sents, pars, hits = _Lists(_PIECE), _Lists(block), {n: _Lists(_HIT) for n in patterns.names}
    same = {n: _Lists(_LINK) for n in ("same_sents", "same_pars") if alike}
    outer = {n: [0] for n in patterns.per_paragraph}
    for value in texts:
        text = value.as_py() or ""
        low = lowered(text)
        runs, signs = None if KELVIN in text else set(_RUN.findall(low)), "\n" + text
        s_text, s_start, s_end = cut_sentences(text)
        p_text, p_start, p_end = cut_paragraphs(text)
        sents.add(s_text, s_start, s_end)
        first = [bisect_right(s_end, a) for a in p_start]
        size = [bisect_left(s_start, z) - f for z, f in zip(p_end, first, strict=True)]
        counted = []
        if counts:
            plain = p_text if skip is None else [skip.sub(" ", t) for t in p_text]
            counted = [[len(f.pattern.findall(t)) for t in plain] if f.may(runs, signs) else [0] * len(plain) for f in counts.values()]
        pars.add(p_text, p_start, p_end, first, size, *counted)
        if alike:
            for p, (f, n) in enumerate(zip(first, size, strict=True)):
                if n > alike.sents[1]:
                    same["same_sents"].extend([(p, f + i, f + j, sim, new) for i, j, sim, new in alike.links([alike.stems(t, alike.sents[0]) for t in s_text[f : f + n]], *alike.sents)])
            if len(p_text) > 1:
                same["same_pars"].extend([(i, i, j, sim, new) for i, j, sim, new in alike.links([alike.stems(t, alike.pars[0]) for t in p_text], *alike.pars)])

        def found(name: str, f: Finder, m: re.Match, off: int = 0, text=text, s=(s_start, s_end), p=(p_start, p_end)) -> tuple:
            a, z = m.span("at" if f.grouped else 0)
            k, width = _where(*p, a + off), patterns.before.get(name, 0)
            front = text[max(a + off - width, p[0][k] if k is not None else 0) : a + off] if width else ""
            return a + off, z + off, _where(*s, a + off), k, text[m.start() + off : m.end() + off], front

        for n, f in find.items():
            rows = [found(n, f, m) for m in f.pattern.finditer(low if f.low else text)] if f.may(runs, signs) else []
            if n not in outer:
                hits[n].extend(rows)
                continue
            rows = [r for r in rows if r[3] is not None]
            ends = [bisect_right(rows, k, key=lambda r: r[3]) for k in range(len(p_start))]
            for a, z in zip([0, *ends], ends, strict=False):
                hits[n].extend(rows[a:z])
                hits[n].close()
            outer[n].append(outer[n][-1] + len(p_start))
        for n, f in heads.items():
            if f.may(runs, signs):
                of = low if f.low else text
                hits[n].extend([found(n, f, m, a) for m, a in ((f.pattern.match(of[a:z]), a) for a, z in zip(s_start, s_end, strict=True)) if m])
        at = int(len(text) * patterns.tail)
        if runs is not None and (cut := _RUN.match(low, at)):
            runs.add(cut.group())  # a word that the tail begins inside of
        for n, f in tails.items():
            if f.may(runs, signs):
                hits[n].extend([found(n, f, m, at) for m in f.pattern.finditer((low if f.low else text)[at:])])
        for x in (sents, pars, *same.values(), *(h for n, h in hits.items() if n not in outer)):
            x.close()
    columns = [sents.array(), pars.array(), *(x.array() for x in same.values())]
    for n in patterns.names:
        rows = hits[n].array()
        columns.append(pa.ListArray.from_arrays(pa.array(outer[n], _INT), rows) if n in outer else rows)
    return pa.StructArray.from_arrays(columns, ["sents", "pars", *same, *patterns.names])


def places(patterns: Patterns) -> Callable[[Column], Column]:
    """A column function: text -> struct of sents, pars and the hits of each pattern."""

    # What is found goes on slice by slice, as a batch of it is several times its texts.
    @arrow_udf(patterns.ddl())
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in slices(texts):
                yield scan(some, patterns)

    return found


def _one(kind: str, body: Callable[[str], tuple], of: pa.StructType) -> Callable[[Column], Column]:
    def lists(texts: pa.Array) -> pa.Array:
        out = _Lists(of)
        for value in texts:
            out.add(*body(value.as_py() or ""))
            out.close()
        return out.array()

    @arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from map(lists, slices(texts))

    return run


def sentence_pieces() -> Callable[[Column], Column]:
    return _one(PIECE, cut_sentences, _PIECE)


def paragraph_pieces() -> Callable[[Column], Column]:
    return _one(PIECE, cut_paragraphs, _PIECE)


def pattern_spans(pattern: str) -> Callable[[Column], Column]:
    kind = pa.struct([("start", _INT), ("end", _INT), ("match", pa.string())])

    def body(text: str) -> tuple:
        found = [(m.start(), m.end(), m.group()) for m in compiled(pattern).finditer(text)]
        return tuple(map(list, zip(*found, strict=True))) if found else ([], [], [])

    return _one("array<struct<start:int,end:int,match:string>>", body, kind)
