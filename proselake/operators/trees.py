"""Trees of many sentences in flat columns, as one pass over an Arrow batch sees them.

Tokens of all sentences lie one after the other; a token's id is its place in its sentence, from 1.  Words are coded, so
that what depends on a word alone is asked once a word.  Steps go over all tokens at once, as often as trees are deep.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Coded:
    """Values by their place in a list of different ones; -1 for null."""

    codes: np.ndarray
    values: list[str]

    @classmethod
    def of(cls, column: pa.Array) -> Coded:
        d = column.dictionary_encode()
        return cls(pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32), d.dictionary.to_pylist())

    def told(self, of: Callable[[str], object], kind: type = bool) -> np.ndarray:
        """of(value) for each token; false, 0 or -1 for null, as kind has it."""
        null = -1 if np.issubdtype(kind, np.integer) else kind()
        return np.array([*map(of, self.values), null], kind)[self.codes]

    def among(self, values) -> np.ndarray:
        return self.told(frozenset(values).__contains__)

    def array(self, at=None) -> pa.Array:
        codes = self.codes if at is None else self.codes[at]
        return pa.array(self.values, pa.string()).take(pa.array(codes, mask=codes < 0))


def expanded(counts: np.ndarray) -> np.ndarray:
    """Row numbers, each as often as counts says."""
    return np.repeat(np.arange(len(counts)), counts)


def offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


@dataclass
class Trees:
    """at: where each sentence's tokens begin, and where the last one's end; head: 0 for the root, -1 for null."""

    at: np.ndarray
    head: np.ndarray
    start: np.ndarray
    end: np.ndarray
    form: Coded
    upos: Coded
    deprel: Coded

    @classmethod
    def of(cls, tokens: pa.ListArray) -> Trees:
        """From an array of tokens; ids are taken to be 1, 2, 3 and so on."""
        flat = tokens.flatten()
        num = lambda k: pc.fill_null(flat.field(k), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        word = lambda k: Coded.of(flat.field(k))
        counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        return cls(offsets(counts), num("head"), num("start"), num("end"), word("form"), word("upos"), word("deprel"))

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @cached_property
    def sent(self) -> np.ndarray:
        """The sentence of each token."""
        return expanded(self.counts)

    @cached_property
    def id(self) -> np.ndarray:
        return np.arange(self.at[-1]) - self.at[self.sent] + 1

    @cached_property
    def up(self) -> np.ndarray:
        """Where each token's head lies, -1 if it has none."""
        there = (self.head > 0) & (self.head <= self.counts[self.sent])
        return np.where(there, self.at[self.sent] + self.head - 1, -1)

    @cached_property
    def low(self) -> Coded:
        return Coded(self.form.codes, [w.lower() for w in self.form.values])

    def is_rel(self, rel: str) -> np.ndarray:
        """Has a token this relation or a subtype of it?"""
        return self.deprel.told(lambda r: r == rel or r.startswith(rel + ":"))

    @cached_property
    def lost(self) -> np.ndarray:
        """Tokens whose way up never ends."""
        x = np.append(self.up, -1)
        for _ in range(int(self.counts.max(initial=1)).bit_length() + 1):
            x = x[x]  # twice as far up each time
            if (x < 0).all():
                break
        return x[:-1] >= 0

    def path(self, i: int) -> list[int]:
        """Where a token's heads lie, nearest first; a way that goes round ends before it meets a token again."""
        out, met, up = [], {i}, int(self.up[i])
        while up >= 0 and up not in met:
            out.append(up)
            met.add(up)
            up = int(self.up[up])
        return out

    def climbed(self, starts: np.ndarray, goes_on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(token above, token) for all above each of starts, in order; a way goes on over tokens where goes_on holds."""
        tops, toks = [], []
        straight = starts[~self.lost[starts]]
        at = self.up[straight]
        while len(straight := straight[at >= 0]):
            at = at[at >= 0]
            tops.append(at)
            toks.append(straight)
            if goes_on is not None:
                more = goes_on[at]
                straight, at = straight[more], at[more]
            at = self.up[at]
        for i in starts[self.lost[starts]].tolist():
            for j in self.path(i):
                tops.append(np.array([j]))
                toks.append(np.array([i]))
                if goes_on is not None and not goes_on[j]:
                    break
        if not tops:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tops, toks = np.concatenate(tops), np.concatenate(toks)
        order = np.lexsort((toks, tops))
        return tops[order], toks[order]

    def kids(self, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(head, child) of tokens that have a head, in order; only children where which holds."""
        some = np.flatnonzero(self.up >= 0 if which is None else which & (self.up >= 0))
        some = some[np.argsort(self.up[some], kind="stable")]
        return self.up[some], some

    def joined_ids(self, tops: np.ndarray, toks: np.ndarray) -> pa.Array:
        """For each token the ids of those that stand beside it, by spaces; both in order."""
        ids = pa.array(self.id[toks]).cast(pa.string())
        ends = offsets(np.bincount(tops, minlength=len(self.head)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), " ")

    def valid(self) -> np.ndarray:
        """Do a sentence's heads make one tree?"""
        n = len(self.counts)
        of = lambda flag: np.bincount(self.sent[flag], minlength=n)
        wrong = (self.head < 0) | (self.head > self.counts[self.sent]) | self.lost
        return (of(self.head == 0) == 1) & (of(wrong) == 0)


@dataclass
class Block:
    """Sentences in a row with their trees: document, ordinal, place and text of each, and which text of the task it is of.
    A block of whole texts also has the document of each, those without a sentence too, and the number of the first."""

    doc_id: pa.Array
    text_no: np.ndarray
    sents: list[tuple]
    trees: Trees
    texts: pa.Array | None = None
    first_no: int = 0

    def column(self, k: int, kind: pa.DataType) -> pa.Array:
        return pa.array([s[k] for s in self.sents], kind)


Look = Callable[[Block], pa.RecordBatch]


def looked(parses, look: Look, ddl: str):
    """parses as rows -> what look says of their sentences, batch by batch: for looks that ask each sentence for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sents = list(zip(*(b.column(k).to_pylist() for k in ("sent_idx", "start", "end", "text")), strict=True))
            sents = [(i, None, a, z, None, None, t) for i, a, z, t in sents]
            yield look(Block(b.column("doc_id"), np.zeros(len(sents), np.int64), sents, Trees.of(b.column("tokens"))))

    return parses.select("doc_id", "sent_idx", "start", "end", "text", "tokens").mapInArrow(run, ddl)
