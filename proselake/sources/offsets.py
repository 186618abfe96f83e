"""Text taken out of other text, with the way back: sorted pieces that say which source each stretch of output came from.

A piece (at, start, end, run) begins at output offset ``at``.  In a run, output signs stand one for one for source signs
from ``start`` on; otherwise every sign of the piece stands for the source from ``start`` to ``end`` (an entity) or for a
place in it (a separator, where both are equal).  A span's source goes from where its first sign came from to where its
last one ended, each found by binary search; maps of nested extractions are composed piece by piece.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from proselake.sources.html import BLOCKS, ENTITIES, HIDDEN

PIECES = "array<struct<at:int,start:int,end:int,run:boolean>>"
RENDERED = f"struct<text:string,pieces:{PIECES}>"
_I = pa.int32()
_PIECES = pa.list_(pa.struct([("at", _I), ("start", _I), ("end", _I), ("run", pa.bool_())]))
_PART = re.compile(r"""<!--[\s\S]*?(?:-->|\Z)|<(?:"[^"]*"|'[^']*'|[^'">])*(?:>|\Z|["'][\s\S]*\Z)|&(?:\#\d+|\#[xX][\da-fA-F]+|[A-Za-z][\dA-Za-z]+);|[^<&]+|&""")
_NAME = re.compile(r"\s*/?([A-Za-z][\w:-]*)", re.ASCII)

Piece = tuple[int, int, int, bool]


class Output:
    """A text under way with its pieces."""

    def __init__(self):
        self.parts: list[str] = []
        self.pieces: list[Piece] = []
        self.size = 0
        self.end = ""

    def add(self, text: str, start: int, end: int, run: bool = False) -> None:
        if not text:
            return
        self.pieces.append((self.size, start, end, run))
        self.parts.append(text)
        self.size += len(text)
        self.end = (self.end + text)[-2:]

    def space(self, at: int) -> None:
        if self.end and not self.end[-1].isspace():
            self.add(" ", at, at)

    def block(self, at: int) -> None:
        while self.end and self.end != "\n\n":
            self.add("\n", at, at)

    def done(self) -> tuple[str, list[Piece]]:
        return "".join(self.parts), self.pieces


def entity(raw: str) -> str | None:
    body = raw[1:-1]
    if not body.startswith("#"):
        return ENTITIES.get(body)
    point = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
    return chr(point) if 0 < point <= 0x10FFFF else None


def render(html: str) -> tuple[str, list[Piece]]:
    """The prose of a page, as ``html_text`` gives it, and where it came from."""
    out, hidden = Output(), []
    for m in _PART.finditer(html):
        raw, at, end = m.group(), m.start(), m.end()
        if raw.startswith("<!--"):
            continue
        if raw[0] == "<":
            inner = raw[1:-1].strip() if raw.endswith(">") else raw[1:].strip()
            name = (n := _NAME.match(inner)) and n[1].lower()
            if name in HIDDEN:
                if inner.startswith("/"):
                    if name in hidden:
                        del hidden[len(hidden) - 1 - hidden[::-1].index(name)]
                elif not inner.endswith("/"):
                    hidden.append(name)
            if hidden:
                continue
            if name in BLOCKS:
                out.block(at)
            elif name == "br":
                out.add("\n", at, at)
            else:
                out.space(at)
        elif not hidden:
            sign = entity(raw) if raw[0] == "&" and len(raw) > 1 else None
            out.add(sign, at, end) if sign else out.add(raw, at, end, True)
    return out.done()


def source_range(pieces: list[Piece], size: int, start: int, end: int) -> tuple[int, int]:
    """Where an output span came from; offsets outside the output are brought to its nearest sign."""
    if not pieces or not size:
        return 0, 0
    first = min(max(start, 0), size - 1)
    last = max(first, min(max(start, end - 1), size - 1))

    def sign(k: int) -> tuple[int, int]:
        at, a, z, run = pieces[bisect_right(pieces, k, key=lambda p: p[0]) - 1]
        return (a + k - at, a + k - at + 1) if run else (a, z)

    return sign(first)[0], sign(last)[1]


def composed(outer: list[Piece], outer_size: int, inner: list[Piece]) -> list[Piece]:
    """The map of an extraction (outer) from a text that was itself extracted (inner), into the first source."""
    starts = [p[0] for p in inner]
    out: list[Piece] = []
    for n, (at, a, z, run) in enumerate(outer):
        if not run:
            out.append((at, *source_range(inner, max(z, a + 1), a, max(z, a + 1)), False))
            continue
        size = (outer[n + 1][0] if n + 1 < len(outer) else outer_size) - at
        k = bisect_right(starts, a) - 1
        while k < len(inner) and (begin := max(a, inner[k][0])) < a + size:
            i_at, i_a, i_z, i_run = inner[k]
            stop = min(a + size, starts[k + 1] if k + 1 < len(inner) else a + size)
            out.append((at + begin - a, i_a + begin - i_at, i_a + stop - i_at, True) if i_run else (at + begin - a, i_a, i_z, False))
            k += 1
    return out


def combined(parts: list[tuple[str, list[Piece]]]) -> tuple[str, list[Piece]]:
    """Extractions of one source after each other, an empty line between them; those without prose are left out."""
    out = Output()
    for text, pieces in parts:
        if not text.strip():
            continue
        if out.size:
            _, a, z, run = out.pieces[-1]
            here = a + out.size - out.pieces[-1][0] - 1 if run else a
            out.add("\n\n", here, here)
        for n, (at, a, z, run) in enumerate(pieces):
            out.add(text[at : pieces[n + 1][0] if n + 1 < len(pieces) else len(text)], a, z, run)
    return out.done()


def rendered(html: Column) -> Column:
    """Struct of a page's text and pieces; null counts as empty."""

    @F.arrow_udf(RENDERED)
    def run(pages: pa.Array) -> pa.Array:
        done = [render(p.as_py() or "") for p in pages]
        pieces = [[dict(zip(("at", "start", "end", "run"), p, strict=True)) for p in ps] for _, ps in done]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array(pieces, _PIECES)], ["text", "pieces"])

    return run(html)


def source_spans(pieces: Column, size: Column, spans: Column) -> Column:
    """array<struct<start,end>> of source spans for an array of output spans (start, end)."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(maps: pa.Array, sizes: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for m, n, r in zip(maps.to_pylist(), sizes.to_pylist(), rows.to_pylist(), strict=True):
            ps = [(p["at"], p["start"], p["end"], p["run"]) for p in m or []]
            out.append([dict(zip(("start", "end"), source_range(ps, n or 0, s["start"], s["end"]), strict=True)) for s in r or []])
        return pa.array(out, pa.list_(pa.struct([("start", _I), ("end", _I)])))

    return run(pieces, size, spans)
