"""Column functions on prose: sentences and paragraphs with offsets, words, match spans.

Offsets are code points from the start of the text, ends exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from proselake.functions.places import STOP, paragraph_pieces, pattern_spans, sentence_pieces

#: White space that the engine splits at, written out because regex dialects differ in \\s.
BLANK = r"[ \t\n\r]"
# The patterns that words, sentences and paragraphs are defined by.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
WHITE = "[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
CLITIC = r"(?i)(?:n't|'s|'re|'ve|'ll|'d|'m)$"
TOKEN = r"(?:https?://|www\.)[^\s]+|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|\p{N}+(?:[.,:]\p{N}+)*|[^\s]"

_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str, exact: bool = False) -> str:
    """A pattern whose \\b means the edge of an ASCII word, as in other dialects.

    An edge before a word needs no word sign before it, one after a word none after it, which is cheaper to
    test; ``exact`` is for patterns where the text beside the edge may not belong to a word.
    """
    if exact:
        return pattern.replace(r"\b", _EDGE)
    return re.sub(r"\\b(?=\w|\(|\[(?!\^)|\\d)", "(?<![A-Za-z0-9_])", pattern).replace(r"\b", "(?![A-Za-z0-9_])")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def sentences(text: Column) -> Column:
    """Array of (text, start, end): cut after stops and closers before white space or the end, after U+2029,
    and before an empty line."""
    return sentence_pieces()(text)


def paragraphs(text: Column) -> Column:
    """Array of (text, start, end): blocks between blank lines."""
    return paragraph_pieces()(text)


def sentence_array(text: Column) -> Column:
    """Trimmed, non-empty sentences, without their places."""
    t = F.regexp_replace(F.translate(filled(text), "\x01", " "), f"({STOP})(?={WHITE}|\\z)", "$1\x01")
    t = F.regexp_replace(F.replace(t, F.lit("\u2029"), F.lit("\u2029\x01")), "\n(?=\n)", "\n\x01")
    trimmed = F.transform(F.split(t, "\x01", -1), lambda x: F.regexp_replace(F.regexp_replace(x, f"^{WHITE}+", ""), f"{WHITE}+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(filled(text), F.lit(f"({WORD})"), 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def syntactic_words(text: Column) -> Column:
    """Forms of a sentence: URLs, words, numbers and single signs; clitics and the parts of cannot apart."""

    def parts(w):
        straight = F.replace(w, F.lit("’"), F.lit("'"))
        clitic = F.length(F.regexp_extract(straight, f"^.+?({CLITIC[4:]})".replace("^", "(?i)^", 1), 1))
        n = F.length(w)
        return (
            F.when(F.lower(w) == "cannot", F.array(F.substring(w, F.lit(1), F.lit(3)), F.substring(w, F.lit(4), F.lit(3))))
            .when(clitic > 0, F.array(F.substring(w, F.lit(1), n - clitic), F.substring(w, n - clitic + 1, clitic)))
            .otherwise(F.array(w))
        )

    # Only words with a quote and cannot have parts.
    parted = lambda w: F.when(F.contains(w, F.lit("'")) | F.contains(w, F.lit("’")) | (F.length(w) == 6), parts(w)).otherwise(F.array(w))
    return F.flatten(F.transform(F.regexp_extract_all(filled(text), F.lit(f"({TOKEN})"), 1), parted))


def token_count(text: Column) -> Column:
    """Syntactic words with a letter or digit.

    Words without a quote, other than cannot, have one part, and a text without marks of its own has no words without
    a letter or digit but single signs; there it is enough to count.
    """
    parted = F.filter(syntactic_words(text), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    return F.when(filled(text).rlike(r"(?i)['’\p{M}]|cannot"), F.size(parted)).otherwise(F.regexp_count(filled(text), F.lit(TOKEN.removesuffix(r"|[^\s]"))))


def spans(text: Column, pattern: str) -> Column:
    """All matches as (start, end, match).  The pattern must not match the empty string."""
    return pattern_spans(pattern)(text)


def line_column(text: Column, at: Column) -> Column:
    """(line, column) of an offset, both from 1."""
    before = F.substring(text, F.lit(1), at)
    breaks = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.struct((breaks + 1).alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "‘’‛“”", "'''\"\"")


def phrases(words: list[str]) -> str:
    """One alternation of phrases, longest first: spaces match any run of white space, hyphens also a space."""
    fold = str.maketrans("‘’‛“”", "'''\"\"")
    body = lambda w: "".join(r"\s+" if c == " " else r"[-\s]" if c == "-" else re.escape(c) for c in w.translate(fold))
    return "|".join(body(w) for w in sorted(dict.fromkeys(words), key=lambda w: -len(w)))


def phrase_tree(words: list[str]) -> str:
    """``phrases`` with common beginnings written once, so that fewer alternatives are tried at each place; quotes of any
    kind fit each other."""
    fold = str.maketrans("‘’‛“”", "\'\'\'\"\"")
    part = {" ": r"\s+", "-": r"[-\s]", "'": "['‘’‛]", '"': '["“”]'}
    paths = [[part.get(c, re.escape(c)) for c in w.lower().translate(fold)] for w in sorted(dict.fromkeys(words), key=lambda w: -len(w))]

    def joined(rest: list[list[str]]) -> str:
        groups: dict[str, list] = {}
        for p in rest:
            groups.setdefault(p[0] if p else "", []).append(p[1:])
        done = [k + joined(v) if k else "" for k, v in groups.items()]
        return done[0] if len(done) == 1 else "(?:" + "|".join(done) + ")"

    return joined(paths)
