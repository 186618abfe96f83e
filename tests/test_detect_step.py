"""The detectors' step: what is not looked for, links between pieces, slices."""

import random
import re._constants as C
import re._parser as parser

import pyarrow as pa

from proselake.functions import places
from proselake.functions.places import Alike
from proselake.operators import detect

P = detect.PLACES


def written(tree, rnd):
    """A text that a parsed pattern may match."""
    out = ""
    for op, v in tree:
        if op is C.LITERAL:
            out += chr(v)
        elif op is C.BRANCH:
            out += written(rnd.choice(v[1]), rnd)
        elif op is C.SUBPATTERN:
            out += written(v[3], rnd)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += "".join(written(v[2], rnd) for _ in range(rnd.randint(v[0], min(v[1], v[0] + 2))))
        elif op is C.IN and v[0][0] is not C.NEGATE:
            kind, x = rnd.choice(v)
            out += chr(x) if kind is C.LITERAL else chr(rnd.randint(*x)) if kind is C.RANGE else {C.CATEGORY_SPACE: " ", C.CATEGORY_DIGIT: "7"}[x]
        elif op is C.IN or op is C.NOT_LITERAL:
            out += "q"
        elif op is C.ASSERT and v[0] == 1:
            out += written(v[1], rnd)
    return out


def test_patterns_are_looked_for_wherever_they_match():
    rnd, seen = random.Random(1), set()
    for of in (P.anywhere, P.heads, P.tails, P.counts):
        for name, f in P.finders(of).items():
            tree = parser.parse(of[name].replace("(?i)", "").replace("(?u)", ""))
            for _ in range(400):
                piece = written(tree, rnd)
                text = ("" if of is P.heads else rnd.choice(["", "x ", "é", "9 "])) + rnd.choice([piece, piece.upper(), piece.capitalize()]) + rnd.choice(["", " y", "é", "."])
                low = places.lowered(text)
                if (f.pattern.match if of is P.heads else f.pattern.search)(low if f.low else text):
                    seen.add(name)
                    assert f.may(set(places._RUN.findall(low)), "\n" + text), (name, text)
    assert len(seen) >= 40
    # A text of other words is not searched for phrases.
    assert sum(f.may({"rivers", "flow"}, "\nRivers flow.") for f in P.finders(P.anywhere).values()) < 10


def test_links_equal_all_comparisons():
    rnd, a = random.Random(2), Alike(frozenset(["the"]), (5, 2, 0.6), (6, 1, 0.48))
    rows = [a.stems(" ".join(rnd.choice(["walk", "walks", "walking", "house's", "red", "the", "door", "trees", "tall", "made"]) for _ in range(rnd.randint(2, 12))), 0) for _ in range(300)]
    want = []
    for i, mine in enumerate(rows):
        near = [(len(mine & o) / min(len(mine), len(o)), -j) for j in range(max(0, i - 4), i - 1) if len(o := rows[j]) >= 5 and len(mine & o) >= 5]
        if len(mine) >= 5 and near and max(near)[0] >= 0.6:
            want.append((i, -max(near)[1], max(near)[0]))
    assert want and [x[:3] for x in a.links(rows, *a.sents)] == want


def test_what_is_found_goes_on_in_slices(spark):
    texts = pa.array(["It is sorry. " * 3] * 1000)
    parts = list(places.places(P).func(iter([texts])))
    assert max(map(len, parts)) <= places.SLICE and sum(map(len, parts)) == 1000
