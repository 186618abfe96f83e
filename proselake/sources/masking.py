"""Prose of code, Markdown and HTML at its original offsets: what is not prose is blanked, line ends stay."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions.text import filled, let, word_count

# Quotes, comment markers by family of extensions, parts of Markdown that are not prose.
DOUBLE, SINGLE, TICK = r'"[^"\\]*(?:\\[\s\S][^"\\]*)*(?:"|\z)', r"'[^'\\]*(?:\\[\s\S][^'\\]*)*(?:'|\z)", r"`[^`\\]*(?:\\[\s\S][^`\\]*)*(?:`|\z)"
QUOTED = f"{DOUBLE}|{SINGLE}|{TICK}"
C_STYLE = QUOTED + r"|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
HASH = QUOTED + r"|#[^\n]*"
DASH = QUOTED + r"|--[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
MARKUP = QUOTED + r"|<!--[\s\S]*?(?:-->|\z)"
FAMILIES = {"hash": ["py", "rb", "sh", "yaml", "yml", "toml", "r"], "dash": ["sql", "lua", "hs"], "markup": ["vue", "svelte", "xml"]}
FRONTMATTER = r"\A---\r?\n[\s\S]*?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)"
FENCE = r"(?m)^ {0,3}```[^\n]*(?:\n[\s\S]*?(?:^ {0,3}```+[ \t]*$|\z)|\z)|^ {0,3}~~~[^\n]*(?:\n[\s\S]*?(?:^ {0,3}~~~+[ \t]*$|\z)|\z)"
INDENTED = r"(?m)^(?: {4}|\t)[^\n]*"
MARKS = [r'(?:"[^"\n]+"|“[^”\n]+”)\s*\[\^[^\]]+\]', r"`+[^`\n]*`+", r"!\[[^\]\n]*\]\([^\n)]*\)", r"\[\^[^\]]+\]", r"(?m)^ {0,3}>[^\n]*", r"<[^>]+>"]
LINK = r"\]\([^\n)]*\)"
#: Signs of which a text with a match of the pattern holds one.
NEEDS = {FRONTMATTER: ["---"], FENCE: ["```", "~~~"], INDENTED: ["    ", "\t"], LINK: ["]("], **dict(zip(MARKS, [["[^"], ["`"], ["!["], ["[^"], [">"], ["<"]], strict=True))}


def blanked(x: Column) -> Column:
    """Spaces as long as x, but its line ends; most x have none."""
    return F.when(F.contains(x, F.lit("\n")) | F.contains(x, F.lit("\r")), F.regexp_replace(x, r"[^\n\r]", " ")).otherwise(F.repeat(F.lit(" "), F.length(x)))


def rebuilt(text: Column, pattern: str, hit, gap) -> Column:
    """text with each match and each stretch between matches replaced by hit(x) and gap(x)."""
    both = lambda x: F.array_join(F.transform(F.arrays_zip(x["g"].alias("g"), F.concat(x["h"], F.array(F.lit(""))).alias("h")), lambda z: F.concat(gap(z["g"]), hit(z["h"]))), "")
    return let(text, lambda t: let(F.struct(F.split(t, pattern, -1).alias("g"), F.regexp_extract_all(t, F.lit(f"({pattern})"), 1).alias("h")), both))


def replaced(text: Column, pattern: str, hit) -> Column:
    """text with each match of a pattern of NEEDS replaced by hit(x); one without its signs isn't searched."""
    held = lambda t: functools.reduce(lambda a, b: a | b, (F.contains(t, F.lit(x)) for x in NEEDS[pattern]))
    return let(text, lambda t: F.when(held(t), rebuilt(t, pattern, hit, lambda g: g)).otherwise(t))


def _comment(x: Column) -> Column:
    """A comment without its markers and margins, a long template without its expressions; quotes blanked."""
    line = F.regexp_replace(x, r"^(?://|#|--)", "")
    body = F.regexp_replace(F.regexp_replace(x, r"^(?:/\*|<!--)", ""), r"(?:\*/|-->)\z", "")
    lead = F.when(x.startswith("<!--"), F.lit("    ")).when(x.startswith("/*"), F.lit("  "))
    tail = F.when(x.endswith("-->"), F.lit("   ")).when(x.endswith("*/"), F.lit("  ")).otherwise(F.lit(""))
    block = F.concat(lead, F.regexp_replace(body, r"(\n[ \t]*)\*", "$1 "), tail)
    template = F.regexp_replace(rebuilt(x, r"\$\{[^}]*\}", blanked, lambda g: g), "`", " ")
    return (
        F.when(x.rlike("^(?:/\\*|<!--)"), block)
        .when(x.rlike("^(?://|#|--)"), F.concat(F.when(x.startswith("#"), " ").otherwise("  "), line))
        .when(x.startswith("`") & F.contains(x, F.lit("\n")) & (word_count(x) >= 5), template)
        .otherwise(blanked(x))
    )


def comments(text: Column, extension: Column) -> Column:
    """Only the comments of source code, by the family of its extension."""
    t = filled(text)
    of = lambda pattern: rebuilt(t, pattern, _comment, blanked)
    return F.when(extension.isin(FAMILIES["hash"]), of(HASH)).when(extension.isin(FAMILIES["dash"]), of(DASH)).when(extension.isin(FAMILIES["markup"]), of(MARKUP)).otherwise(of(C_STYLE))


def markdown(text: Column) -> Column:
    """Markdown without front matter, code, quotations, targets of links, notes and tags; U+2029 after list marks."""
    t = filled(text)
    for pattern in (FRONTMATTER, FENCE, INDENTED):
        t = replaced(t, pattern, blanked)
    t = F.regexp_replace(t, r"(?m)^([ \t]*(?:[-+*]|\d+[.)])) ", "$1\u2029")
    for pattern in MARKS[:3]:
        t = replaced(t, pattern, blanked)
    t = replaced(t, LINK, lambda h: F.when(h != "", F.concat(F.lit("]"), F.repeat(F.lit(" "), F.length(h) - 1))).otherwise(h))
    for pattern in MARKS[3:]:
        t = replaced(t, pattern, blanked)
    return t


def headings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, start, depth, title, end, parent): sections of Markdown.

    A section ends where the next heading of its depth or less begins; its parent is the nearest heading before
    of a lesser depth.  Lines of fenced code are no headings.
    """
    plain = rebuilt(rebuilt(filled(F.col("text")), FRONTMATTER, blanked, lambda g: g), FENCE, blanked, lambda g: g)
    lines = F.split(plain, "\n", -1)
    d = docs.select("doc_id", F.length("text").alias("size"), F.posexplode_outer(lines).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    d = d.withColumn("start", (F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long"))
    mark = F.regexp_extract("line", r"^ {0,3}(#{1,6})[ \t]+\S", 1)
    h = d.where(mark != "").select("doc_id", "size", "start", F.length(mark).alias("depth"), F.regexp_extract("line", r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t\r]*$", 1).alias("title"))
    up = lambda k: F.max(F.when(F.col("depth") == k, F.col("start"))).over(Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    down = lambda k: F.min(F.when(F.col("depth") <= k, F.col("start"))).over(Window.partitionBy("doc_id").orderBy("start").rowsBetween(1, Window.unboundedFollowing))
    end, parent = F.col("size").cast("long"), F.lit(None).cast("long")
    for k in range(1, 7):
        end = F.when(F.col("depth") == k, F.coalesce(down(k), F.col("size").cast("long"))).otherwise(end)
        if k > 1:
            parent = F.when(F.col("depth") == k, F.greatest(*(up(j) for j in range(1, k)), F.lit(None).cast("long"))).otherwise(parent)
    return h.select("doc_id", "start", F.col("depth").cast("long").alias("depth"), "title", end.alias("end"), parent.alias("parent"))
