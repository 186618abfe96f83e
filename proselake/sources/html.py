"""HTML pages to prose with DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proselake.sources.masking import rebuilt

# Elements whose content is not prose, elements that make a block, named entities.
HIDDEN = ["head", "script", "style", "template", "svg", "noscript", "code", "pre"]
BLOCKS = ["address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "hellip": "…", "laquo": "«", "ldquo": "“", "lsquo": "‘", "lt": "<", "mdash": "—", "nbsp": "\u00a0", "ndash": "–", "quot": '"', "raquo": "»", "rdquo": "”", "rsquo": "’"}
REST = r"(?:[^a-zA-Z0-9:_>-](?:\"[^\"]*\"|'[^']*'|[^'\">])*)?(?:>|\z)"
COMMENT = r"<!--[\s\S]*?(?:-->|\z)"
TAG = r"<(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|\z)"
ENTITY = r"(?i)&(?:#\d+|#x[\da-f]+|[a-z][\da-z]+);"


def hidden(tag: str) -> str:
    """An element with all it holds, or to the end where it is not closed."""
    return rf"(?i)<{tag}{REST}[\s\S]*?(?:</{tag}\s*>|\z)"


def _decoded(e: Column) -> Column:
    body = F.substring(e, F.lit(2), F.length(e) - 2)
    point = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).when(body.startswith("#"), F.substring(body, F.lit(2), F.length(body)))
    char = F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")
    named = F.element_at(F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv)), body)
    return F.when(body.startswith("#"), F.when(point.cast("long").between(1, 0x10FFFF), char).otherwise(e)).otherwise(F.coalesce(named, e))


def html_text(html: Column) -> Column:
    """Comments and hidden elements go, block tags become an empty line, br a line end, other tags one space
    where none stands before them; then entities are decoded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), COMMENT, "")
    for tag in HIDDEN:
        out = F.regexp_replace(out, hidden(tag), "\x02")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCKS)}){REST}", "\x03")
    out = F.regexp_replace(out, rf"(?i)<br{REST}", "\n")
    out = F.regexp_replace(out, TAG, "\x02")
    out = F.regexp_replace(out, "^[\x02\x03]+", "")
    out = F.regexp_replace(out, "(\n?)\x02*\x03[\x02\x03]*", "$1\n\n")
    out = F.regexp_replace(F.regexp_replace(out, "(\\s)\x02+", "$1"), "\x02+", " ")
    return rebuilt(out, ENTITY, lambda h: F.when(h == "", h).otherwise(_decoded(h)), lambda g: g)
