"""Readers of line-based records: agent transcripts, CoNLL-U, changed files, glossaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.operators.graph import TOKENS

#: JSON of the three transcript dialects; lines that don't parse are left out.
_RECORD = "type string, message struct<role:string,content:string>, payload struct<type:string,role:string,turn_id:string,content:string>"
_BLOCKS = "array<struct<type:string,text:string>>"


def _texts(content: Column, kind: str) -> Column:
    """The text of a content: a plain string, or its blocks of one kind, a line each."""
    blocks = F.from_json(content, _BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == kind) & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    return F.when(content.startswith("["), joined).otherwise(content)


def transcript_messages(lines: DataFrame, turn: str | None = None, most: int = 20) -> DataFrame:
    """lines (file, line_no, line) -> (file, line_no, text): what the assistant said in the current turn.

    The dialect of a file is told by its records.  The turn begins after the last message of a person (or after
    the last context of ``turn``); of its messages the last ``most`` are kept.  A file being appended to may end
    in half a line; unknown records are passed over.
    """
    r = lines.withColumn("r", F.from_json("line", _RECORD, {"mode": "PERMISSIVE"})).where("r is not null and r.type is not null")
    r = r.select("file", "line_no", "r.*")
    role, p = F.col("message.role"), F.col("payload")
    a = ((F.col("type") == "assistant") & (role == "assistant"), (F.col("type") == "user") & (role == "user") & (~F.col("message.content").startswith("[") | F.exists(F.from_json("message.content", _BLOCKS), lambda b: b["type"] == "text")))
    context = (F.col("type") == "turn_context") & (p["turn_id"] == turn) if turn else (F.col("type") == "response_item") & (p["type"] == "message") & (p["role"] == "user")
    b = ((F.col("type") == "response_item") & (p["type"] == "message") & (p["role"] == "assistant"), context)
    c = ((F.col("type") == "message") & (role == "assistant"), (F.col("type") == "message") & (role == "user"))
    whole = Window.partitionBy("file")
    any_of = lambda test: F.max(F.coalesce(test, F.lit(False))).over(whole)
    kind = F.when(any_of(F.col("type").isin("response_item", "turn_context")), "b").when(any_of(a[0]), "a").when(any_of((F.col("type") == "message") & role.isNotNull()), "c")
    r = r.withColumn("kind", kind)
    pick = lambda i: F.coalesce(F.when(F.col("kind") == "a", a[i]).when(F.col("kind") == "b", b[i]).when(F.col("kind") == "c", c[i]), F.lit(False))
    text = F.when(F.col("kind") == "b", _texts(p["content"], "output_text")).when(role == "assistant", F.when(F.col("message.content").startswith("["), _texts(F.col("message.content"), "text")))
    r = r.withColumns({"said": pick(0), "last": F.max(F.when(pick(1), F.col("line_no"))).over(whole), "text": F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "^[ \t\n\r]+|[ \t\n\r]+$", ""))})
    now = r.where("said and text <> '' and (last is null or line_no > last)")
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("line_no")))
    return now.withColumn("place", place).where(F.col("place") <= most).select("file", "line_no", "text")


def conllu_sentences(files: DataFrame) -> DataFrame:
    """files (path, text) -> (path, sent_idx, family, text, tokens, lemmas, weights); ranges and empty nodes are left out."""
    blocks = F.split(F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "^\n+|\n+$", ""), "\n\n+")
    s = files.select("path", F.posexplode(blocks).alias("sent_idx", "block")).withColumn("lines", F.split("block", "\n"))
    meta = lambda k: F.get(F.filter(F.transform("lines", lambda x: F.regexp_extract(x, rf"^# *{k} *= *(.*)$", 1)), lambda x: x != ""), F.lit(0))
    cells = F.transform(F.filter("lines", lambda x: x.rlike("^[0-9]+\t")), lambda x: F.split(x, "\t"))
    s = s.withColumn("cells", cells).where(F.size("cells") > 0)
    words = F.transform("cells", lambda c: F.get(c, F.lit(1)))
    s = s.withColumn("words", words)
    token = F.transform("cells", lambda c, i: F.struct(F.get(c, F.lit(0)).cast("int").alias("id"), F.get(c, F.lit(1)).alias("form"), F.get(c, F.lit(3)).alias("upos"), F.get(c, F.lit(6)).cast("int").alias("head"), F.get(c, F.lit(7)).alias("deprel"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    lemma = F.transform("cells", lambda c: F.lower(F.when(F.get(c, F.lit(2)).isin("_", ""), F.get(c, F.lit(1))).otherwise(F.get(c, F.lit(2)))))
    weight = F.transform("cells", lambda c: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.get(c, F.lit(9)), F.lit("")), r"(?:^|\|)RuleWeight=([0-9.]+)", 1), F.lit("")).cast("double"), F.lit(1.0)))
    return s.select("path", "sent_idx", F.coalesce(meta("family"), F.lit("unknown")).alias("family"), F.coalesce(meta("text"), F.array_join("words", " ")).alias("text"), token.cast(TOKENS).alias("tokens"), lemma.alias("lemmas"), weight.alias("weights"))


def changed_files(status: str, root: str) -> list[str]:
    """Paths of a NUL-separated porcelain status: deleted files left out, of renames the new name; sorted."""
    fields, out, i = status.split("\0"), set(), 0
    while i < len(fields):
        f = fields[i]
        i += 1
        if not f:
            continue
        if len(f) < 4 or f[2] != " ":
            raise ValueError("not a porcelain status")
        kind, path = f[:2], f[3:]
        if "R" in kind or "C" in kind:
            i += 1
        if "D" in kind:
            continue
        parts: list[str] = []
        for part in path.split("/"):
            if part == "..":
                if not parts:
                    raise ValueError(f"outside the repository: {path}")
                parts.pop()
            elif part not in ("", "."):
                parts.append(part)
        out.add("/".join([root.rstrip("/"), *parts]))
    return sorted(out)


def glossary(records: DataFrame) -> DataFrame:
    """records (layer int, term, surfaces array, ...) -> a row for each way of writing, by folded key."""
    key = lambda x: F.lower(F.normalize(x, F.lit("NFKC"))) if hasattr(F, "normalize") else F.lower(x)
    return records.withColumn("key", F.explode(F.array_distinct(F.transform(F.concat(F.array("term"), F.coalesce("surfaces", F.array().cast("array<string>"))), key))))


def looked_up(words: DataFrame, entries: DataFrame) -> DataFrame:
    """words (doc_id, word) with the entries of the highest layer that knows the word; the glossary is the small side,
    which Spark broadcasts only below its own threshold."""
    both = words.withColumn("key", F.lower("word")).join(entries, "key")
    top = F.max("layer").over(Window.partitionBy("doc_id", "key"))
    return both.withColumn("top", top).where("layer = top").drop("top", "key")
