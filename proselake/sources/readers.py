"""Tables and whole-text files as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never read.
IGNORED = ["node_modules", ".git", "dist", "build", "coverage"]
#: Extensions by kind.
PROSE = ["md", "mdx", "txt", "html", "htm", "astro"]
COMMENTS = ["py", "rb", "sh", "yaml", "yml", "toml", "r", "sql", "lua", "hs", "vue", "svelte", "xml", "js", "ts", "jsx", "tsx", "c", "h", "cpp", "go", "rs", "java", "css"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt anew if its scan has fewer partitions than the cluster has cores, as one large row group has.

    For steps that take far longer for a text than moving it; a scan of many partitions stays as it is.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(2 * cores) if docs.rdd.getNumPartitions() < cores else docs


def input_kind(path):
    """prose, comments or null, from the extension (query and fragment stripped)."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(path, "[?#].*$", ""), r"[^/\\.][^/\\]*\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(PROSE), "prose").when(ext.isin(COMMENTS), "comments")


def ignore_pattern(lines: list[str]) -> str | None:
    """One regular expression for ignore rules (name, name/, /path, *, **, ?) on paths below a folder; comments and
    empty lines don't count, negations are not supported and raise."""
    out = []
    for line in lines:
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        if rule.startswith("!"):
            raise ValueError(f"negated rule: {rule}")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        rooted = "/" in rule
        body, i = "", 0
        rule = rule.lstrip("/")
        while i < len(rule):
            if rule.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif rule.startswith("**", i):
                body, i = body + ".*", i + 2
            else:
                body, i = body + {"*": "[^/]*", "?": "[^/]"}.get(rule[i], re.escape(rule[i])), i + 1
        out.append(("^" if rooted else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"))
    return "|".join(out) or None


def files(spark: SparkSession, path: str, *, ignore: list[str] | None = None, no_ignore: bool = False, extensions: list[str] | None = None) -> DataFrame:
    """(path, kind, text) of the readable files below a folder, or of one file.

    Left out below a folder: dot files and folders, the IGNORED folders, and what ``ignore`` names (rules as in
    ignore files); ``no_ignore`` switches the last two off.  Rules see the path below the folder only.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = re.sub(r"^[a-z]+:/+", "/", path).rstrip("/") + "/"
    local = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + re.escape(root), "")
    out = raw.withColumns({"local": local, "kind": input_kind(F.col("path"))}).where("kind is not null")
    out = out.where(~F.col("local").rlike(r"(?:^|/)\.") | F.col("local").startswith("/"))
    rules = None if no_ignore else ignore_pattern([x + "/" for x in IGNORED] + (ignore or []))
    if rules:
        out = out.where(~F.col("local").rlike(rules) | F.col("local").startswith("/"))
    if extensions:
        out = out.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin([x.lower().lstrip(".") for x in extensions]))
    return out.select("path", "kind", F.decode("content", "UTF-8").alias("text")).distinct()
