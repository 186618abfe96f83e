"""Findings rendered as JSON lines, annotations of a build, and lines for a terminal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions.text import line_column


def escaped(x: Column, properties: bool = False) -> Column:
    """Percent signs and line ends, in properties also colons and commas, as %XX."""
    for a, b in [("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *([(":", "%3A"), (",", "%2C")] if properties else [])]:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def located(found: DataFrame) -> DataFrame:
    """found (text, start, end, ...) with line, column, end_line, end_column, from 1."""
    a, z = line_column(F.col("text"), F.col("start")), line_column(F.col("text"), F.col("end"))
    return found.withColumns({"line": a["line"], "column": a["column"], "end_line": z["line"], "end_column": z["column"]})


def annotations(found: DataFrame) -> DataFrame:
    """One workflow command a finding: (path, start, rule, annotation)."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warn", "warning").otherwise("notice")
    where = F.concat(F.lit("file="), escaped(F.col("path"), True), F.lit(",line="), "line", F.lit(",col="), "column", F.lit(",endLine="), "end_line", F.lit(",endColumn="), "end_column", F.lit(",title="), escaped(F.col("rule"), True))
    line = F.concat(F.lit("::"), level, F.lit(" "), where, F.lit("::"), escaped(F.col("message")))
    return located(found).select("path", "start", "rule", line.alias("annotation"))


def stylish(found: DataFrame) -> DataFrame:
    """One aligned line a finding: (path, start, rule, line_text)."""
    where = F.lpad(F.concat(F.col("line"), F.lit(":"), F.col("column")), 9, " ")
    line = F.concat(F.lit("  "), where, F.lit("  "), F.rpad("severity", 7, " "), F.lit("  "), "message", F.lit("  "), "rule")
    return located(found).select("path", "start", "rule", line.alias("line_text"))


def compact(found: DataFrame, examples: int = 3, width: int = 60) -> DataFrame:
    """One line a severity and rule: how often, and its first distinct excerpts by path and start.

    Excerpts of one character don't count as examples.  Equal excerpts are reduced to their first place
    before they are ranked.
    """
    plain = F.trim(F.regexp_replace("match", "[ \t\n\r]+", " "))
    excerpt = F.when(F.length(plain) > width, F.concat(F.substring(plain, 1, width - 1), F.lit("…"))).otherwise(plain)
    f = found.select("severity", "rule", "path", "start", excerpt.alias("excerpt"))
    first = f.where(F.length("excerpt") > 1).groupBy("severity", "rule", "excerpt").agg(F.min(F.struct("path", "start")).alias("at"))
    shown = _least(first, examples)
    counts = f.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))
    out = counts.join(shown, ["severity", "rule"], "left")
    some = F.coalesce("x", F.array().cast("array<string>"))
    more = F.col("n") - F.size(some)
    tail = F.when(F.size(some) > 0, F.concat(F.lit(" Examples: "), F.array_join(F.transform(some, lambda e: F.concat(F.lit("“"), e, F.lit("”"))), "; "), F.when(more > 0, F.concat(F.lit("; +"), more, F.lit(" more"))).otherwise(""))).otherwise("")
    return out.select("severity", "rule", "n", F.concat("rule", F.lit(" ["), F.when(F.col("severity") == "warn", "warning").otherwise(F.col("severity")), F.lit("] ×"), "n", tail).alias("summary"))


def _least(first: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("severity", "rule").orderBy("at")
    return first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("severity", "rule").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "excerpt"))), lambda x: x["excerpt"]).alias("x"))


def json_lines(report: DataFrame) -> DataFrame:
    """One JSON object a document of a report (path, n_words, counts, per_thousand)."""
    x = F.struct(F.col("path").alias("filePath"), F.col("error_count").alias("errorCount"), F.col("warn_count").alias("warningCount"), F.col("info_count").alias("infoCount"), F.col("n_words").alias("wordCount"), F.col("per_thousand").alias("findingsPerThousandWords"))
    return report.select("path", F.to_json(x).alias("json"))


def exit_status(report: DataFrame, most_warnings: int = -1, *, exit_zero: bool = False) -> DataFrame:
    """One row: totals, and the status: 2 where a document could not be read (a column ``status`` says runtime-error), 1
    where there is an error or more warnings than allowed (-1: any number), else 0.  ``exit_zero`` forgives findings,
    never failures."""
    failed = F.count_if(F.col("status") == "runtime-error") if "status" in report.columns else F.lit(0)
    t = report.agg(*(F.coalesce(F.sum(f"{s}_count"), F.lit(0)).alias(f"{s}_count") for s in ("error", "warn", "info")), failed.alias("failed"))
    bad = (F.col("error_count") > 0) | ((F.lit(most_warnings) >= 0) & (F.col("warn_count") > most_warnings))
    status = F.when(F.col("failed") > 0, 2).when(bad & F.lit(not exit_zero), 1).otherwise(0).cast("long")
    return t.withColumn("status", status).select(*t.columns[:3], *(["failed"] if "status" in report.columns else []), "status")
