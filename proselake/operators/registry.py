"""The catalogue of rules, packs of them, and layered configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.operators.detect import CATEGORY, RANK, SEVERITY
from proselake.operators.score import WEIGHT

#: Rules of each pack that need no parse.
PACKS = {
    "craft": ["apology-reflex", "verdict-word", "verdict-echo", "hedge-phrase", "parenthetical-hedge"],
    "reader-first": ["paragraph-load", "unexplained-initialism", "list-without-break"],
}
PACKS["ai-style"] = [r for r in CATEGORY if not any(r in rules for rules in PACKS.values())]


@dataclass(frozen=True)
class Config:
    """Severities by rule ("off", "info", "warn", "error" or "auto"), and the least that is shown."""

    rules: dict[str, str] = field(default_factory=dict)
    least: str = "info"

    def __post_init__(self) -> None:
        unknown = set(self.rules) - set(CATEGORY)
        if unknown:
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        bad = set(self.rules.values()) - {*RANK, "auto"}
        if bad or self.least not in RANK:
            raise ValueError(f"unknown severities: {sorted(bad | {self.least} - set(RANK))}")


def preset(*packs: str) -> Config:
    """All rules of the packs by their own severity, all others off."""
    on = {r for p in packs for r in PACKS[p]}
    return Config({r: "auto" if r in on else "off" for r in CATEGORY})


def load(path: str) -> Config:
    """A configuration from a JSON file: {"packs": [...], "rules": {...}, "least": "..."}, all optional."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    own = Config(raw.get("rules", {}), raw.get("least", "info"))
    return layered(preset(*raw["packs"]), own) if "packs" in raw else own


def layered(*configs: Config) -> Config:
    """Later ones win, rule by rule."""
    rules: dict[str, str] = {}
    for c in configs:
        rules |= c.rules
    return Config(rules, configs[-1].least if configs else "info")


def configured(found: DataFrame, config: Config) -> DataFrame:
    """Findings (rule, severity, ...) under a configuration: severities replaced, those off or below ``least`` gone."""
    own = F.lit(None).cast("string")
    for rule, severity in config.rules.items():
        if severity != "auto":
            own = F.when(F.col("rule") == rule, severity).otherwise(own)
    out = found.withColumn("severity", F.coalesce(own, F.col("severity")))
    return out.where(F.col("severity").isin([k for k, v in RANK.items() if v >= max(1, RANK[config.least])]))


def catalogue(spark: SparkSession) -> DataFrame:
    """pack, rule, category, weight, severity of every rule."""
    rows = [(p, r, CATEGORY[r], float(WEIGHT.get(CATEGORY[r], 1)), SEVERITY.get(r, "auto")) for p, rules in PACKS.items() for r in rules]
    return spark.createDataFrame(rows, "pack string, rule string, category string, weight double, severity string")
