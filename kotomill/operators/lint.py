"""analyze(): all enabled rules over a table of documents, and its report, in one narrow stage."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config, validate
from ..schema import FINDING
from ..sources.batches import small_batches
from .rules import NEEDS, RULES, Pass, scan_of
from .scans import register
from .structure import fresh, structured


def _config(config: Config | Any) -> Config:
    return config if isinstance(config, Config) else validate(config)


def with_findings(docs: DataFrame, config: Config | Any, text: str = "text") -> DataFrame:
    """The rows with a column ``findings``: sorted by start, end, rule, then by the order of the configuration and emission.

    A null text has null findings; an empty text has none. The configuration is checked before any plan exists.
    """
    config = _config(config)
    rules = config.enabled
    if not rules:
        return docs.withColumn("findings", F.when(F.col(text).isNotNull(), F.array().cast(f"array<{FINDING}>")))
    if any(r.rule_id == "D006" for r in rules):
        register(docs.sparkSession)
    chosen = "outside" if config.exclude_code_blocks else "sentences"
    need = tuple(dict.fromkeys(f.format(s=chosen) for r in rules for f in NEEDS.get(r.rule_id, ())))
    scans = {r.rule_id: scan for r in rules if (scan := scan_of(r))}
    small_batches(docs.sparkSession)
    name = fresh(docs.columns, "structure")
    found = docs.withColumn(name, structured(F.col(f"`{text}`"), need, scans))
    of = Pass(F.col(f"`{text}`"), F.col(name), config.exclude_code_blocks)
    every = F.flatten(F.array(*(RULES[r.rule_id](r, of) for r in rules)))
    numbered = F.transform(every, lambda f, i: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["rule_id"].alias("rule_id"), i.alias("i"), f.alias("f")))
    ordered = F.transform(F.array_sort(numbered), lambda x: x["f"])
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), ordered.alias("findings"))


def analyze(docs: DataFrame, config: Config | Any, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per finding: key, start, end, rule_id, category, severity, message, actual, threshold."""
    rows = with_findings(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), config)
    # inline() would make Spark filter on the array's size first, and so compute all findings anew for the filter
    return rows.select(F.col("key").alias(key), F.inline_outer("findings")).where("rule_id is not null")


def exit_code(findings: Column) -> Column:
    """1 if a deterministic finding is an error, else 0."""
    return F.exists(findings, lambda f: (f["category"] == "deterministic") & (f["severity"] == "error")).cast("int")
