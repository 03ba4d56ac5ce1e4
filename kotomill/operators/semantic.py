"""Saved semantic judgements: evaluation of fixtures against observed statuses. No judgement is made here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The gates that a candidate analyser has to pass, all of them.
GATES = ("maintainability", "node24_performance", "range_conversion", "determinism", "offline")
PASS = "PASS"


def status_counts(saved: DataFrame, rule: str = "ruleId", status: str = "status") -> DataFrame:
    """(rule, violation, no_violation, uncertain): how often each status was saved."""
    n = lambda s: F.sum((F.col(status) == s).cast("long")).alias(s)
    return saved.groupBy(rule).agg(n("violation"), n("no_violation"), n("uncertain"))


def evaluate(fixtures: DataFrame, observed: DataFrame, key: str = "fixtureId") -> DataFrame:
    """(rule, n, agree, passed): per rule, how many fixtures have the status that was expected; missing ones disagree."""
    both = fixtures.join(observed.select(F.col(key).alias("_key"), "observedStatus"), F.col(key) == F.col("_key"), "left")
    same = F.coalesce(F.col("expectedStatus") == F.col("observedStatus"), F.lit(False))
    return both.groupBy("ruleId").agg(F.count("*").alias("n"), F.sum(same.cast("long")).alias("agree"), F.bool_and(same).alias("passed"))


def accepted(gates: Column) -> Column:
    """Whether a map of gates has all of GATES at PASS; a gate that is missing or unknown fails."""
    return F.forall(F.array(*map(F.lit, GATES)), lambda g: F.coalesce(F.try_element_at(gates, g) == PASS, F.lit(False)))


def shown(saved: DataFrame, least: float = 0.7) -> DataFrame:
    """The judgements a reader sees by default: violations of at least this confidence."""
    return saved.where((F.col("status") == "violation") & (F.col("confidence") >= least))
