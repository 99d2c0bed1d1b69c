"""Operators over tables of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keysweep.schemas import FINDING_KEY


def dedupe(findings: DataFrame) -> DataFrame:
    """One row per (file, line, type, match); which commit survives is open, as for any first-come rule."""
    if set(findings.columns) == set(FINDING_KEY):
        return findings.distinct()
    return findings.dropDuplicates(FINDING_KEY)


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*FINDING_KEY)


def count_findings(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total_findings"))


def count_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").alias("n_findings"))


def count_by_rule(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits of every rule, with 0 for rules that never matched."""
    counts = count_by_type(findings).withColumnRenamed("type", "name")
    return rules.join(counts, "name", "left").select(
        "rule_id", "name", F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"))
