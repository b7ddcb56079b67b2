"""The quality suite: each check is an aggregate with a verdict, a severity and its evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the checks tolerate.
NULL_RATE, BAD_DIGITS, BAD_DATES, NO_PARTY, DRIFT, MIN_BLOB = 0.05, 0.01, 0.05, 0.02, 0.1, 1_024


@dataclass(frozen=True)
class Check:
    """rows: one row with the named counts; ok: a verdict from them; evidence: the count to show."""

    id: str
    severity: str
    rows: DataFrame
    ok: Column
    evidence: Column


def share(part: str, total: str) -> Column:
    """part / total, 0 for nothing."""
    return F.when(F.col(total) > 0, F.col(part) / F.col(total)).otherwise(F.lit(0.0))


def report(checks: list[Check]) -> DataFrame:
    """(id, severity, ok, evidence), a row for each check; each reads its own aggregate."""
    out = None
    for c in checks:
        row = c.rows.select(F.lit(c.id).alias("id"), F.lit(c.severity).alias("severity"), c.ok.alias("ok"), c.evidence.cast("bigint").alias("evidence"))
        out = row if out is None else out.unionByName(row)
    return out


def passed(report_rows: DataFrame) -> DataFrame:
    """Overall ok: no check of severity error failed."""
    return report_rows.agg((F.count_if(~F.col("ok") & (F.col("severity") == "error")) == 0).alias("ok"))


def without_children(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """(total, without): parents, and those that no child has."""
    lonely = parents.join(children.select(*keys), keys, "left_anti").agg(F.count("*").alias("without"))
    return parents.agg(F.count("*").alias("total")).join(lonely)


def drift(stored: DataFrame, now: DataFrame, key: str, tolerance: float = DRIFT) -> DataFrame:
    """(key, stored, now, drifted): leaves whose count moved by more than the tolerance."""
    both = stored.join(now, key, "left").withColumn("now", F.coalesce("now", F.lit(0).cast("bigint")))
    return both.withColumn("drifted", F.abs(F.col("now") - F.col("stored")) / F.col("stored") > tolerance)
