"""Idempotent upserts by content hash, as joins that make the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last by order: duplicates within a batch are settled before it meets the snapshot."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))).where("_k = 1").drop("_k")


def outcomes(old: DataFrame, new: DataFrame, keys: list[str], content: str = "content_hash") -> DataFrame:
    """(keys, outcome): inserted, updated, unchanged, or kept for keys that the batch doesn't have."""
    a = old.select(*keys, F.col(content).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    outcome = (
        F.when(F.col("_in_old").isNull(), "inserted").when(F.col("_in_new").isNull(), "kept")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "updated").otherwise("unchanged")
    )
    return a.join(b, keys, "full_outer").select(*keys, outcome.alias("outcome"))


def next_snapshot(old: DataFrame, new: DataFrame, keys: list[str], content: str = "content_hash") -> DataFrame:
    """Rows of the batch in place of the old ones whose content differs; all other old rows as they are."""
    same = old.select(*keys, F.col(content).alias("_c"))
    changed = new.join(same, keys, "left").where(~F.col("_c").eqNullSafe(F.col(content))).drop("_c")
    return old.join(changed.select(*keys), keys, "left_anti").unionByName(changed)


def replace_children(old: DataFrame, new: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Children of the touched parents come from the batch, all others stay."""
    return old.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(new.join(touched.select(*keys).distinct(), keys, "left_semi"))


def insert_if_absent(known: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows, one for each key, whose key isn't known."""
    return incoming.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")
