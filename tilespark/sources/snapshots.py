"""Tables under numbered snapshots with a pointer that is moved last: readers see all tables of a commit or none."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coverage import overlapping_pairs


class OverlapError(ValueError):
    """Resolved leaves of a run share a day."""


def current(spark: SparkSession, base: str) -> str | None:
    """The folder of the latest commit; null before the first."""
    try:
        log = spark.read.schema("number bigint, folder string").json(f"{base}/_commits")
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise
    row = log.orderBy(F.col("number").desc(), "folder").limit(1).collect()
    return row[0]["folder"] if row else None


def commit(spark: SparkSession, base: str, tables: dict[str, DataFrame], leaves: DataFrame | None = None) -> str:
    """Writes the tables under a new folder and then the pointer. leaves (run, id, ini, fim) must not overlap; they are
    checked first. There is one writer at a time; inputs may be the current snapshot's tables."""
    if leaves is not None and overlapping_pairs(leaves).limit(1).count():
        raise OverlapError("resolved leaves share a day")
    folder = f"snapshot={uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{base}/{folder}/{name}")
    before = current(spark, base)
    number = 1 if before is None else spark.read.schema("number bigint, folder string").json(f"{base}/_commits").agg(F.max("number")).first()[0] + 1
    spark.createDataFrame([(number, folder)], "number bigint, folder string").coalesce(1).write.mode("append").json(f"{base}/_commits")
    return folder


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{current(spark, base)}/{name}")
