"""Settings of a run: flags, else the session's `spark.tilespark.*`, else TILESPARK_* of the environment, else defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from .operators.workqueue import LEASE_MS, MAX_ATTEMPTS


@dataclass(frozen=True)
class Settings:
    cap: int = 30
    concurrency: int = 4
    lease_ms: int = LEASE_MS
    max_attempts: int = MAX_ATTEMPTS
    anonymize: bool = False


def _parsed(name: str, kind: str, value):
    if kind == "bool":
        known = {"true": True, "1": True, "false": False, "0": False}
        if str(value).lower() not in known:
            raise ValueError(f"{name}: {value!r} is neither true nor false")
        return known[str(value).lower()]
    try:
        number = int(str(value))
    except ValueError:
        raise ValueError(f"{name}: {value!r} is no whole number") from None
    if number < 1:
        raise ValueError(f"{name}: {number} is less than 1")
    return number


def settings(spark: SparkSession, environ=os.environ, **flags) -> Settings:
    """All values are looked at now, so a bad one stops a run before it begins. Unknown flags are errors; a flag of None is none."""
    unknown = set(flags) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    out = {}
    for f in fields(Settings):
        given = [flags.get(f.name), spark.conf.get(f"spark.tilespark.{f.name}", None), environ.get(f"TILESPARK_{f.name.upper()}")]
        value = next((v for v in given if v is not None), None)
        if value is not None:
            out[f.name] = _parsed(f.name, f.type, value)
    return Settings(**out)
