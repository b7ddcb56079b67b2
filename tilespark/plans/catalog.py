"""All queries of the engine, with their SQL where SQL can express them."""

from __future__ import annotations

from . import aggregates, coverage, extraction, jobs, lifecycle, quality, scalars, sites, streams
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "coverage", "extraction", "jobs", "lifecycle", "quality", "scalars", "sites", "streams"]
