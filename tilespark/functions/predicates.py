"""Predicates that may be absent, merges of maps, and order by language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def optional(column: Column, value) -> Column:
    """Equality with a parameter; true for all rows, nulls too, where the parameter is None."""
    return F.lit(True) if value is None else column == F.lit(value)


def merged(first: Column, second: Column) -> Column:
    """Both maps' entries; where both have a key, the second one's value. A null map is empty."""
    empty = F.create_map()
    first, second = F.coalesce(first, empty), F.coalesce(second, empty)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def in_language(text: Column, language: str = "pt") -> Column:
    """The text as an ordering key of a language: accents and case count only between words that are else equal."""
    return F.collate(text, language)
