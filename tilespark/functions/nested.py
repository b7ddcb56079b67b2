"""Values of any depth, walked by their type: every expression stays a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .text import has_mojibake

# Fields that describe an observation, not what was observed.
VOLATILE = ("listedAt", "detailedAt", "contentHash", "partitionId", "ca")


def canonical(value: Column, kind: DataType, volatile: tuple[str, ...] = VOLATILE) -> Column:
    """The value with the fields of structs and the keys of maps in order, at every depth, and without the volatile ones.
    Nulls stay null and arrays keep their order."""
    if isinstance(kind, StructType):
        kept = sorted((f for f in kind.fields if f.name not in volatile), key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[canonical(value.getField(f.name), f.dataType, volatile).alias(f.name) for f in kept])) if kept else F.when(value.isNotNull(), F.create_map())
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType, volatile))
    if isinstance(kind, MapType):
        kept = F.filter(F.map_entries(value), lambda e: ~e["key"].cast("string").isin(list(volatile)))
        ordered = F.array_sort(kept, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType, volatile).alias("value"))))
    return value


def canonical_text(value: Column, kind: DataType, volatile: tuple[str, ...] = VOLATILE) -> Column:
    """The canonical value of a struct, array or map as JSON; a null value gives null."""
    return F.to_json(canonical(value, kind, volatile), {"ignoreNullFields": "false"})


def texts(value: Column, kind: DataType) -> Column:
    """All strings within a value, null ones left out; keys of maps are no values."""
    none = F.array().cast("array<string>")
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(value)).otherwise(none)
    if isinstance(kind, StructType):
        return F.coalesce(F.concat(none, *[texts(value.getField(f.name), f.dataType) for f in kind.fields]), none)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: texts(x, kind.elementType))), none)
    if isinstance(kind, MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(value), lambda x: texts(x, kind.valueType))), none)
    return none


def damaged(value: Column, kind: DataType) -> Column:
    """The first text of a value that carries a mojibake signature, 40 characters of it; null if none does."""
    return F.substring(F.get(F.filter(texts(value, kind), has_mojibake), F.lit(0)), 1, 40)
