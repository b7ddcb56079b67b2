"""Exports as text: JSON lines and CSV with stable order, and masking of personal columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, StringType, TimestampNTZType, TimestampType

from ..functions.identity import export_mask
from ..functions.text import camel_case, csv_cell

BOM = "﻿"
#: Columns that an anonymised export masks.
SENSITIVE = frozenset({"doc_digitos", "doc_formatado", "registro_numero"})


def _plain(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, BinaryType):
        return F.base64(c)
    if isinstance(kind, DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c


def masked(df: DataFrame, columns: frozenset[str] = SENSITIVE) -> DataFrame:
    return df.withColumns({n: export_mask(F.col(n)) for n in df.columns if n in columns and isinstance(df.schema[n].dataType, StringType)})


def json_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """One `value` for each row: camel-case names, nulls kept, times in ISO form, bytes in base64."""
    fields = F.struct(*[_plain(df, n).alias(camel_case(n)) for n in df.columns])
    return df.orderBy(*order).select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def csv_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """One `value` for each row, without the header: it is the same for every part of a distributed export."""
    cells = [csv_cell(_plain(df, n).cast("string")) for n in df.columns]
    return df.orderBy(*order).select(F.concat_ws(",", *cells).alias("value"))


def csv_header(df: DataFrame) -> str:
    return BOM + ",".join(df.columns)


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    json_lines(df, order).write.text(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Parts in order, each a sorted range with CRLF line ends; the header, with its byte order mark, is a part of its own
    under `path`/header."""
    csv_lines(df, order).write.option("lineSep", "\r\n").text(f"{path}/rows")
    df.sparkSession.createDataFrame([(csv_header(df),)], "value string").coalesce(1).write.option("lineSep", "\r\n").text(f"{path}/header")


def catalogue(df: DataFrame) -> DataFrame:
    """(place, name) of the columns of df, from 1."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns, 1)), "place bigint, name string")


def append_samples(samples: DataFrame, path: str) -> None:
    """All samples of a batch added to the table at path in one write."""
    samples.write.mode("append").parquet(path)
