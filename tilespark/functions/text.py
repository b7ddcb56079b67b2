"""Text cleaning as column expressions; where the JVM lacks a normal form, as Arrow-batched pandas functions."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import quote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as scripts in browsers see it: Unicode white space and the byte order mark.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# What follows the lead letter when UTF-8 was read as a single-byte encoding, as Latin-1 or as Windows-1252.
MOJIBAKE = (
    r"[\u00C2\u00C3][\u0080-\u00BF\u20AC\u201A\u0192\u201E\u2026\u2020\u2021\u02C6\u2030"
    r"\u0160\u2039\u0152\u017D\u2018\u2019\u201C\u201D\u2022\u2013\u2014\u02DC\u2122\u0161\u203A\u0153\u017E\u0178]"
)
# Accented capital letters and their base letters, position by position.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
BASE = "AAAAAACEEEEIIIINOOOOOUUUUYY"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at either end."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def clean(text: Column) -> Column:
    """collapse, and canonical composition."""
    return nfc(collapse(text))


def clean_or_null(text: Column) -> Column:
    return F.nullif(clean(text), F.lit(""))


def has_mojibake(text: Column) -> Column:
    return text.rlike(MOJIBAKE)


def mojibake_samples(text: Column, limit: int = 5) -> Column:
    """Up to `limit` windows of 12 characters before and 12 from each damaged pair on; pairs may share context."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), lambda k: F.substring(text, k, F.lit(2)).rlike(MOJIBAKE))
    return F.transform(F.slice(at, 1, limit), lambda k: F.substring(text, F.greatest(k - 12, F.lit(1)), F.least(k - 1, F.lit(12)) + 12))


def fold(text: Column) -> Column:
    """For comparison only: no accents, upper case, white space collapsed. Letters of Western European alphabets."""
    return collapse(F.translate(F.upper(text), ACCENTED, BASE))


def unescape_common(text: Column) -> Column:
    """The escapes that pages use within script strings for characters of URLs."""
    for escape, plain in ((r"\x2D", "-"), (r"\x2F", "/"), (r"\x26", "&"), (r"\x3D", "="), (r"\/", "/"), (r"\"", '"'), (r"\'", "'")):
        text = F.replace(text, F.lit(escape), F.lit(plain))
    return text


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; the JVM functions have none."""
    return text.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def fold_any(text: pd.Series) -> pd.Series:
    """fold for any alphabet: canonical decomposition without combining marks."""

    def one(x):
        if x is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFD", x) if not "\u0300" <= c <= "\u036F")
        return " ".join(bare.upper().replace("\uFEFF", " ").split())

    return text.map(one)


_ESCAPES = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|([\\'\"/]))")


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Escapes of a script string: two or four hex digits, and escaped quotes, slashes and backslashes."""
    return text.map(lambda x: None if x is None else _ESCAPES.sub(lambda m: m[3] or chr(int(m[1] or m[2], 16)), x))


@F.pandas_udf(StringType())
def urlencode_latin1(text: pd.Series) -> pd.Series:
    """Form encoding in Latin-1; characters it lacks become question marks."""
    return text.map(lambda x: None if x is None else quote_plus(x.encode("latin-1", "replace"), safe="*-._"))


def unrepresentable_latin1(text: Column) -> Column:
    """The characters of the text that Latin-1 lacks."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c.rlike(r"[^\u0000-\u00FF]")))


def truncated(text: Column, most: int) -> Column:
    short = collapse(text)
    return F.when(F.char_length(short) > most, F.concat(F.left(short, F.lit(most - 1)), F.lit("…"))).otherwise(short)


def sanitized(segment: Column) -> Column:
    """A part of a storage key: safe characters only, at most 120 of them; `unknown` if none is left."""
    safe = F.regexp_replace(F.regexp_replace(segment, "[^A-Za-z0-9._-]", "_"), "_{2,}", "_")
    bare = F.regexp_replace(F.regexp_replace(safe, "^[._]+", ""), "[._]+$", "")
    return F.when(bare == "", "unknown").otherwise(F.left(bare, F.lit(120)))


def storage_key(site: Column, day: Column, number: Column, kind: Column, doc: Column) -> Column:
    number = sanitized(number)
    year = F.coalesce(F.date_format(day, "yyyy"), F.lit("unknown"))
    tail = F.when(doc.isNull(), "").otherwise(F.concat(F.lit("__"), sanitized(doc)))
    return F.concat(sanitized(site), F.lit("/"), year, F.lit("/"), number, F.lit("/"), number, F.lit("__"), sanitized(kind), tail, F.lit(".pdf"))


def logical_key(kind: Column, origin: Column, doc: Column) -> Column:
    return F.concat_ws(":", kind, origin, doc)


def csv_cell(text: Column) -> Column:
    """RFC 4180: quoted if it holds a quote, comma or line end, or begins or ends with white space; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), "").when(text.rlike(r'[",\r\n]|^\s|\s$'), quoted).otherwise(text)


def camel_case(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def redacted_url(url: Column) -> Column:
    """A connection string with its password masked."""
    return F.regexp_replace(url, r"(://[^:/@]+:)[^@]*@", "$1***@")


def label_value(text: Column) -> Column:
    """A metric label without characters that would end it."""
    return F.regexp_replace(text, r'["\\\n]', "_")
