"""Verdicts on raw bytes: encodings, document files, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of a plausible document file.
MIN_BYTES = 1_024
EOF_WINDOW = 2_048


def latin1(body: Column) -> Column:
    """Every byte as the code point of its number."""
    return F.decode(body, "ISO-8859-1")


def charset_name(label: Column) -> Column:
    """utf-8 or iso-8859-1; null for other labels."""
    low = F.lower(F.trim(label))
    return F.when(low.isin("utf-8", "utf8"), "utf-8").when(low.isin("iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252"), "iso-8859-1")


def declared_charset(body: Column) -> Column:
    """The charset that the first kilobyte of a document declares."""
    head = latin1(F.substring(body, 1, 1024))
    return charset_name(F.nullif(F.regexp_extract(head, r"""(?i)(?:<meta[^>]+charset=|<\?xml[^>]+encoding=)["']?([A-Za-z0-9_-]+)""", 1), F.lit("")))


def header_charset(content_type: Column) -> Column:
    return charset_name(F.nullif(F.regexp_extract(content_type, r"""(?i)charset=["']?([A-Za-z0-9_-]+)""", 1), F.lit("")))


def charset(body: Column, content_type: Column) -> Column:
    """(charset, via): strict UTF-8 if the bytes are valid, else what the header says, what the document says, Latin-1."""
    made = lambda c, via: F.struct(c.alias("charset"), F.lit(via).alias("via"))
    by_header, by_document = header_charset(content_type), declared_charset(body)
    strict = F.try_validate_utf8(body.cast("string")).isNotNull()
    return (
        F.when(strict, made(F.lit("utf-8"), "strict-utf8")).when(by_header.isNotNull(), made(by_header, "header"))
        .when(by_document.isNotNull(), made(by_document, "document")).otherwise(made(F.lit("iso-8859-1"), "fallback-latin1"))
    )


def file_verdict(body: Column, declared: Column) -> Column:
    """OK, or the first thing wrong with a document file."""
    size = F.octet_length(body)
    tail = latin1(F.substring(body, F.greatest(F.lit(1), size - EOF_WINDOW + 1), F.lit(EOF_WINDOW)))
    return (
        F.when(latin1(F.substring(body, 1, 5)) != "%PDF-", "NOT_PDF").when(declared.isNotNull() & (declared != size), "PDF_LENGTH_MISMATCH")
        .when(size < MIN_BYTES, "PDF_TOO_SMALL").when(F.instr(tail, "%%EOF") == 0, "PDF_TRUNCATED").otherwise("OK")
    )


def sha256_base64(text: Column) -> Column:
    return F.base64(F.unhex(F.sha2(text, 256)))


def canonical_json(fields: dict[str, Column], volatile: tuple[str, ...] = ("listedAt", "detailedAt", "contentHash", "partitionId", "ca")) -> Column:
    """Fields by name, without those that describe the observation; nulls are kept, arrays keep their order."""
    kept = [c.alias(n) for n, c in sorted(fields.items()) if n not in volatile]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})


def content_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)
