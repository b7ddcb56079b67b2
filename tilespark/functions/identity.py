"""Numbers with check digits, and masking of personal identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CASE_NUMBER = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"
_PARTS = r"^(\d{7})-(\d{2})\.(\d{4})\.(\d)\.(\d{2})\.(\d{4})$"

# Names of the courts' segments by their digit.
SEGMENTS = {
    "1": "Supremo Tribunal Federal", "2": "Conselho Nacional de Justiça", "3": "Superior Tribunal de Justiça", "4": "Justiça Federal",
    "5": "Justiça do Trabalho", "6": "Justiça Eleitoral", "7": "Justiça Militar da União", "8": "Justiça Estadual", "9": "Justiça Militar Estadual",
}
# Weights of the two check digits of companies' numbers.
COMPANY_FIRST = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
COMPANY_SECOND = [6, *COMPANY_FIRST]


def find_case_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, CASE_NUMBER, 0), F.lit(""))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def mod97(digits: Column) -> Column:
    """Remainder of a string of up to 38 digits."""
    return (digits.cast("decimal(38,0)") % 97).cast("int")


def check_digit(sequence: Column, year: Column, segment: Column, court: Column, origin: Column) -> Column:
    """98 less the remainder of the number with two zeros appended, as two digits."""
    return F.lpad((98 - mod97(F.concat(sequence, year, segment, court, origin, F.lit("00")))).cast("string"), 2, "0")


def parse_case_number(text: Column) -> Column:
    """Parts of a well-formed number, with valid for its check digit; null if malformed. A wrong digit is flagged."""
    part = [F.regexp_extract(text, _PARTS, k) for k in range(1, 7)]
    names = ["sequence", "digit", "year", "segment", "court", "origin"]
    valid = check_digit(part[0], part[2], part[3], part[4], part[5]) == part[1]
    return F.when(text.rlike(_PARTS), F.struct(*[p.alias(n) for p, n in zip(part, names, strict=True)], valid.alias("valid")))


def segment_name(digit: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SEGMENTS.items() for x in kv])[digit]


def _weighted(digits: Column, weights: list[int]) -> Column:
    return sum((F.substring(digits, k + 1, 1).cast("int") * w for k, w in enumerate(weights)), F.lit(0))


def _uniform(digits: Column) -> Column:
    return digits.rlike(r"^(\d)\1*$")


def valid_person(digits: Column) -> Column:
    """11 digits, not all equal, whose last two are the weighted sums of those before, times ten, modulo 11."""

    def digit(n: int) -> Column:
        return (_weighted(digits, list(range(n + 1, 1, -1))) * 10 % 11 % 10) == F.substring(digits, n + 1, 1).cast("int")

    return F.when(digits.rlike(r"^\d{11}$") & ~_uniform(digits), digit(9) & digit(10)).otherwise(F.lit(False))


def valid_company(digits: Column) -> Column:
    """14 digits, not all equal; a check digit is 0 for a remainder under two, else 11 less the remainder."""

    def digit(weights: list[int]) -> Column:
        rest = _weighted(digits, weights) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest) == F.substring(digits, len(weights) + 1, 1).cast("int")

    return F.when(digits.rlike(r"^\d{14}$") & ~_uniform(digits), digit(COMPANY_FIRST) & digit(COMPANY_SECOND)).otherwise(F.lit(False))


def format_person(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")


def format_company(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")


def parse_person_id(kind: Column, text: Column) -> Column:
    """(kind, digits, formatted, valid); null if a known kind has the wrong length; no verdict for other kinds."""
    digits = digits_of(text)
    known = F.when(kind == "CPF", F.struct(kind.alias("kind"), digits.alias("digits"), format_person(digits).alias("formatted"), valid_person(digits).alias("valid")))
    known = known.when(kind == "CNPJ", F.struct(kind.alias("kind"), digits.alias("digits"), format_company(digits).alias("formatted"), valid_company(digits).alias("valid")))
    other = F.struct(kind.alias("kind"), digits.alias("digits"), text.alias("formatted"), F.lit(None).cast("boolean").alias("valid"))
    wrong = ((kind == "CPF") & (F.length(digits) != 11)) | ((kind == "CNPJ") & (F.length(digits) != 14))
    return F.when(~wrong, known.otherwise(other))


def infer_person_id(text: Column) -> Column:
    n = F.length(digits_of(text))
    return F.when(n == 11, parse_person_id(F.lit("CPF"), text)).when(n == 14, parse_person_id(F.lit("CNPJ"), text))


def report_mask(digits: Column) -> Column:
    return F.concat(F.lit("***-"), F.right(digits, F.lit(2)))


def export_mask(text: Column) -> Column:
    """Strings that aren't empty keep their last two characters."""
    return F.when(text != "", F.concat(F.lit("***"), F.right(text, F.lit(2)))).otherwise(text)


def partition_id(first: Column, last: Column, facets: Column | None = None) -> Column:
    """`first..last`, and the facets by name, if there are any."""
    span = F.concat(F.date_format(first, "yyyy-MM-dd"), F.lit(".."), F.date_format(last, "yyyy-MM-dd"))
    if facets is None:
        return span
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(facets)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.when(F.size(facets) > 0, F.concat(span, F.lit("|"), pairs)).otherwise(span)
