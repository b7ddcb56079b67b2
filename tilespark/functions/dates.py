"""Calendar days, times with a fixed offset, and waits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_iso_day(text: Column) -> Column:
    """A real day in exactly ten characters."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def day_from_br(text: Column) -> Column:
    """dd/MM/yyyy, padded, as a date; null for anything else."""
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(text, "dd/MM/yyyy"))


def br_from_day(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def br_month(day: Column) -> Column:
    return F.date_format(day, "MM/yyyy")


def time_from_br(text: Column, offset: str = "-03:00") -> Column:
    """dd/MM/yyyy HH:mm[:ss] as ISO text; the offset is attached, the clock not moved."""
    full = F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}$"), F.concat(text, F.lit(":00"))).otherwise(text)
    full = F.regexp_replace(full, r"\s+", " ")
    parsed = F.when(full.rlike(r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(full, F.lit("dd/MM/yyyy HH:mm:ss")))
    return F.concat(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def start_of_day(day: Column, offset: str = "-03:00") -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00" + offset))


def days_in(first: Column, last: Column) -> Column:
    """Days of an inclusive range."""
    return F.datediff(last, first) + 1


def overlap(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    return (a_first <= b_last) & (b_first <= a_last)


def contiguous(a_last: Column, b_first: Column) -> Column:
    return b_first == F.date_add(a_last, 1)


def halves(first: Column, last: Column) -> Column:
    """The two halves of a range of two days or more, the left one the shorter; null for one day."""
    half = F.floor(days_in(first, last) / 2).cast("int")
    return F.when(
        last > first,
        F.array(F.struct(first.alias("first"), F.date_add(first, half - 1).alias("last")), F.struct(F.date_add(first, half).alias("first"), last.alias("last"))),
    )


def retry_after_ms(header: Column, now: Column) -> Column:
    """Seconds or an HTTP date, as milliseconds from now, none negative; null if neither."""
    text = F.trim(header)
    at = F.try_to_timestamp(F.regexp_extract(text, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2} GMT)$", 1), F.lit("dd MMM yyyy HH:mm:ss z"))
    wait = F.floor((F.unix_micros(at) - F.unix_micros(now)) / 1000)
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint") * 1000).when(at.isNotNull(), F.greatest(F.lit(0), wait)).cast("bigint")


def duration(ms: Column) -> Column:
    """`1h 04m`, `4m 12s` or `9s`."""
    total = F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5)).cast("bigint")
    hours, minutes, seconds = (F.floor(total / 3600).cast("bigint"), F.floor(total % 3600 / 60).cast("bigint"), total % 60)
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), pad(minutes), F.lit("m")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), pad(seconds), F.lit("s")))
        .otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    )
