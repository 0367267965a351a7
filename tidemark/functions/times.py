"""Timestamps from the sources' formats, and partition keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def iso(text: Column) -> Column:
    """A timestamp from ISO text; null for null, empty or bad text."""
    return F.nullif(text, F.lit("")).try_cast("timestamp")


def rss(text: Column) -> Column:
    """A timestamp from an RFC 822 date, with or without a weekday; null for bad text."""
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9}, *", "")
    zone = F.regexp_replace(bare, " (?:GMT|UTC?|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm Z")))


def game_end(date: Column) -> Column:
    """One minute before midnight UTC of a date in ISO text; null for bad text."""
    strict = F.when(date.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), date)
    return F.try_to_timestamp(strict, F.lit("yyyy-M-d")) + F.expr("interval 23 hours 59 minutes")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970, of either kind of timestamp."""
    return F.unix_seconds(ts.cast("timestamp"))


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def as_number(ts: Column) -> Column:
    """A timestamp as the integer yyyymmddhhmmss."""
    return F.date_format(ts.cast("timestamp"), "yyyyMMddHHmmss").cast("long")


def _pad(month: Column) -> Column:
    return F.lpad(month.cast("string"), 2, "0")


def year_month(ts: Column) -> tuple[Column, Column]:
    """Year and two-digit month of a timestamp as text; ``unknown`` if it is null."""
    ts = ts.cast("timestamp")
    return F.coalesce(F.year(ts).cast("string"), F.lit(UNKNOWN)), F.coalesce(_pad(F.month(ts)), F.lit(UNKNOWN))


def number_year_month(number: Column) -> tuple[Column, Column]:
    """Year and month of an integer yyyymm...; ``unknown`` if it has fewer than six digits."""
    text = F.when(F.length(number.cast("string")) >= 6, number.cast("string"))
    return F.coalesce(F.substring(text, 1, 4), F.lit(UNKNOWN)), F.coalesce(F.substring(text, 5, 2), F.lit(UNKNOWN))
