"""Dates of document headers and summaries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 100 ns steps from 1601-01-01 to 1970-01-01.
EPOCH_STEPS = 116_444_736_000_000_000


def dttm(bits: Column) -> Column:
    """Timestamp of minute (6 bits), hour (5), day (5), month (4), year - 1900 (9), from the low end; 0 and invalid dates give null."""
    bits = bits.cast("long")
    field = lambda at, width: F.shiftright(bits, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    year, month, day, hour, minute = field(20, 9) + 1900, field(16, 4), field(11, 5), field(6, 5), field(0, 6)
    return F.when(bits != 0, F.try_make_timestamp(year, month, day, hour, minute, F.lit(0).cast("decimal(16,6)")))


def filetime(low: Column, high: Column) -> Column:
    """Timestamp, in whole seconds, of 100 ns steps since 1601 in two 32-bit halves; half a second rounds away from zero."""
    steps = high.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(20,0)") + low.cast("decimal(20,0)") - F.lit(EPOCH_STEPS).cast("decimal(20,0)")
    seconds = F.round(steps / F.lit(10_000_000).cast("decimal(20,0)"), 0).cast("long")
    return F.when(seconds.between(-(2**31), 2**31 - 1), F.timestamp_seconds(seconds))


def dos_date(text: Column) -> Column:
    """Date of month/day/year of one or two digits with any separators; years below 80 belong to the 21st century; else null."""
    pattern = r"^([0-9]{1,2})[^0-9A-Za-z]([0-9]{1,2})[^0-9A-Za-z]([0-9]{1,2})"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int")
    month, day, year = part(1), part(2), part(3)
    full = year + F.when(year < 80, 2000).otherwise(1900)
    return F.when(month.between(1, 12) & day.between(1, 31), F.to_date(F.date_add(F.make_date(full, month, F.lit(1)), day - 1)))


def last_saved(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def pdf_date(ts: Column) -> Column:
    return F.date_format(ts, "'D:'yyyyMMddHHmm")
