"""Dates as published: the wall clock is kept and the offset is dropped."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accepted forms ------------------------------------------------
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)?$"
_OFFSET = r"(?<=\d)(?:[Zz]|(?<=:\d{2}|[.,]\d{1,9})[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)$"
_COMPACT_DAY = r"^(\d{4})(\d{2})(\d{2})(?=$|T)"
_WEEK_DAY = r"^(\d{4})(-?)W(\d{2})(?:\2(\d))?(?=$|[T ])"
_DAYS_AGO = r"(\d+)\+?\s*day"
_MONTHS_AGO = r"(\d+)\+?\s*month"
_DAYS_PER_MONTH = 30
# ---------------------------------------------------------------------------------


def _week_day(c: Column) -> Column:
    """The calendar day of a text that begins with an ISO week date; without a day it is the Monday.

    Week 1 is that of 4 January. A year has week 53 if that week's Thursday still belongs to it.
    """
    year, week = F.regexp_extract(c, _WEEK_DAY, 1).try_cast("int"), F.regexp_extract(c, _WEEK_DAY, 3).try_cast("int")
    day = F.coalesce(F.regexp_extract(c, _WEEK_DAY, 4).try_cast("int"), F.lit(1))
    monday = F.date_add(F.trunc(F.make_date(F.when(year > 0, year), F.lit(1), F.lit(4)), "week"), (week - 1) * 7)
    return F.when(week.between(1, 53) & day.between(1, 7) & (F.year(F.date_add(monday, 3)) == year), F.date_add(monday, day - 1))


def parse_iso(*cols: Column) -> Column:
    """First value that is an ISO 8601 date or date-time, week dates included."""

    def one(c: Column) -> Column:
        day = F.when(c.rlike(_WEEK_DAY), F.regexp_replace(c, _WEEK_DAY, F.date_format(_week_day(c), "yyyy-MM-dd"))).otherwise(c)
        local = F.regexp_replace(F.regexp_replace(day, _COMPACT_DAY, "$1-$2-$3"), _OFFSET, "")
        return F.when(local.rlike(_ISO), F.replace(local, F.lit(","), F.lit(".")).try_cast("timestamp_ntz"))

    return F.coalesce(*[one(c.cast("string")) for c in cols])


def epoch_millis(c: Column) -> Column:
    """UTC wall clock of a millisecond count, given as a number or as text."""
    millis = c.try_cast("bigint")
    day = 86_400_000
    since = F.make_dt_interval(F.floor(millis / day).cast("int"), F.lit(0), F.lit(0),
                               (F.pmod(millis, F.lit(day)) / 1000).cast("decimal(18,6)"))
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when((millis != 0) & (F.abs(millis) < 253_402_300_800_000), start + since)


def _days_before(as_of: Column, days: Column) -> Column:
    return as_of - F.make_dt_interval(days, F.lit(0), F.lit(0), F.lit(0.0))


def parse_posted_on(text: Column, as_of: Column) -> Column:
    """Date of a relative text such as ``Posted 5 Days Ago``, seen at ``as_of``."""
    value = F.lower(F.coalesce(text, F.lit("")))
    now = as_of.cast("timestamp_ntz")
    days = F.regexp_extract(value, _DAYS_AGO, 1).try_cast("int")
    months = F.regexp_extract(value, _MONTHS_AGO, 1).try_cast("int")
    return (
        F.when(value.contains("today") | value.contains("just posted"), now)
        .when(value.contains("yesterday"), _days_before(now, F.lit(1)))
        .when(days <= 500_000, _days_before(now, days))
        .when(months <= 16_000, _days_before(now, months * _DAYS_PER_MONTH))
    )


def iso_day(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
