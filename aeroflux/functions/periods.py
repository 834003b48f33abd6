"""Periods as half-open intervals of UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def begin_of(year: Column | str, month: Column | int | None = None) -> Column:
    """First instant of a month of the year, or of the year."""
    year = F.col(year) if isinstance(year, str) else year
    month = F.lit(1) if month is None else F.lit(month) if isinstance(month, int) else month
    return F.make_timestamp(year.cast("int"), month.cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))


def end_of(begin: Column, months: int) -> Column:
    return begin + F.make_ym_interval(F.lit(0), F.lit(months))


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def weeks_in_month(date: Column) -> Column:
    return days_in_month(date) / F.lit(7.0)


def period_of(begin: Column, end: Column) -> Column:
    """0 for an interval of about a year, the month's number for about a month; others fail."""
    hours = F.timestamp_diff("HOUR", begin, end)
    return F.when(hours.between(8700, 8800), F.lit(0)).when(hours.between(648, 768), F.month(begin)).otherwise(F.raise_error(F.concat(F.lit("no period of hours: "), hours.cast("string"))).cast("int"))


def hours_in_year(t: Column) -> Column:
    first = F.date_trunc("year", t)
    return F.timestamp_diff("HOUR", first, end_of(first, 12)).cast("double")
