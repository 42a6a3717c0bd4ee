"""Dates, periods (first day of a month) and calendar rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month names, January first.
MONTH_NAMES = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)

# A bill falls due on these days of its own month.
FIRST_DUE_DAY = 10
SECOND_DUE_DAY = 15


def period(date: Column) -> Column:
    return F.trunc(date, "MM")


def period_of(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def billed_period(payment_date: Column) -> Column:
    """A payment of one month settles the bill of the month before."""
    return F.add_months(period(payment_date), -1)


def due_date(period_: Column, day: int) -> Column:
    return F.date_add(period_, day - 1)


def parse_dmy(text: Column) -> Column:
    return F.try_to_date(text, "dd/MM/yyyy")


def text_dmy(date: Column) -> Column:
    return F.date_format(date, "dd/MM/yyyy")


def month_number(name: Column, default: Column) -> Column:
    """Month number of a Spanish month name; ``default`` for any other text."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    position = F.array_position(names, F.lower(F.trim(name)))
    return F.when(position > 0, position).otherwise(default).cast("int")


def week_of_year(date: Column) -> Column:
    """Week 1 holds January 1 and weeks start on Sunday (not the ISO week)."""
    lead = F.dayofweek(F.trunc(date, "YEAR")) - 1
    return (F.floor((F.dayofyear(date) - 1 + lead) / 7) + 1).cast("int")


def nth_business_day(year: Column, month: Column, n: Column) -> Column:
    """The n-th weekday (Monday to Friday) of a month.

    NULL if the month has fewer; the first of the month for n <= 0.
    """
    first = F.make_date(year, month, F.lit(1))
    weekday = F.weekday(first)  # Monday = 0
    opening = F.date_add(first, F.when(weekday >= 5, 7 - weekday).otherwise(F.lit(0)))
    offset = F.when(weekday >= 5, F.lit(0)).otherwise(weekday)
    weekends = F.floor((offset + n - 1) / 5).cast("int")
    found = F.date_add(opening, (n - 1 + 2 * weekends).cast("int"))
    return F.when(n <= 0, first).when(F.trunc(found, "MM") == first, found)


def as_of_date(as_of: dt.date | str | None) -> Column:
    """The reference day of a job; today if none is given."""
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def between(column: Column, start=None, end=None) -> list[Column]:
    """Predicates of an optional date range; both ends belong to it."""
    out = []
    if start is not None:
        out.append(column >= F.lit(str(start)).cast("date"))
    if end is not None:
        out.append(column < F.date_add(F.lit(str(end)).cast("date"), 1))
    return out


def in_year(column: Column, year: int | None) -> list[Column]:
    if year is None:
        return []
    return between(column, dt.date(year, 1, 1), dt.date(year, 12, 31))
