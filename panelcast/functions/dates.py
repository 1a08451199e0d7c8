"""Date parsing and calendar expressions (DT1-DT7)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import to_number

# Spreadsheet day 0, the serial threshold taken as "a date after
# 2009", the wet-season months and the trend origin year.
EXCEL_EPOCH = "1899-12-30"
EXCEL_MIN_SERIAL = 40000
WET_SEASON_MONTHS = (11, 12, 1, 2, 3)
TREND_BASE_YEAR = 2015
SEMESTER_MONTH = {1: 3, 2: 9}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """One layout; anything else -> NULL (DT1, the reference's first-format-only coercion)."""
    return F.try_to_date(_c(c).cast("string"), fmt)


def parse_date_any(c, formats: Sequence[str] = ("yyyy-MM-dd", "M/d/yyyy", "dd/MM/yyyy")) -> Column:
    """First layout that parses, in the given order (DT2; month first when ambiguous by default)."""
    s = _c(c).cast("string")
    return F.coalesce(*[F.try_to_date(s, f) for f in formats])


def excel_serial_to_date(c) -> Column:
    """Spreadsheet serial day (> 40000) -> date, fraction dropped (DT3); NULL otherwise."""
    x = to_number(c)
    return F.when(x > EXCEL_MIN_SERIAL, F.date_add(F.lit(EXCEL_EPOCH).cast("date"), F.floor(x).cast("int")))


def date_or_serial(c, fmt: str = "yyyy-MM-dd") -> Column:
    """Text containing '-' parses with ``fmt``; a serial number converts (DT3 as applied)."""
    s = _c(c).cast("string")
    return F.when(s.contains("-"), F.try_to_date(s, fmt)).otherwise(excel_serial_to_date(s))


def date_from_parts(year, month, day) -> Column:
    """year / month / day -> date, invalid -> NULL (DT4)."""
    txt = F.concat_ws("-", _c(year).cast("int").cast("string"),
                      F.lpad(_c(month).cast("int").cast("string"), 2, "0"),
                      F.lpad(_c(day).cast("int").cast("string"), 2, "0"))
    return F.try_to_date(txt, "yyyy-MM-dd")


def period_to_date(period, day=15) -> Column:
    """``YYYYMM`` integer plus a day (number or column) -> date (DT4)."""
    p = _c(period).cast("int")
    d = day if isinstance(day, Column) else F.lit(day)
    return date_from_parts(F.floor(p / 100), p % 100, d)


def month_text_to_date(month_text, year=None, day: int = 15) -> Column:
    """Sampling month as text: 'YYYYMM' (>= 6 chars) or a bare month with a year column (DT4)."""
    s = _c(month_text).cast("string")
    long_form = date_from_parts(F.substring(s, 1, 4), F.substring(s, 5, 2), F.lit(day))
    if year is None:
        return F.when(F.length(s) >= 6, long_form)
    short = date_from_parts(_c(year), s, F.lit(day))
    return F.when(F.length(s) >= 6, long_form).otherwise(short)


def semester_to_date(year, semester) -> Column:
    """Semester 1 -> March 15, 2 -> September 15 (DT4)."""
    m = F.when(_c(semester) == 1, SEMESTER_MONTH[1]).when(_c(semester) == 2, SEMESTER_MONTH[2])
    return date_from_parts(_c(year), m, F.lit(15))


def calendar_parts(date: str = "date") -> dict[str, Column]:
    """year, month, quarter, day, weekday (Monday=0), day of year, ISO week (DT5)."""
    d = F.col(date)
    return {
        "year": F.year(d), "month": F.month(d), "quarter": F.quarter(d),
        "day_of_month": F.dayofmonth(d), "day_of_week": F.weekday(d),
        "day_of_year": F.dayofyear(d), "week_of_year": F.weekofyear(d),
    }


def is_weekend(date: str = "date") -> Column:
    """Saturday or Sunday (DT6)."""
    return (F.weekday(F.col(date)) >= 5).cast("int")


def is_wet_season(date: str = "date") -> Column:
    """November to March (DT6)."""
    return F.month(F.col(date)).isin(*WET_SEASON_MONTHS).cast("int")


def years_since(date: str = "date", base: int = TREND_BASE_YEAR) -> Column:
    return F.year(F.col(date)) - F.lit(base)


def cyclical(x, period: float) -> tuple[Column, Column]:
    """(sin, cos) of ``2 pi x / period`` (DT7)."""
    a = F.lit(2 * math.pi) * _c(x).cast("double") / F.lit(float(period))
    return F.sin(a), F.cos(a)
