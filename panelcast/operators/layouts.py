"""Date layout per file (DT1-DT4): what a whole file says decides how its ambiguous rows are read.

One aggregate per file counts, for every layout, the rows that only it can
parse, those that contradict it and those that fit both.  The decision is one
row per file, joined back to the rows; the planner chooses the join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions.text import to_number

MONTH_FIRST, DAY_FIRST = "M/d/yyyy", "d/M/yyyy"


def _slash(c: Column, fmt: str) -> Column:
    return F.try_to_date(F.trim(c.cast("string")), fmt)


def _day_number(c: Column) -> Column:
    """The text as a day of a month, else NULL."""
    n = to_number(c)
    return F.when((n >= 1) & (n <= 31) & (n == F.floor(n)), n.cast("int"))


def file_date_layouts(df: DataFrame, by: Sequence[str], c: str, month_name: str | None = None) -> DataFrame:
    """One row per file: ``n_rows``, ``n_month_first`` / ``n_day_first`` (rows only that layout parses),
    ``n_ambiguous`` (both, with different dates), ``slash_layout`` and ``day_numbers``.

    Slash dates are day first only if more rows demand it than forbid it, so
    files of ambiguous rows alone are month first.  A column holds day numbers
    if all its values are and the file has a month-name column.
    """
    x = F.col(c)
    m, d = _slash(x, MONTH_FIRST), _slash(x, DAY_FIRST)
    present = F.trim(x) != ""
    has_month = F.count(F.col(month_name)) > 0 if month_name else F.lit(False)
    return df.groupBy(*by).agg(
        F.count_if(present).alias("n_rows"),
        F.count_if(m.isNotNull() & d.isNull()).alias("n_month_first"),
        F.count_if(d.isNotNull() & m.isNull()).alias("n_day_first"),
        F.count_if(m.isNotNull() & d.isNotNull() & (m != d)).alias("n_ambiguous"),
        ((F.count(_day_number(x)) == F.count_if(present)) & (F.count_if(present) > 0) & has_month).alias("day_numbers"),
    ).withColumn("slash_layout", F.when(F.col("n_day_first") > F.col("n_month_first"), DAY_FIRST).otherwise(MONTH_FIRST))


def date_of_layout(c, slash_layout: Column, day_numbers: Column | None = None, period: Column | None = None) -> Column:
    """A text as date by its file's layout: ISO, slashes, spreadsheet serials, or day numbers of ``period`` (YYYYMM).

    A slash date that the file's layout cannot parse is read in the only layout
    that can (the mixed parse of DT2).
    """
    x = F.col(c) if isinstance(c, str) else c
    m, d = _slash(x, MONTH_FIRST), _slash(x, DAY_FIRST)
    slash = F.when(slash_layout == DAY_FIRST, F.coalesce(d, m)).otherwise(F.coalesce(m, d))
    whole = F.when(x.contains("/"), slash).otherwise(dt.date_or_serial(F.trim(x)))
    if day_numbers is None or period is None:
        return whole
    p = period.cast("int")
    return F.when(day_numbers, dt.date_from_parts(F.floor(p / 100), p % 100, _day_number(x))).otherwise(whole)


def join_files(df: DataFrame, per_file: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-file columns attached to every row of the file; a null file name is a file of its own."""
    keys = per_file.withColumnsRenamed({b: f"_by_{b}" for b in by})
    on = reduce(Column.__and__, [df[b].eqNullSafe(keys[f"_by_{b}"]) for b in by])
    return df.join(keys, on).drop(*[f"_by_{b}" for b in by])


def dates_by_file(df: DataFrame, by: Sequence[str], c: str, out: str = "date", period: str | None = None,
                  month_name: str | None = None) -> DataFrame:
    """``df`` with ``out``: column ``c`` read by the layout of its own file."""
    seen = file_date_layouts(df, by, c, month_name).select(*by, F.col("slash_layout").alias("_slash"), F.col("day_numbers").alias("_days"))
    when = date_of_layout(c, F.col("_slash"), F.col("_days"), F.col(period) if period else None)
    return join_files(df, seen, by).withColumn(out, when).drop("_slash", "_days")


def month_texts(df: DataFrame, by: Sequence[str], c: str, year: str, out: str = "date") -> DataFrame:
    """A month column as first-of-month dates, its meaning chosen per file by its longest text (DT4):
    over two characters it is ``YYYYMM``, else a month of ``year``."""
    longest = df.groupBy(*by).agg(F.max(F.length(F.trim(c))).alias("_longest"))
    n = to_number(F.col(c)).cast("int")
    months = F.when(F.col("_longest") > 2, dt.date_from_parts(F.floor(n / 100), n % 100, F.lit(1))) \
              .otherwise(dt.date_from_parts(F.col(year), n, F.lit(1)))
    return join_files(df, longest, by).withColumn(out, months).drop("_longest")
