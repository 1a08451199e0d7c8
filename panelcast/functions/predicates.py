"""Row filters and flags (FLT1-FLT7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import NO_DATA_LABEL


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_sentinel(c, sentinel: str = NO_DATA_LABEL) -> Column:
    """Keep rows whose label is not the sentinel; NULL labels are kept (FLT1).
    Plain ``!=`` would drop the NULLs as well."""
    return ~_c(c).eqNullSafe(F.lit(sentinel))


def drop_sentinel(df: DataFrame, col: str = "kategori", sentinel: str = NO_DATA_LABEL) -> DataFrame:
    return df.filter(not_sentinel(col, sentinel))


def drop_null_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FLT2."""
    return df.dropna(subset=list(cols))


def in_range(date: str, start=None, end=None) -> Column:
    """Inclusive date range (FLT3); pushed into the Parquet scan when on a raw column."""
    c = F.col(date)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (c >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (c <= F.lit(end).cast("date"))
    return cond


def member_flag(c, values: Sequence) -> Column:
    """``isin`` as 0/1 with NULL -> 0 (FLT4)."""
    return F.coalesce(_c(c).isin(*values), F.lit(False)).cast("int")


def negative_count(c) -> Column:
    """Number of negative values, as an aggregate (FLT7)."""
    return F.count_if(_c(c) < 0)
