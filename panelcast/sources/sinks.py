"""Writers (SNK1-SNK4).  Ordering happens only here, at the sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = ("station",), mode: str = "overwrite") -> None:
    """Parquet panel, partitioned (by station, or year when stations are many) (SNK1)."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "overwrite",
              date_format: str = "yyyy-MM-dd") -> None:
    """CSV with header; dates formatted at the sink only (SNK1, SNK2, SNK4)."""
    out = df.orderBy(*order) if order else df
    out.write.mode(mode).option("header", True).option("dateFormat", date_format).csv(path)


def submission(df: DataFrame, date: str = "date", station: str = "station", category: str = "category") -> DataFrame:
    """``id = yyyy-MM-dd_station, category`` (SNK2)."""
    return df.select(F.concat_ws("_", F.date_format(date, "yyyy-MM-dd"), F.col(station)).alias("id"),
                     F.col(category).alias("category"))


def write_lines(names: DataFrame, path: str, col: str = "feature", mode: str = "overwrite") -> None:
    """Sorted single column as text, one per line (SNK3)."""
    names.select(F.col(col).cast("string")).orderBy(col).coalesce(1).write.mode(mode).text(path)
