"""Date x station skeletons and densification (JN7, JN8, JN11, IMP8).

The skeleton is generated per station row with ``explode(sequence(start, end))``:
no cross join, and stations are spread over tasks like any other rows.  Date
bounds are either given or computed by one global aggregate (two scalars).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DateLike = "str | _dt.date | Column"


def _date_lit(d) -> Column:
    if isinstance(d, Column):
        return d
    return F.lit(d).cast("date") if isinstance(d, str) else F.lit(d)


def date_bounds(df: DataFrame, date: str = "date") -> tuple[_dt.date, _dt.date]:
    """Global (min, max) of a date column: one partial-aggregated job, two scalars."""
    row = df.agg(F.min(date).alias("d0"), F.max(date).alias("d1")).first()
    return row["d0"], row["d1"]


def date_skeleton(stations: DataFrame, start, end, station: str = "station",
                  date: str = "date") -> DataFrame:
    """One row per (station, day) for every day in [start, end] (JN7).

    ``stations`` holds the station column (duplicates are removed); ``start`` and
    ``end`` are dates / ISO strings / columns of ``stations`` (per-station ranges).
    """
    s = stations.select(station).distinct()
    return s.select(station, F.explode(
        F.sequence(_date_lit(start), _date_lit(end), F.expr("INTERVAL 1 DAY"))).alias(date))


def densify(sparse: DataFrame, skeleton: DataFrame,
            keys: tuple[str, ...] = ("station", "date")) -> DataFrame:
    """Left join the sparse panel onto the skeleton (JN8 / JN11 exact reindex).

    Observations whose key is not on the skeleton are dropped, like a pandas
    ``reindex``.  Both sides are hash-partitioned on the full key, so a hot
    station is spread over all partitions.
    """
    return skeleton.join(sparse, list(keys), "left")


def densify_panel(sparse: DataFrame, start=None, end=None, station: str = "station",
                  date: str = "date") -> DataFrame:
    """Skeleton over the panel's stations and [start, end] (defaults: data bounds), then densify.

    Missing bounds come from a one-row aggregate attached to the station list
    inside the plan (no eager job), so the panel is not computed an extra time.
    """
    stations = sparse.select(station).distinct()
    if start is None or end is None:
        b = sparse.agg(F.min(date).alias("_d0"), F.max(date).alias("_d1"))
        stations = stations.withColumn("_one", F.lit(1)).join(
            F.broadcast(b.withColumn("_one", F.lit(1))), "_one").drop("_one")   # exactly one row
        start = F.col("_d0") if start is None else _date_lit(start)
        end = F.col("_d1") if end is None else _date_lit(end)
    sk = stations.select(station, F.explode(F.sequence(_date_lit(start), _date_lit(end),
                                                       F.expr("INTERVAL 1 DAY"))).alias(date))
    return densify(sparse, sk, (station, date))
