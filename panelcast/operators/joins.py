"""Panel joins (JN1-JN6, JN9, JN10, JN14-JN16, PRJ10).

Panels join on the full key (station, date), so a hot station still spreads
over all partitions.  How a dimension is joined is left to the planner, which
knows its size in bytes when it runs; only one-row parameter tables are
broadcast by hint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import STATION_DATE, SeriesFrame, checkpoint, scan
from .quantiles import quantiles

PANEL_KEYS = ("station", "date")


def drop_colliding(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right side without the non-key columns the left already has (PRJ10: left wins)."""
    taken = set(left.columns)
    return right.select(*[c for c in right.columns if c in keys or c not in taken])


def join_panels(spine: DataFrame, others: Sequence[DataFrame], keys: Sequence[str] = PANEL_KEYS,
                how: str = "left") -> DataFrame:
    """Multi-way join onto a spine panel (JN1, JN3 with ``how='inner'``).

    Colliding columns are dropped from the right side *before* each join, so
    there are no suffixed duplicates to clean up afterwards.
    """
    out = spine
    for o in others:
        out = out.join(drop_colliding(out, o, keys), list(keys), how)
    return out


def join_by_date(panel: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    """Date-only left join of a calendar onto every station (JN2).  A calendar has
    one row per day."""
    cal = drop_colliding(panel, calendar, [date])
    return panel.join(cal, date, "left")


def lookup_join(df: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Dimension lookup left join (JN4)."""
    return df.join(drop_colliding(df, dim, [on] if isinstance(on, str) else on),
                   on, "left")


def map_lookup(c, mapping: Mapping[str, str]) -> Column:
    """Dictionary lookup as a literal map (JN5): no join at all for a fixed dictionary."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    col = F.col(c) if isinstance(c, str) else c
    return m[col]


def unmatched(df: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows without a dimension match (JN5 report): an anti join."""
    return df.join(dim, on, "left_anti")


def complete_pivot(long: DataFrame, index: Sequence[str], type_col: str, types: Sequence[str],
                   param_col: str, params: Sequence[str], value: str = "value") -> DataFrame:
    """Wide table of all parameters for index rows that have *every* parameter type (JN6).

    Replaces one pivot per type plus inner joins with one ``groupBy.pivot`` and a
    ``having`` on the number of types present.
    """
    wide = long.groupBy(*index).pivot(param_col, list(params)).agg(F.avg(value))
    have = (long.where(F.col(value).isNotNull() & F.col(type_col).isin(*types))
                .groupBy(*index).agg(F.count_distinct(type_col).alias("_n_types"))
                .where(F.col("_n_types") == len(types)).select(*index))
    return wide.join(have, list(index), "left_semi")


def last_known_row(history: DataFrame, future: DataFrame, features: Sequence[str], station: str = "station",
                   date: str = "date", at_date=None) -> DataFrame:
    """Carry the features of the last known row to every future row (JN9).

    ``at_date=None``: latest row per station (``max_by``); ``at_date=d``: the row
    at exactly ``d`` (stations without it get NULLs).  One row per station,
    joined on the station.
    """
    if at_date is None:
        last = history.groupBy(station).agg(F.max_by(F.struct(*features), F.col(date)).alias("_l"))
    else:
        last = history.where(F.col(date) == F.lit(at_date).cast("date")) \
                      .groupBy(station).agg(F.first(F.struct(*features)).alias("_l"))
    last = last.select(station, *[F.col("_l")[c].alias(c) for c in features])
    return future.join(last, station, "left")


def asof_reindex(obs: DataFrame, skeleton: DataFrame, cols: Sequence[str], station: str = "station",
                 date: str = "date") -> DataFrame:
    """Reindex a wide date x station table with ``method='ffill'``, then ``bfill`` (JN10).

    Each skeleton day takes the last *observation date* (over all stations) at or
    before it, and every station's value on that date, NULL included; the
    result is then backward filled per station.  The as-of mapping runs on the
    distinct dates only (bounded by calendar days, not by data).
    """
    obs = checkpoint(obs.select(station, date, *cols))   # read for its dates and for its values
    odates = obs.select(date).distinct().select(date, F.col(date).alias("_asof"))
    days = skeleton.select(date).distinct().select(date, F.lit(None).cast("date").alias("_asof"))
    both = odates.unionByName(days).groupBy(date).agg(F.max("_asof").alias("_asof"))
    m = checkpoint(scan(both, SeriesFrame((), date), ffill={"_asof": F.col("_asof")}))   # one row per calendar day
    sk = skeleton.join(m, date, "left")
    vals = obs.select(station, F.col(date).alias("_asof"), *cols)
    j = sk.join(vals, [station, "_asof"], "left").drop("_asof")
    return scan(j, SeriesFrame((station,), date), bfill={c: F.col(c) for c in cols})


def key_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present in both (JN14, SET2): ``intersect`` of the key sets."""
    return a.select(*keys).intersect(b.select(*keys))


def seasonal_fill(df: DataFrame, cols: Sequence[str], fit: DataFrame, station: str = "station",
                  date: str = "date") -> DataFrame:
    """Missing values from the (station, month) mean of ``fit``, else the station
    median of ``fit`` (JN15 / IMP7).  Both lookups are aggregates joined back."""
    season = fit.groupBy(station, F.month(date).alias("_m")).agg(*[F.avg(c).alias(f"_s_{c}") for c in cols])
    med = quantiles(fit, cols, [0.5], by=[station], name="_md_{col}")
    j = df.withColumn("_m", F.month(date)).join(season, [station, "_m"], "left").join(med, station, "left")
    out = {c: F.coalesce(F.col(c), F.col(f"_s_{c}"), F.col(f"_md_{c}")) for c in cols}
    return j.withColumns(out).drop("_m", *[f"_s_{c}" for c in cols], *[f"_md_{c}" for c in cols])


def target_encode(df: DataFrame, key: str, target: str, out: str | None = None,
                  fit: DataFrame | None = None) -> DataFrame:
    """Group mean of ``target`` mapped back to the rows (JN16).  ``fit`` restricts the
    mean to training rows (leak-free); default all rows, like the reference."""
    src = fit if fit is not None else df
    enc = src.groupBy(key).agg(F.avg(target).alias(out or f"{key}_{target}_mean"))
    return df.join(enc, key, "left")
