"""Fills, staleness and gap features per series (WIN8-WIN10, WIN12-WIN16).

All are built on :func:`panelcast.operators.frames.scan`, so a long series is
processed in date buckets rather than in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import STATION_DATE, SeriesFrame, order_number, scan


def _cols(cols: str | Iterable[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def ffill(df: DataFrame, cols, frame: SeriesFrame = STATION_DATE, suffix: str = "") -> DataFrame:
    """Forward fill (WIN8): last non-NULL value at or before the row, per series."""
    return scan(df, frame, ffill={c + suffix: F.col(c) for c in _cols(cols)})


def bfill(df: DataFrame, cols, frame: SeriesFrame = STATION_DATE, suffix: str = "") -> DataFrame:
    """Backward fill (WIN9): first non-NULL value at or after the row, per series."""
    return scan(df, frame, bfill={c + suffix: F.col(c) for c in _cols(cols)})


def fill_both(df: DataFrame, cols, frame: SeriesFrame = STATION_DATE,
              first: str = "bfill", suffix: str = "") -> DataFrame:
    """Both directions in one scan (WIN10).

    ``first='bfill'`` is pandas ``bfill().ffill()``: a gap takes the *next* value,
    only the trailing gap takes the previous one.  ``first='ffill'`` is the mirror.
    """
    cols = _cols(cols)
    d = scan(df, frame,
             ffill={f"_pf_{c}": F.col(c) for c in cols},
             bfill={f"_pb_{c}": F.col(c) for c in cols})
    out = {}
    for c in cols:
        f, b = F.col(f"_pf_{c}"), F.col(f"_pb_{c}")
        out[c + suffix] = F.coalesce(b, f) if first == "bfill" else F.coalesce(f, b)
    return d.withColumns(out).drop(*[f"_pf_{c}" for c in cols], *[f"_pb_{c}" for c in cols])


def days_since(df: DataFrame, observed, out: str, frame: SeriesFrame = STATION_DATE,
               before_first: int | None = -1, also_ffill=None, row_index: str | None = None) -> DataFrame:
    """Days since the last row where ``observed`` holds (WIN12); ``before_first`` otherwise.

    ``observed`` is a boolean column (e.g. ``col.isNotNull()`` or a source flag).
    ``also_ffill`` lists columns to forward fill in the same scan; ``row_index``
    names a series row-number column to add in the same scan (for later
    windows via ``frame.with_index``).
    """
    order = F.col(frame.order)
    extra = {c: F.col(c) for c in _cols(also_ffill)} if also_ffill else {}
    d = scan(df, frame, ffill={"_ds_last": F.when(observed, order), **extra}, row_index=row_index)
    diff = F.datediff(order, F.col("_ds_last"))
    val = diff if before_first is None else F.coalesce(diff, F.lit(before_first))
    return d.withColumn(out, val.cast("int")).drop("_ds_last")


def staleness_counter(df: DataFrame, cols, frame: SeriesFrame = STATION_DATE,
                      suffix: str = "_days_stale", fill: bool = True) -> DataFrame:
    """Run counter per column (WIN13): 0 on a real value, previous + 1 otherwise;
    before the first real value it counts 1, 2, 3, ... .  With ``fill`` the
    columns are forward filled in the same scan, as the reference does."""
    cols = _cols(cols)
    d = scan(df, frame, row_index="_sc_rn",
             last_index={f"_sc_{c}": F.col(c).isNotNull() for c in cols},
             ffill={c: F.col(c) for c in cols} if fill else None)
    out = {c + suffix: (F.col("_sc_rn") - F.coalesce(F.col(f"_sc_{c}"), F.lit(0))).cast("int")
           for c in cols}
    return d.withColumns(out).drop("_sc_rn", *[f"_sc_{c}" for c in cols])


def availability_flag(df: DataFrame, cols, frame: SeriesFrame = STATION_DATE,
                      suffix: str = "_available", source: DataFrame | None = None) -> DataFrame:
    """1 from the first date a column is non-NULL in the series, else 0 (WIN14).

    The first valid date is a grouped ``min`` (partial aggregation, one row per
    series) joined back, not a whole-series window.  ``source`` is the frame
    whose first valid dates count (the sparse panel before densifying);
    default ``df`` itself.
    """
    cols = _cols(cols)
    keys = list(frame.keys)
    src = df if source is None else source
    first = src.groupBy(*keys).agg(*[
        F.min(F.when(F.col(c).isNotNull(), F.col(frame.order))).alias(f"_af_{c}") for c in cols])
    j = df.join(first, keys, "left")
    out = {c + suffix: F.coalesce((F.col(frame.order) >= F.col(f"_af_{c}")).cast("int"), F.lit(0))
           for c in cols}
    return j.withColumns(out).drop(*[f"_af_{c}" for c in cols])


def spells(df: DataFrame, flag: str, frame: SeriesFrame = STATION_DATE,
           dry: str = "dry_spell", wet: str = "wet_spell") -> DataFrame:
    """Gaps-and-islands run lengths of a 0/1 flag (WIN15).

    dry = rows since the last flag=1 row (0 on flag rows); wet = rows since the
    last flag=0 row (0 on non-flag rows).  Expressed with the series row index
    and two forward fills, so runs may cross bucket boundaries freely.
    """
    f = F.coalesce(F.col(flag).cast("int"), F.lit(0))
    d = scan(df, frame, row_index="_sp_rn", last_index={"_sp_last1": f == 1, "_sp_last0": f == 0})
    rn = F.col("_sp_rn")
    return (d.withColumns({
        dry: F.when(f == 1, 0).otherwise(rn - F.coalesce(F.col("_sp_last1"), F.lit(0))).cast("int"),
        wet: F.when(f == 0, 0).otherwise(rn - F.coalesce(F.col("_sp_last0"), F.lit(0))).cast("int"),
    }).drop("_sp_rn", "_sp_last1", "_sp_last0"))


def interpolate_time(df: DataFrame, cols, frame: SeriesFrame = STATION_DATE,
                     suffix: str = "") -> DataFrame:
    """Time-weighted linear interpolation, both directions (WIN16).

    Inner gaps: ``prev + (next - prev) * (t - t_prev) / (t_next - t_prev)``;
    leading / trailing gaps take the nearest value (pandas
    ``interpolate(method='time', limit_direction='both')``).
    """
    cols = _cols(cols)
    t = order_number(df, frame.order)
    ff, bf = {}, {}
    for c in cols:
        ff[f"_it_pv_{c}"] = F.col(c)
        ff[f"_it_pt_{c}"] = F.when(F.col(c).isNotNull(), t)
        bf[f"_it_nv_{c}"] = F.col(c)
        bf[f"_it_nt_{c}"] = F.when(F.col(c).isNotNull(), t)
    d = scan(df.withColumn("_it_t", t), frame, ffill=ff, bfill=bf)
    out = {}
    for c in cols:
        pv, pt = F.col(f"_it_pv_{c}"), F.col(f"_it_pt_{c}")
        nv, nt = F.col(f"_it_nv_{c}"), F.col(f"_it_nt_{c}")
        inner = pv + (nv - pv) * F.try_divide(F.col("_it_t") - pt, nt - pt)
        out[c + suffix] = F.when(F.col(c).isNotNull(), F.col(c)).when(
            pv.isNotNull() & nv.isNotNull(), F.coalesce(inner, pv)).otherwise(F.coalesce(pv, nv))
    tmp = [k for k in list(ff) + list(bf)] + ["_it_t"]
    return d.withColumns(out).drop(*tmp)
