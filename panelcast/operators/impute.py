"""Imputation, capping and bounds (IMP1-IMP11).

Fitted values (medians, clip limits, ratios) are small tables: one row, or one
row per station.  One-row tables are attached by a broadcast of exactly one
row; per-station tables are joined on the station.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import attach_params, station_ratio_median
from .fills import interpolate_time
from .frames import STATION_DATE, SeriesFrame, checkpoint
from .joins import seasonal_fill
from .quantiles import quantiles, winsor_limits

INF = float("inf")


def ratio_impute(df: DataFrame, target: str, source: str, station: str = "station",
                 ratio: DataFrame | None = None) -> DataFrame:
    """target := source / station ratio where target is NULL and source is not (IMP1).

    The ratio is the station median of ``source / target`` over valid rows with
    the overall median as fallback (AGG28), fitted on ``df`` unless given.
    """
    r = ratio if ratio is not None else station_ratio_median(df, source, target, station, out="_ratio")
    j = df.join(r.select(station, F.col(r.columns[1]).alias("_ratio")), station, "left")
    filled = F.when(F.col(target).isNull() & F.col(source).isNotNull(),
                    F.try_divide(F.col(source), F.col("_ratio"))).otherwise(F.col(target))
    return j.withColumn(target, filled).drop("_ratio")


def fill_station_then_global(df: DataFrame, cols: Sequence[str], station: str = "station") -> DataFrame:
    """Station median fill, then the global median of the station-filled data (IMP2)."""
    med = quantiles(df, cols, [0.5], by=[station], name="_sm_{col}")
    j = df.join(med, station, "left")
    j = j.withColumns({c: F.coalesce(F.col(c), F.col(f"_sm_{c}")) for c in cols}).drop(
        *[f"_sm_{c}" for c in cols])
    glob = quantiles(j, cols, [0.5], name="_gm_{col}")
    j = attach_params(j, glob)
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_gm_{c}")) for c in cols}).drop(
        *[f"_gm_{c}" for c in cols])


def fit_medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row table of training medians (IMP3)."""
    return quantiles(train, cols, [0.5], name="_med_{col}")


def apply_medians(df: DataFrame, medians: DataFrame, cols: Sequence[str], default: float = 0.0) -> DataFrame:
    """NULL -> training median; a column that was all NULL in training -> ``default`` (IMP3)."""
    j = attach_params(df, medians)
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}"), F.lit(default)) for c in cols}) \
            .drop(*[f"_med_{c}" for c in cols])


def replace_inf(df: DataFrame, cols: Sequence[str], with_median: bool = True, cap: float | None = None) -> DataFrame:
    """+-inf -> NULL -> column median (IMP4), or -> +-cap when ``cap`` is given."""
    x = df
    for c in cols:
        v = F.col(c)
        if cap is not None:
            x = x.withColumn(c, F.when(v == INF, F.lit(cap)).when(v == -INF, F.lit(-cap)).otherwise(v))
        else:
            x = x.withColumn(c, F.when(F.abs(v) == INF, F.lit(None).cast("double")).otherwise(v))
    if cap is None and with_median:
        x = apply_medians(x, fit_medians(x, cols), cols, default=None)
    return x


def fit_clip_limits(train: DataFrame, cols: Sequence[str], lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """One-row table of ``_lo_{col}``, ``_hi_{col}`` (exact quantiles) (IMP5)."""
    q = quantiles(train, cols, [lo, hi], name="_q_{col}_{p}")
    return q.select(*[F.col(f"`_q_{c}_{lo}`").alias(f"_lo_{c}") for c in cols],
                    *[F.col(f"`_q_{c}_{hi}`").alias(f"_hi_{c}") for c in cols])


def apply_clip(df: DataFrame, limits: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Clip to fitted limits keeping NULLs (``when``, not ``least/greatest``) (IMP5)."""
    j = attach_params(df, limits)
    out = {c: F.when(F.col(c) < F.col(f"_lo_{c}"), F.col(f"_lo_{c}"))
               .when(F.col(c) > F.col(f"_hi_{c}"), F.col(f"_hi_{c}")).otherwise(F.col(c)) for c in cols}
    return j.withColumns(out).drop(*[f"_lo_{c}" for c in cols], *[f"_hi_{c}" for c in cols])


def winsorise(train: DataFrame, forecast: DataFrame, cols: Sequence[str], lo: float = 0.001,
              hi: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """Clip training rows to their limits, then clip forecast rows to the limits of the
    *clipped* training data, as the reference does (IMP5)."""
    both = checkpoint(winsor_limits(train, cols, lo, hi))  # one row, read by both sides
    first = both.select(*[f"_{e}_{c}" for c in cols for e in ("lo", "hi")])
    second = both.select(*[F.col(f"_{e}2_{c}").alias(f"_{e}_{c}") for c in cols for e in ("lo", "hi")])
    return apply_clip(train, first, cols), apply_clip(forecast, second, cols)


def cap_upper(df: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    """Values above a domain cap -> the cap (IMP6)."""
    return df.withColumns({c: F.when(F.col(c) > F.lit(cap), F.lit(float(cap))).otherwise(F.col(c))
                           for c, cap in caps.items()})


def cap_report(df: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    """Per capped column: values above the cap, original maximum, cap (IMP6 report)."""
    one = df.agg(*[F.count_if(F.col(c) > F.lit(cap)).alias(f"_n_{c}") for c, cap in caps.items()],
                 *[F.max(c).alias(f"_m_{c}") for c in caps])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n_{c}").cast("long").alias("n_capped"),
                                        F.col(f"_m_{c}").cast("double").alias("original_max"),
                                        F.lit(float(cap)).alias("cap")) for c, cap in caps.items()]))
    return one.select(rows.alias("r")).select("r.*")


def backcast_seasonal(skeleton: DataFrame, fit: DataFrame, cols: Sequence[str], station: str = "station",
                      date: str = "date") -> DataFrame:
    """Rows for periods without data get the (station, month) mean of ``fit``, else the
    station median (IMP7)."""
    empty = skeleton.select(station, date, *[F.lit(None).cast("double").alias(c) for c in cols])
    return seasonal_fill(empty, cols, fit, station, date)


def gap_interpolate(df: DataFrame, gap_skeleton: DataFrame, cols: Sequence[str],
                    frame: SeriesFrame = STATION_DATE) -> DataFrame:
    """Add all-NULL rows for a gap period, then time-interpolate per series (IMP8)."""
    keys = list(frame.keys) + [frame.order]
    gap = gap_skeleton.join(df.select(*keys), keys, "left_anti") \
                      .select(*keys, *[F.lit(None).cast("double").alias(c) for c in cols])
    return interpolate_time(df.select(*keys, *cols).unionByName(gap), cols, frame)


def bounded_forecast(forecast: DataFrame, history: DataFrame, col: str, station: str = "station",
                     date: str = "date", max_outside: float = 0.3) -> DataFrame:
    """Keep a forecast inside ``[max(0.8 min, med - 3 iqr), min(1.2 max, med + 3 iqr)]`` of
    its station's history; if more than 30 % of a station's forecast is outside,
    use the seasonal (station, month) mean instead (IMP9)."""
    history = checkpoint(history.select(station, date, col))   # read by quantiles, extremes and seasonal means
    q = quantiles(history, [col], [0.25, 0.5, 0.75], by=[station], name="_q{p}")
    b = history.groupBy(station).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx")).join(q, station)
    iqr = F.col("`_q0.75`") - F.col("`_q0.25`")
    b = b.select(station, F.greatest(F.col("_mn") * 0.8, F.col("`_q0.5`") - iqr * 3).alias("_lo"),
                 F.least(F.col("_mx") * 1.2, F.col("`_q0.5`") + iqr * 3).alias("_hi"), F.col("`_q0.5`").alias("_med"))
    f = forecast.join(checkpoint(b), station, "left")          # one row per station, read by the share and the rows
    outside = ((F.col(col) < F.col("_lo")) | (F.col(col) > F.col("_hi"))).cast("double")
    f = f.join(f.groupBy(station).agg(F.avg(outside).alias("_share")), station, "left")
    # the (station, month) mean, else the station median, as in seasonal_fill
    season = history.groupBy(station, F.month(date).alias("_m")).agg(F.avg(col).alias("_s"))
    f = f.withColumn("_m", F.month(date)).join(season, [station, "_m"], "left").withColumn("_seasonal", F.coalesce("_s", "_med"))
    clipped = F.when(F.col(col) < F.col("_lo"), F.col("_lo")).when(F.col(col) > F.col("_hi"), F.col("_hi")) \
               .otherwise(F.col(col))
    return f.select(*[c for c in forecast.columns if c != col],
                    F.when(F.col("_share") > max_outside, F.col("_seasonal")).otherwise(clipped).alias(col),
                    (F.col("_share") > max_outside).cast("int").alias("used_seasonal"))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """NULL -> constant per column (IMP10)."""
    return df.na.fill(dict(values))


def stitch(parts: Mapping[str, DataFrame], date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Union labelled parts (backcast / observed / forecast) and count rows per
    (year, source) (IMP11).  Returns (stitched, provenance)."""
    labelled = [p.withColumn("source", F.lit(name)) for name, p in parts.items()]
    out = labelled[0]
    for p in labelled[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    prov = out.groupBy(F.year(date).alias("year"), "source").agg(F.count(F.lit(1)).alias("rows"))
    return out, prov
