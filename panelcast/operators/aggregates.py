"""Grouped aggregates, pivots and panel statistics (AGG1-AGG17, AGG24-AGG34).

All aggregates use partial (map-side) aggregation; windows only ever run over
already aggregated rows (one per station / value / column), never over raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import STATION_DATE, SeriesFrame, bounded
from .quantiles import quantiles


def collapse_duplicates(df: DataFrame, keys: Sequence[str], mean_cols: Sequence[str],
                        first_cols: Sequence[str] = (), ordinal: str | None = None) -> DataFrame:
    """Duplicate keys -> one row: mean of measurements, first non-NULL of the rest (AGG1).

    "First" follows ``ordinal`` (ingest order, e.g. file name + row number);
    ``min_by`` is a partial aggregate, so duplicates of a hot key are combined
    map-side.
    """
    aggs = [F.avg(c).alias(c) for c in mean_cols]
    for c in first_cols:
        if ordinal:
            aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c))
        else:
            aggs.append(F.first(c, True).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def group_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "") -> DataFrame:
    """AGG2."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c + suffix) for c in cols])


def group_sum(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "") -> DataFrame:
    """AGG5."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c + suffix) for c in cols])


def median_mean(df: DataFrame, keys: Sequence[str], median_cols: Sequence[str],
                mean_cols: Sequence[str] = ()) -> DataFrame:
    """Median for most columns, mean for some (AGG3)."""
    med = quantiles(df, median_cols, [0.5], by=keys, name="{col}")
    if not mean_cols:
        return med
    mean = group_mean(df, keys, mean_cols)
    return med.join(mean, list(keys), "full")


def mean_and_median(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``{col}_mean`` and ``{col}_median`` per group (AGG4)."""
    med = quantiles(df, cols, [0.5], by=keys, name="{col}_median")
    mean = group_mean(df, keys, cols, suffix="_mean")
    return mean.join(med, list(keys), "left")


def pivot(df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], value: str,
          agg: str = "avg") -> DataFrame:
    """Long -> wide with a fixed value list (AGG6): no job to discover the values,
    duplicates averaged like ``pivot_table``."""
    fn = {"avg": F.avg, "sum": F.sum, "first": lambda c: F.first(c, True), "count": F.count}[agg]
    return df.groupBy(*index).pivot(column, list(values)).agg(fn(value))


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "parameter",
            val: str = "value") -> DataFrame:
    """Wide -> long (AGG7)."""
    return df.unpivot(list(ids), list(cols), var, val)


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str], margins: bool = True,
             total: str = "All", other: str = "Other") -> DataFrame:
    """Counts row x col with optional margins (AGG8).  Values that are not listed count
    under ``other``; rows without a value are left out, as in a frequency table.
    Margins are sums of the pivoted counts."""
    df = df.where(F.col(col).isNotNull()).withColumn(col, F.when(F.col(col).isin(*values), F.col(col)).otherwise(other))
    values = [*values, other]
    base = df.groupBy(row).pivot(col, list(values)).count().na.fill(0, subset=list(values))
    base = base.select(row, *[F.col(f"`{v}`").cast("long").alias(v) for v in values])
    if not margins:
        return base
    base = base.withColumn(total, sum((F.col(f"`{v}`") for v in values), F.lit(0)).cast("long"))
    tot = base.agg(*[F.sum(F.col(f"`{v}`")).cast("long").alias(v) for v in list(values) + [total]]) \
              .select(F.lit(total).alias(row), *values, total)
    return base.unionByName(tot)


def stacked_counts(df: DataFrame, row: str, by: str, col: str, values: Sequence[str], total: str = "All",
                   other: str = "Other") -> DataFrame:
    """Counts of ``col`` per (row, by), and per ``by`` over all rows, whose ``row`` is NULL (AGG8 by month).

    One grouping of the data; the margin adds up its result."""
    x = df.where(F.col(col).isNotNull())
    names = {v: F.col(col) == v for v in values} | {other: ~F.col(col).isin(*values), total: F.lit(True)}
    cells = x.groupBy(row, by).agg(*[F.count_if(c).alias(n) for n, c in names.items()])
    margin = cells.groupBy(by).agg(*[F.sum(F.col(f"`{n}`")).cast("long").alias(n) for n in names])
    return cells.unionByName(margin.withColumn(row, F.lit(None).cast(df.schema[row].dataType)))


def value_counts(df: DataFrame, cols: Sequence[str], share: str = "share") -> DataFrame:
    """Counts per value combination and their share of all rows (AGG9).  The total is
    a one-row aggregate, so high-cardinality columns never meet in one task."""
    c = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))
    tot = c.agg(F.sum("count").alias("_tot"))          # one row, attached by broadcast
    return _attach_row(c, tot).withColumn(share, F.col("count") / F.col("_tot")).drop("_tot")


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Number of distinct values per column, one row (AGG10).

    Exact counts are one partial aggregation per column over that column alone,
    so no row is multiplied by the number of columns."""
    if approx:
        return df.agg(*[F.approx_count_distinct(c).cast("long").alias(c) for c in cols])
    out = None
    for c in cols:
        one = df.agg(F.count_distinct(c).cast("long").alias(c))
        out = one if out is None else _attach_row(out, one)
    return out


def null_report(df: DataFrame, cols: Sequence[str] | None = None, min_pct: float | None = None,
                top: int | None = None) -> DataFrame:
    """Per column: null count and percentage, one pass over the data (AGG11)."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_z{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_z{i}").alias("null_count"))
                                for i, c in enumerate(cols)]))
    r = one.select("_n", stack.alias("_s")).select(
        F.col("_s.column").alias("column"), F.col("_s.null_count").cast("long").alias("null_count"),
        (F.col("_s.null_count") * 100.0 / F.col("_n")).alias("null_pct"))
    if min_pct is not None:
        r = r.where(F.col("null_pct") > min_pct)
    if top is not None:
        r = r.orderBy(F.col("null_pct").desc(), "column").limit(top)
    return r


def null_pct_by(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Null percentage per group and column, rounded to 1 digit (AGG12)."""
    return df.groupBy(*by).agg(*[
        F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 1).alias(c) for c in cols])


def sampling_regime(df: DataFrame, date: str = "date", station: str = "station") -> DataFrame:
    """Per year: rows, distinct dates, distinct stations, rows per date (AGG13)."""
    # rows per (year, date) first: dates and rows need no distinct then
    y = df.groupBy(F.year(date).alias("year"), F.col(date).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    per = y.groupBy("year").agg(F.sum("_n").alias("rows"), F.count("_d").alias("n_dates"))
    st = df.groupBy(F.year(date).alias("year")).agg(F.count_distinct(station).alias("n_stations"))
    return per.join(st, "year").select("year", "rows", "n_dates", "n_stations", (F.col("rows") / F.col("n_dates")).alias("rows_per_date"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once (AGG14, pandas ``keep=False``).

    Counted by ``groupBy`` (partial aggregation) and matched back with a semi
    join, rather than a count window that would gather a hot key in one task.
    """
    dup = df.groupBy(*keys).count().where("count > 1").select(*keys)
    return df.join(dup, list(keys), "left_semi")


def panel_completeness(df: DataFrame, date: str = "date", station: str = "station") -> DataFrame:
    """Expected rows (days x stations) against actual rows (AGG15)."""
    return df.agg(F.count(F.lit(1)).alias("actual_rows"), F.count_distinct(station).alias("n_stations"),
                  F.min(date).alias("first_date"), F.max(date).alias("last_date")).select(
        "first_date", "last_date", "n_stations",
        (F.datediff("last_date", "first_date") + 1).alias("n_days"),
        ((F.datediff("last_date", "first_date") + 1) * F.col("n_stations")).cast("long").alias("expected_rows"),
        "actual_rows")


def series_stats(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "parameter") -> DataFrame:
    """Per (id, parameter): median, q1, q3, iqr, min, max, mean, std (AGG17)."""
    long = unpivot(df.select(*ids, *cols), ids, cols, var, "value").where(F.col("value").isNotNull())
    q = quantiles(long, ["value"], [0.25, 0.5, 0.75], by=list(ids) + [var], name="{col}_{p}")
    q1, q2, q3 = F.col("`value_0.25`"), F.col("`value_0.5`"), F.col("`value_0.75`")
    q = q.select(*ids, var, q2.alias("median"), q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"))
    s = long.groupBy(*ids, var).agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                     F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                     F.count(F.lit(1)).alias("n"))
    return s.join(q, list(ids) + [var])


def spike_flags(df: DataFrame, cols: Sequence[str], q: float = 0.9, thresholds: DataFrame | None = None,
                count_col: str = "elevated_pollutant_count") -> DataFrame:
    """``{col}_spike`` = value above the global ``q`` quantile (NULL -> 0), plus their
    count (MTH5).  The threshold row is fitted once (exact, bracketed
    quantiles) and is a single row, so the join is a broadcast of one row."""
    thr = thresholds if thresholds is not None else quantiles(df, cols, [q], name="_t_{col}")
    j = _attach_row(df, thr)
    flags = {f"{c}_spike": F.coalesce((F.col(c) > F.col(f"_t_{c}")).cast("int"), F.lit(0)) for c in cols}
    j = j.withColumns(flags)
    j = j.withColumn(count_col, sum((F.col(f) for f in flags), F.lit(0)).cast("int"))
    return j.drop(*[f"_t_{c}" for c in cols])


def _attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row (fitted parameters).

    An equi-join on a constant key against a broadcast single row: the size
    bound is exactly one row.
    """
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one") \
             .drop("_one")


attach_params = _attach_row


def band_counts(df: DataFrame, bands: Mapping[str, Sequence[tuple[float, float]]],
                categories: Sequence[str]) -> DataFrame:
    """Number of values inside each closed band, one pass (AGG33)."""
    aggs = []
    for p, bs in bands.items():
        for cat, (lo, hi) in zip(categories, bs):
            if hi == float("inf"):
                continue
            aggs.append(F.count_if(F.col(p).between(F.lit(lo), F.lit(hi))).cast("long")
                        .alias(f"{p}_{cat.lower().replace(' ', '_')}"))
    return df.agg(*aggs)


def overlap_range(a: DataFrame, b: DataFrame, key: str = "station", date: str = "date") -> DataFrame:
    """Overlapping date range of two panels per key (FLT6)."""
    ra = a.groupBy(key).agg(F.min(date).alias("a0"), F.max(date).alias("a1"))
    rb = b.groupBy(key).agg(F.min(date).alias("b0"), F.max(date).alias("b1"))
    j = ra.join(rb, key)
    s, e = F.greatest("a0", "b0"), F.least("a1", "b1")
    return j.select(key, s.alias("overlap_start"), e.alias("overlap_end"),
                    (F.datediff(e, s) + 1).alias("overlap_days"))


def date_range(df: DataFrame, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """min / max date, days spanned and rows (AGG31)."""
    g = df.groupBy(*by) if by else df
    return g.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"),
                  F.count(F.lit(1)).alias("rows")).withColumn(
        "days", F.datediff("max_date", "min_date") + 1)


def seasonal_means(df: DataFrame, cols: Sequence[str], station: str = "station", date: str = "date") -> DataFrame:
    """Mean per (station, month) (AGG27)."""
    return df.groupBy(station, F.month(date).alias("month")).agg(*[F.avg(c).alias(c) for c in cols])


def cross_station_mean(df: DataFrame, cols: Sequence[str], date: str = "date") -> DataFrame:
    """Mean over all stations per date (AGG29)."""
    return df.groupBy(date).agg(*[F.avg(c).alias(c) for c in cols])


def volatility(df: DataFrame, cols: Sequence[str], station: str = "station") -> DataFrame:
    """Mean of per-station sample standard deviations (AGG26)."""
    s = df.groupBy(station).agg(*[F.stddev_samp(c).alias(c) for c in cols])
    return s.agg(*[F.avg(c).alias(f"{c}_volatility") for c in cols])


def station_ratio_median(df: DataFrame, num: str, den: str, station: str = "station",
                         out: str = "ratio") -> DataFrame:
    """Median of num/den per station over valid rows (den > 0), with the overall
    median as fallback for stations without any (AGG28)."""
    valid = df.where(F.col(num).isNotNull() & F.col(den).isNotNull() & (F.col(den) > 0)) \
              .select(station, (F.col(num) / F.col(den)).alias("_r"))
    per = quantiles(valid, ["_r"], [0.5], by=[station], name="station_ratio")
    overall = quantiles(valid, ["_r"], [0.5], name="overall_ratio")
    stations = df.select(station).distinct()
    j = _attach_row(stations.join(per, station, "left"), overall)
    return j.select(station, F.coalesce("station_ratio", "overall_ratio").alias(out),
                    F.col("station_ratio").isNull().cast("int").alias("used_fallback"))


def availability_sets(df: DataFrame, source: str, params: Sequence[str]) -> DataFrame:
    """Per parameter: in how many sources it has any value; common to all / any (AGG30)."""
    long = unpivot(df.select(source, *params), [source], params, "parameter", "value") \
        .where(F.col("value").isNotNull()).select(source, "parameter").distinct()
    all_src = df.agg(F.count_distinct(source).alias("_all"))
    per = long.groupBy("parameter").agg(F.count(F.lit(1)).alias("n_sources"))
    names = df.sparkSession.createDataFrame([(p,) for p in params], "parameter string")
    per = names.join(per, "parameter", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
    return _attach_row(per, all_src).select(
        "parameter", "n_sources", (F.col("n_sources") == F.col("_all")).cast("int").alias("in_all"),
        (F.col("n_sources") > 0).cast("int").alias("in_any"))


def daily_change_stats(df: DataFrame, cols: Sequence[str], frame: SeriesFrame = STATION_DATE) -> DataFrame:
    """Mean / std of day-to-day differences and share of increases, per column (AGG34)."""
    d = bounded(df, frame, lambda w: {f"_d_{c}": F.col(c) - F.lag(c, 1).over(w) for c in cols}, before=1)
    aggs = []
    for c in cols:
        x = F.col(f"_d_{c}")
        aggs += [F.avg(x).alias(f"{c}_diff_mean"), F.stddev_samp(x).alias(f"{c}_diff_std"),
                 F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).alias(f"{c}_share_up")]
    return d.agg(*aggs)


def range_check(history: DataFrame, forecast: DataFrame, cols: Sequence[str], method: str = "method",
                lo_factor: float = 0.8, hi_factor: float = 1.2) -> DataFrame:
    """Forecast vs history: mean/std/min/max/range per method and column, and a status
    (within [0.8 min, 1.2 max] of history) (AGG32)."""
    h = history.agg(*[F.min(c).alias(f"_hmin_{c}") for c in cols], *[F.max(c).alias(f"_hmax_{c}") for c in cols])
    longf = unpivot(forecast.select(method, *cols), [method], cols, "parameter", "value")
    st = longf.groupBy(method, "parameter").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    st = st.withColumn("range", F.col("max") - F.col("min"))
    hl = unpivot(h.select(*[F.struct(F.col(f"_hmin_{c}").alias("lo"), F.col(f"_hmax_{c}").alias("hi")).alias(c)
                            for c in cols]).withColumn("_k", F.lit(1)), ["_k"], cols, "parameter", "_h")
    hl = hl.select("parameter", F.col("_h.lo").alias("hist_min"), F.col("_h.hi").alias("hist_max"))
    j = st.join(F.broadcast(hl), "parameter")
    ok = (F.col("min") >= F.col("hist_min") * lo_factor) & (F.col("max") <= F.col("hist_max") * hi_factor)
    return j.withColumn("status", F.when(ok, "OK").otherwise("OUT_OF_RANGE"))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


def inf_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of +-inf values per column (AGG23); 0 when division is NULL-safe."""
    inf = F.lit(float("inf"))
    return df.agg(*[F.count_if(F.abs(F.col(c).cast("double")) == inf).alias(c) for c in cols])


def variance_ranking(df: DataFrame, cols: Sequence[str], top: int = 20) -> DataFrame:
    """Sample variance per column, highest first (AGG22)."""
    one = df.agg(*[F.var_samp(c).alias(c) for c in cols])
    long = unpivot(one.withColumn("_k", F.lit(1)), ["_k"], cols, "feature", "variance").drop("_k")
    return long.orderBy(F.col("variance").desc_nulls_last(), "feature").limit(top)


def station_summary(df: DataFrame, cols: Sequence[str], category: str, unhealthy: Column, scores: dict[str, float],
                    station: str = "station") -> DataFrame:
    """Per station: means, maxima and sums, the share of every category of ``scores``, the
    unhealthy share, the mean score, and the rank from best (lowest score) to worst (AGG24)."""
    aggs = [F.count(F.lit(1)).alias("days")]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in cols]
    aggs += [F.max(c).alias(f"{c}_max") for c in cols]
    aggs += [F.sum(c).alias(f"{c}_sum") for c in cols]
    aggs += [F.avg(unhealthy.cast("double")).alias("unhealthy_share")]
    aggs += [F.avg((F.col(category) == c).cast("double")).alias(f"{c}_share") for c in scores]
    worth = F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])
    aggs += [F.avg(worth[F.col(category)]).alias("mean_score")]
    s = df.groupBy(station).agg(*aggs)
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_score").asc_nulls_last(), F.col(station))))
