"""Frames that span days instead of rows (``frame='days'`` of the window operators).

On a sparse panel ``lag 7`` of the row frames is seven rows back.  Here it is
the value seven days back, whatever lies between, and a window of n days holds
the rows of the last n dates.

Rows are cut into chunks by date, and every row is copied, as halo, into the
later chunks whose windows can reach back to it.  A panel has one row per series
and day, so a chunk of ``chunk_rows`` days (grown to the reach of the windows,
so that a row is copied once at most) bounds what a task holds of a series.
For tables with several rows a day ``chunk_days`` finds the widest chunk that
holds ``rows_per_task`` rows at most, from one histogram over days.  A window
runs per (series, chunk) over ``rangeBetween`` of the day number; results do
not depend on the width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .frames import STATION_DATE, SeriesFrame

ROWS_PER_TASK = 200_000
WIDTHS = tuple(4 ** k for k in range(8))  # days: 1 to 16,384


def chunk_days(df: DataFrame, frame: SeriesFrame = STATION_DATE, rows_per_task: int = ROWS_PER_TASK) -> int:
    """The widest of ``WIDTHS`` whose fullest (series, span) has at most ``rows_per_task`` rows, else the narrowest."""
    days = df.groupBy(*frame.keys, F.unix_date(frame.order).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    spans = days.select(*frame.keys, "_n", F.explode(F.array(*[
        F.struct(F.lit(w).alias("w"), F.floor(F.col("_d") / w).alias("s")) for w in WIDTHS])).alias("_x"))
    fullest = spans.groupBy(*frame.keys, "_x").agg(F.sum("_n").alias("_n")).groupBy("_x.w").agg(F.max("_n").alias("n"))
    return max([r.w for r in fullest.collect() if r.n <= rows_per_task], default=WIDTHS[0])  # one row per width


def bounded_days(df: DataFrame, frame: SeriesFrame, build: Callable[[WindowSpec], Mapping[str, Column]], before: int,
                 width: int | None = None) -> DataFrame:
    """Add columns from windows that reach at most ``before`` days back.

    ``build(w)`` gets a window ordered by the day number and returns ``{name:
    expression over w.rangeBetween(-k, 0)}`` with k up to ``before``.  Rows with
    a null date get NULL from every window.
    """
    keys = list(frame.keys)
    width = width or max(frame.chunk_rows, before)
    day = F.unix_date(frame.order)
    d = df.withColumn("_dw_d", day)
    own = F.floor(F.col("_dw_d") / width)
    # the row is needed up to the chunk that holds the day `before` days later
    last = F.floor((F.col("_dw_d") + before) / width)
    copies = F.when(F.col("_dw_d").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(own, last))
    x = d.select("*", F.explode(copies).alias("_dw_c"))
    w = Window.partitionBy(*keys, "_dw_c").orderBy("_dw_d")
    exprs = {n: F.when(F.col("_dw_d").isNotNull(), e) for n, e in build(w).items()}
    keep = [c for c in df.columns if c not in exprs]
    out = x.select(*keep, "_dw_c", "_dw_d", *[e.alias(n) for n, e in exprs.items()])
    mine = F.col("_dw_d").isNull() | (F.col("_dw_c") == F.floor(F.col("_dw_d") / width))
    return out.where(mine).drop("_dw_c", "_dw_d")


def _cols(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _at(c: str, k: int, w: WindowSpec) -> Column:
    """The value exactly k days back; of several rows on that day the largest, NULL if there is none."""
    return F.max(c).over(w.rangeBetween(-k, -k))


def lags_days(df: DataFrame, cols, periods: Sequence[int], frame: SeriesFrame = STATION_DATE, name: str = "{col}_lag_{k}days",
              width: int | None = None) -> DataFrame:
    """The value ``k`` days back (WIN1 by days)."""
    cols = _cols(cols)
    return bounded_days(df, frame, lambda w: {name.format(col=c, k=k): _at(c, k, w) for c in cols for k in periods}, max(periods), width)


def deltas_days(df: DataFrame, cols, periods: Sequence[int], frame: SeriesFrame = STATION_DATE, name: str = "{col}_delta_{k}days",
                width: int | None = None) -> DataFrame:
    """Today's value less that of ``k`` days back (WIN2 by days)."""
    cols = _cols(cols)
    return bounded_days(df, frame, lambda w: {name.format(col=c, k=k): F.col(c) - _at(c, k, w) for c in cols for k in periods},
                        max(periods), width)


def growth_days(df: DataFrame, cols, periods: Sequence[int], frame: SeriesFrame = STATION_DATE, name: str = "{col}_growth_{k}days",
                width: int | None = None) -> DataFrame:
    """``x / x(k days back) - 1`` (WIN5 by days); NULL where the denominator is 0 or missing."""
    cols = _cols(cols)
    return bounded_days(df, frame, lambda w: {name.format(col=c, k=k): F.try_divide(F.col(c), _at(c, k, w)) - 1 for c in cols for k in periods},
                        max(periods), width)


_STATS = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}


def rolling_days(df: DataFrame, cols, sizes: Sequence[int], stats: Iterable[str] = ("mean",), frame: SeriesFrame = STATION_DATE,
                 min_periods: int | dict[str, int] = 1, name: str = "{col}_roll{stat}_{n}days", width: int | None = None) -> DataFrame:
    """Statistics over the rows of the last ``n`` days, today's included (WIN6, WIN7, WIN11 by days).

    ``min_periods`` values have to be there (per statistic if a dict).
    """
    cols, stats = _cols(cols), list(stats)

    def build(w):
        out = {}
        for c in cols:
            for n in sizes:
                ww = w.rangeBetween(-(n - 1), 0)
                for s in stats:
                    m = min_periods.get(s, 1) if isinstance(min_periods, dict) else min_periods
                    val = _STATS[s](c).over(ww)
                    out[name.format(col=c, stat=s, n=n)] = val if m <= 1 else F.when(F.count(c).over(ww) >= m, val)
        return out

    return bounded_days(df, frame, build, max(sizes) - 1, width)


def deviation_days(df: DataFrame, col: str, n: int, frame: SeriesFrame = STATION_DATE, width: int | None = None) -> DataFrame:
    """Deviation from the mean of the last ``n`` days, absolute and in % (WIN17 by days); a mean of 0 gives NULL."""
    def build(w):
        m = F.avg(col).over(w.rangeBetween(-(n - 1), 0))
        return {f"{col}_dev_{n}days": F.col(col) - m, f"{col}_dev_pct_{n}days": F.try_divide(F.col(col) - m, m) * 100}

    return bounded_days(df, frame, build, n - 1, width)
