"""Lag, change and rolling features per series (WIN1-WIN7, WIN11, WIN17-WIN19, WIN21-WIN23).

Row-based frames mirror pandas ``groupby(...).shift/rolling`` on a series
sorted by date: on a sparse panel ``lag 7`` is seven *rows* back.  Every
feature of one call is computed by one :func:`frames.bounded` pass (one
exchange, one sort), however many columns and widths are asked for.
"""

from __future__ import annotations

import math

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import STATION_DATE, SeriesFrame, bounded, bucket_of, scan


def _cols(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def lags(df: DataFrame, cols, periods: Sequence[int], frame: SeriesFrame = STATION_DATE,
         name: str = "{col}_lag_{k}d") -> DataFrame:
    """``lag(col, k)`` for every col and k (WIN1)."""
    cols = _cols(cols)

    def build(w):
        return {name.format(col=c, k=k): F.lag(c, k).over(w) for c in cols for k in periods}

    return bounded(df, frame, build, before=max(periods))


def deltas(df: DataFrame, cols, periods: Sequence[int], frame: SeriesFrame = STATION_DATE,
           name: str = "{col}_delta_{k}d") -> DataFrame:
    """``col - lag(col, k)`` (WIN2)."""
    cols = _cols(cols)

    def build(w):
        return {name.format(col=c, k=k): F.col(c) - F.lag(c, k).over(w) for c in cols for k in periods}

    return bounded(df, frame, build, before=max(periods))


def pct_changes(df: DataFrame, cols, periods: Sequence[int], frame: SeriesFrame = STATION_DATE,
                name: str = "{col}_pct_change_{k}d", pad: bool = True) -> DataFrame:
    """``x / lag(x, k) - 1`` on the forward-filled series (WIN3).

    A zero denominator gives NULL (pandas gives +-inf; every consumer turns it
    into missing).  ``pad=False`` skips the forward fill.
    """
    cols = _cols(cols)
    src = {c: (f"_pp_{c}" if pad else c) for c in cols}
    d = scan(df, frame, ffill={src[c]: F.col(c) for c in cols}) if pad else df

    def build(w):
        return {name.format(col=c, k=k): F.try_divide(F.col(src[c]), F.lag(src[c], k).over(w)) - 1
                for c in cols for k in periods}

    out = bounded(d, frame, build, before=max(periods))
    return out.drop(*[src[c] for c in cols]) if pad else out


def stabilised_pct_change(df: DataFrame, cols, periods: Sequence[int],
                          frame: SeriesFrame = STATION_DATE, eps: float = 1e-8,
                          name: str = "{col}_pct_change_{k}") -> DataFrame:
    """``(x - lag) / (lag + eps) * 100`` (WIN4)."""
    cols = _cols(cols)

    def build(w):
        out = {}
        for c in cols:
            for k in periods:
                lag = F.lag(c, k).over(w)
                out[name.format(col=c, k=k)] = F.try_divide(F.col(c) - lag, lag + F.lit(eps)) * 100
        return out

    return bounded(df, frame, build, before=max(periods))


def ratio_growth(df: DataFrame, col: str, k: int, out: str,
                 frame: SeriesFrame = STATION_DATE) -> DataFrame:
    """``x / lag(x, k) - 1`` without padding (WIN5)."""
    return bounded(df, frame, lambda w: {out: F.try_divide(F.col(col), F.lag(col, k).over(w)) - 1},
                   before=k)


_STATS = {
    "mean": F.avg,
    "sum": F.sum,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
}


def rolling(df: DataFrame, cols, sizes: Sequence[int], stats: Iterable[str] = ("mean",),
            frame: SeriesFrame = STATION_DATE, min_periods: int | dict[str, int] = 1,
            name: str = "{col}_roll{stat}_{n}d") -> DataFrame:
    """Trailing rolling statistics over ``n`` rows including the current one (WIN6, WIN7, WIN11).

    ``min_periods`` is the number of non-NULL values needed (per stat if a dict),
    as in pandas ``rolling(n, min_periods=m)``; the sample std of one value is NULL.
    """
    cols = _cols(cols)
    stats = list(stats)

    def need(stat):
        return min_periods.get(stat, 1) if isinstance(min_periods, dict) else min_periods

    def build(w):
        out = {}
        for c in cols:
            for n in sizes:
                ww = w.rowsBetween(-(n - 1), 0)
                cnt = F.count(c).over(ww)
                for s in stats:
                    val = _STATS[s](c).over(ww)
                    m = need(s)
                    out[name.format(col=c, stat=s, n=n)] = val if m <= 1 else F.when(cnt >= m, val)
        return out

    return bounded(df, frame, build, before=max(sizes) - 1)


def rolling_deviation(df: DataFrame, col: str, n: int, frame: SeriesFrame = STATION_DATE,
                      prefix: str | None = None) -> DataFrame:
    """Deviation from the trailing ``n``-row mean, absolute and in % (WIN17); 0 mean -> NULL."""
    p = prefix or col

    def build(w):
        m = F.avg(col).over(w.rowsBetween(-(n - 1), 0))
        return {f"{p}_dev_{n}d": F.col(col) - m,
                f"{p}_dev_pct_{n}d": F.try_divide(F.col(col) - m, m) * 100}

    return bounded(df, frame, build, before=n - 1)


def last_rows(df: DataFrame, n: int, frame: SeriesFrame = STATION_DATE) -> DataFrame:
    """The last ``n`` rows of every series (WIN19).

    Two-level top-n: the latest ``n`` rows per (series, bucket) first, then the
    latest ``n`` of those per series, so no task sorts a whole series.
    """
    keys = list(frame.keys)
    d = df.withColumn("_lr_b", bucket_of(df, frame))
    w1 = Window.partitionBy(*keys, "_lr_b").orderBy(F.col(frame.order).desc())
    d = d.withColumn("_lr", F.row_number().over(w1)).filter(F.col("_lr") <= n)
    w2 = Window.partitionBy(*keys).orderBy(F.col(frame.order).desc())
    return (d.withColumn("_lr", F.row_number().over(w2)).filter(F.col("_lr") <= n)
             .drop("_lr", "_lr_b"))


def latest_row(df: DataFrame, frame: SeriesFrame = STATION_DATE) -> DataFrame:
    """The latest row per series as a grouped ``max_by`` (partial aggregation)."""
    keys = list(frame.keys)
    others = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(frame.order)).alias("_l"))
    return agg.select(*keys, *[F.col("_l")[c].alias(c) for c in others])


def positional_split(df: DataFrame, frac: float = 0.85, frame: SeriesFrame = STATION_DATE,
                     out: str = "is_train") -> DataFrame:
    """Chronological split per series (WIN22, leak-free): the first ``frac`` of each
    series' rows are training rows."""
    keys = list(frame.keys)
    d = scan(df, frame, row_index="_ps_rn")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ps_n"))
    d = d.join(n, keys, "left")
    return d.withColumn(out, (F.col("_ps_rn") <= F.floor(F.col("_ps_n") * F.lit(frac))).cast("int")) \
            .drop("_ps_rn", "_ps_n")


def date_split(df: DataFrame, last_train_date, date: str = "date", out: str = "is_train") -> DataFrame:
    """Split by one global cut-off date (WIN22 by date, FLT3)."""
    return df.withColumn(out, (F.col(date) <= F.lit(last_train_date).cast("date")).cast("int"))


def rank_top(df: DataFrame, score: Column | str, n: int | None = None, out: str = "rank",
             ascending: bool = False, partition: Sequence[str] = ()) -> DataFrame:
    """Ranking by score (WIN23), optional top ``n``.  Without ``partition`` this is a
    global ranking: use it on aggregated rows (one per station), not on raw data."""
    s = F.col(score) if isinstance(score, str) else score
    o = s.asc() if ascending else s.desc()
    if n and not partition:
        # global top-n: per-partition top n, then one merge of n rows (TakeOrdered)
        top = df.orderBy(o).limit(n)
        return top.withColumn(out, F.row_number().over(Window.orderBy(o)))
    d = df.withColumn(out, F.row_number().over(Window.partitionBy(*partition).orderBy(o)))
    return d.filter(F.col(out) <= n) if n else d


def hash_draws(frame: SeriesFrame, seed: int = 42) -> Column:
    """Standard normal draws (Box-Muller from two hashes of series, order and seed), independent of partitioning."""
    keys, o = [F.col(k) for k in frame.keys], F.col(frame.order).cast("string")
    uniform = lambda s: F.pmod(F.xxhash64(*keys, o, F.lit(s)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.sqrt(-2 * F.log(1 - uniform(seed))) * F.cos(2 * F.pi() * uniform(seed + 1))


def mean_reverting_noise(forecast: DataFrame, draws: Column, sigma: Column, frame: SeriesFrame = STATION_DATE,
                         phi: float = 0.9, out: str = "noise") -> DataFrame:
    """Noise of forecast rows (WIN21): ``v_1 = 0``, ``v_i = phi * v_{i-1} + sigma * draw_i`` per series.

    Rows are cut into runs of ``STEP`` rows.  Within a run the recursion is a
    running sum scaled by powers of ``phi`` that stay small; the run's last value
    is carried to the following runs with ``phi^STEP`` per run, so no series is
    too long.  Carries from so many runs back that their weight is below the
    precision of a double are left out.
    """
    step = 64
    d = scan(forecast.withColumn("_an_e", F.when(F.lit(True), draws * sigma)), frame, row_index="_an_i")
    d = d.withColumn("_an_e", F.when(F.col("_an_i") == 1, F.lit(0.0)).otherwise(F.coalesce(F.col("_an_e"), F.lit(0.0))))
    d = d.withColumns({"_an_c": F.floor((F.col("_an_i") - 1) / step), "_an_p": (F.col("_an_i") - 1) % step})
    keys = list(frame.keys)
    run = Window.partitionBy(*keys, "_an_c").orderBy("_an_i").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_an_v", F.pow(F.lit(phi), F.col("_an_p")) * F.sum(F.col("_an_e") * F.pow(F.lit(phi), -F.col("_an_p"))).over(run))
    ends = d.where(F.col("_an_p") == step - 1).select(*keys, "_an_c", "_an_v")
    depth = 2 + int(40 / (-step * math.log10(phi)))
    # each run's end reaches the next `depth` runs
    carry = ends.select(*keys, "_an_v", "_an_c", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("_an_k")).groupBy(
        *keys, (F.col("_an_c") + F.col("_an_k")).alias("_an_c")).agg(
        F.sum(F.col("_an_v") * F.pow(F.lit(phi), (F.col("_an_k") - 1) * step)).alias("_an_in"))
    d = d.join(carry, [*keys, "_an_c"], "left")
    v = F.col("_an_v") + F.coalesce(F.col("_an_in"), F.lit(0.0)) * F.pow(F.lit(phi), F.col("_an_p") + 1)
    return d.withColumn(out, v).drop("_an_e", "_an_i", "_an_c", "_an_p", "_an_v", "_an_in")


def noisy_forecast(forecast: DataFrame, value: str, history_volatility: DataFrame, draws: Column,
                   frame: SeriesFrame = STATION_DATE, share: float = 0.3, out: str | None = None) -> DataFrame:
    """``value`` of every forecast row: its series' first prediction plus mean-reverting noise, at least 0 (WIN21).

    ``history_volatility`` is one row with ``sigma``, the mean of the stations' standard deviations.
    """
    one = history_volatility.select((F.col("sigma") * F.lit(share)).alias("_nf_s"))
    x = forecast.join(F.broadcast(one), how="cross")  # a single row by construction
    x = mean_reverting_noise(x, draws, F.col("_nf_s"), frame, out="_nf_v")
    first = forecast.groupBy(*frame.keys).agg(F.min_by(value, frame.order).alias("_nf_b"))
    x = x.join(first, list(frame.keys))
    return x.withColumn(out or value, F.greatest(F.col("_nf_b") + F.col("_nf_v"), F.lit(0.0))).drop("_nf_s", "_nf_v", "_nf_b")
