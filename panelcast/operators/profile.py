"""Correlation profiling and feature selection (AGG18-AGG22, AGG25, FLT5).

Correlations are computed in one pass: features are unpivoted to
``(feature, x)`` next to the target columns and grouped by feature, with each
target's Pearson r as ``covar_pop / (stddev_pop * stddev_pop)`` over complete
pairs only.  Constant columns give NULL (ANSI ``corr`` would raise), pairs
below the minimum support give NULL, and no +-inf can arise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import STATION_DATE, SeriesFrame, bounded


def pair_corr(x: Column, y: Column, min_pairs: int = 0) -> Column:
    """Pearson r over rows where both are non-NULL; NULL when constant or < min_pairs pairs."""
    xm = F.when(y.isNotNull(), x)
    ym = F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_pop(xm, ym), F.stddev_pop(xm) * F.stddev_pop(ym))
    if min_pairs:
        r = F.when(F.count(xm) > min_pairs, r)
    return r


def corr_matrix(df: DataFrame, features: Sequence[str], targets: Sequence[str],
                min_pairs: int = 30) -> DataFrame:
    """One row per feature, one column per target (AGG18, with FLT5 support)."""
    long = df.select(*[F.col(t).cast("double").alias(t) for t in targets],
                     *[F.col(f).cast("double").alias(f"_f_{i}") for i, f in enumerate(features)])
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_f_{i}").alias("x"))
                                for i, f in enumerate(features)]))
    long = long.select(*targets, stack.alias("_s")).select(
        F.col("_s.feature").alias("feature"), F.col("_s.x").alias("x"), *targets)
    return long.groupBy("feature").agg(*[pair_corr(F.col("x"), F.col(t), min_pairs).alias(t) for t in targets])


def mean_abs_corr(cm: DataFrame, targets: Sequence[str], out: str = "avg_abs_correlation") -> DataFrame:
    """Average absolute correlation over targets (NULLs skipped), highest first (AGG19)."""
    vals = F.array(*[F.abs(F.col(t)) for t in targets])
    present = F.filter(vals, lambda v: v.isNotNull())
    avg = F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, v: a + v), F.size(present))
    return cm.select("feature", avg.alias(out)).orderBy(F.col(out).desc_nulls_last(), "feature")


def select_features(cm: DataFrame, targets: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """``feature, max_abs_correlation, keep`` (AGG20): max |r| over targets, NULL as 0."""
    mx = F.greatest(*[F.coalesce(F.abs(F.col(t)), F.lit(0.0)) for t in targets]) if len(targets) > 1 \
        else F.coalesce(F.abs(F.col(targets[0])), F.lit(0.0))
    return cm.select("feature", mx.alias("max_abs_correlation"),
                     (mx >= threshold).alias("keep"))


def top_correlations(df: DataFrame, target: str, features: Sequence[str], top: int = 15,
                     min_pairs: int = 0) -> DataFrame:
    """One column against all others, strongest |r| first (AGG21)."""
    cm = corr_matrix(df, [f for f in features if f != target], [target], min_pairs)
    return (cm.select("feature", F.col(target).alias("correlation"))
              .where(F.col("correlation").isNotNull())
              .orderBy(F.abs("correlation").desc(), "feature").limit(top))


def autocorrelation(df: DataFrame, col: str, lags: Sequence[int], frame: SeriesFrame = STATION_DATE) -> DataFrame:
    """corr(x, lag(x, k)) pooled over series, one column per lag (AGG25)."""
    d = bounded(df.select(*frame.keys, frame.order, col), frame,
                lambda w: {f"_l{k}": F.lag(col, k).over(w) for k in lags}, before=max(lags))
    return d.agg(*[pair_corr(F.col(col), F.col(f"_l{k}")).alias(f"acf_lag_{k}") for k in lags])
