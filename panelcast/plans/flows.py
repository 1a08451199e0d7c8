"""End-to-end flows: clean (Entry 1), features (Entry 2), forecast and classify (Entry 3).

Each flow is a chain of library operators returning a lazy DataFrame; nothing
is collected except fitted scalars inside operators (bounds, quantile bracket
sizes) and the fitted models themselves.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import encode as enc
from ..functions import maths as mt
from ..functions import predicates as pr
from ..functions import rules as rl
from ..operators import aggregates as ag
from ..operators import densify as dz
from ..operators import fills, windows
from ..operators import impute as im
from ..operators import joins as jn
from ..operators import modelling as ml
from ..operators import schema as sc
from ..operators.frames import SeriesFrame, add_index, checkpoint

POLL = list(rl.POLLUTANTS)


def clean_air_quality(raw: DataFrame, pollutants: Sequence[str] = POLL) -> DataFrame:
    """Entry 1 on canonical raw rows (station text already parsed to ``station``,
    ``date`` parsed, pollutants numeric, ``_ingest`` ordinal present).

    drop no-data label (FLT1) -> drop missing station / date (FLT2, DT1) ->
    forward fill per station in (date, ingest) order (WIN8) -> collapse
    duplicate keys: mean of pollutants, first of the rest (AGG1) -> ID (PRJ8)
    -> collapse categories (ENC4) -> final column order (PRJ5).  The fill runs
    before the collapse, as in the reference.
    """
    x = pr.drop_sentinel(raw, "kategori")
    x = pr.drop_null_keys(x, ["station", "date"])
    # same-day duplicates follow each other by their place in the file, however many there are
    x = fills.ffill(x, list(pollutants), SeriesFrame(("station",), "date", tie="_ingest", bucket=1))
    others = [c for c in x.columns if c not in (*pollutants, "station", "date", "_ingest")]
    x = ag.collapse_duplicates(x.withColumn("_o", F.col("_ingest")), ["station", "date"], list(pollutants),
                               others, ordinal="_o")
    x = sc.with_id(x)
    x = x.withColumn("kategori", enc.collapse_category("kategori"))
    return sc.order_columns(x, ["ID", "date", "station"], list(pollutants))


def air_quality_features(panel: DataFrame, pollutants: Sequence[str] = POLL,
                         frame: SeriesFrame | None = None) -> DataFrame:
    """Entry 2: lags, rolling statistics, changes, spikes, composites, calendar and
    cyclical parts, unhealthy-day counts and deviations, each family in one pass."""
    p = list(pollutants)
    x, fr = add_index(checkpoint(panel), frame or SeriesFrame())
    x = windows.lags(x, p, [7, 14, 30], fr)
    x = windows.rolling(x, p, [7, 14, 30], ["mean"], fr, name="{col}_rollmean_{n}d")
    x = windows.rolling(x, p, [30], ["std"], fr, min_periods=7, name="{col}_rollstd_{n}d")
    x = windows.deltas(x, p, [1, 7, 30], fr)
    x = windows.pct_changes(x, p, [7], fr)
    x = ag.spike_flags(x, p, 0.9)
    x = x.withColumns({
        "pm_fine_ratio": mt.safe_ratio("pm_duakomalima", "pm_sepuluh"),
        "aqi_proxy": mt.aqi_weighted("pm_duakomalima", "pm_sepuluh", "ozon"),
        "pm_total": mt.pm_total("pm_duakomalima", "pm_sepuluh"),
        "gaseous_pollutant_index": mt.gas_index("sulfur_dioksida", "karbon_monoksida", "nitrogen_dioksida"),
        "is_unhealthy": enc.is_unhealthy_label("kategori"),
        **dt.calendar_parts("date"),
        "is_weekend": dt.is_weekend(),
    })
    s, c = dt.cyclical(F.col("day_of_week"), 7)
    ms, mc = dt.cyclical(F.col("month"), 12)
    x = x.withColumns({"day_of_week_sin": s, "day_of_week_cos": c, "month_sin": ms, "month_cos": mc})
    x = windows.rolling(x, ["is_unhealthy"], [7, 30], ["sum"], fr, name="unhealthy_days_{n}d").drop(fr.index)
    x = checkpoint(x)
    x = x.withColumns({f"{q}_deviation_from_30d_mean": F.col(q) - F.col(f"{q}_rollmean_30d") for q in p})
    return x.withColumns({f"{q}_deviation_pct": F.try_divide(F.col(q) - F.col(f"{q}_rollmean_30d"),
                                                             F.col(f"{q}_rollmean_30d")) * 100 for q in p})


def forecast_and_classify(panel: DataFrame, others: Sequence[DataFrame], calendar: DataFrame | None,
                          last_train_date, horizon_days: int, pollutants: Sequence[str] = POLL,
                          gbt_params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Entry 3: join panels (JN1, JN2), pick numeric features (PRJ6), fill / clip with
    training statistics (IMP2-IMP5), fit one regressor per pollutant (ML1, ML8),
    forecast the horizon from last-known features (ML9, JN9), clip at 0 (MTH9),
    classify by rules (RUL1, RUL2, ENC4) and emit the submission (SNK2).

    Returns (forecast panel with categories, submission).
    """
    x = jn.join_panels(panel, others)
    if calendar is not None:
        x = jn.join_by_date(x, calendar)
    x = checkpoint(x)
    cut = F.lit(last_train_date).cast("date")
    train = x.where(F.col("date") <= cut)
    feats = sc.feature_columns(train, meta=["station", "date"], targets=list(pollutants),
                               patterns=[r"^kategori", r"^ID$"])
    train = im.fill_station_then_global(train, feats)
    lim = im.fit_clip_limits(train, feats)
    train = checkpoint(im.apply_clip(train, lim, feats))
    lim = checkpoint(lim)
    models = ml.fit_regressors(train, feats, list(pollutants), **(gbt_params or {}))
    d0 = last_train_date if isinstance(last_train_date, _dt.date) else _dt.date.fromisoformat(str(last_train_date))
    fut = dz.date_skeleton(panel.select("station"), d0 + _dt.timedelta(days=1), d0 + _dt.timedelta(days=horizon_days))
    fut = jn.last_known_row(train, fut, feats)
    fut = checkpoint(im.apply_clip(fut, lim, feats))
    out = fut.select("station", "date")
    for t, m in models.items():
        pred = m.transform(fut).select("station", "date", mt.clip_lower(F.col(f"{t}_pred")).alias(t))
        out = out.join(pred, ["station", "date"])
    cat = rl.rule_category({p: p for p in pollutants})
    out = out.withColumn("kategori", cat).withColumn("category", enc.collapse_category("kategori"))
    sub = out.select(F.concat_ws("_", F.date_format("date", "yyyy-MM-dd"), "station").alias("id"), "category")
    return out, sub
