"""Per-station lag, change, rolling, spell and split features on the pollutant panel
(WIN1-WIN7, WIN11, WIN15, WIN17-WIN19, WIN21-WIN23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import maths as mt
from ...functions import rules as rl
from ...operators import dayframes, fills, windows
from ...operators.aggregates import attach_params
from ...operators.frames import SeriesFrame, add_index
from ...sources import tables as tb
from . import register
from . import as_double as R

W = "PARTITION BY station ORDER BY date"
AIR = tb.with_views("panel_air")


def _rows(n: int) -> str:
    return f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


@register("win1_lags", AIR + "SELECT station, date, " + ", ".join(
    f"{R(f'lag({c}, {k}) OVER ({W})')} AS {c}_lag_{k}d" for c in ("pm_sepuluh", "ozon") for k in (7, 14, 30))
    + " FROM panel_air")
def win1_lags(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh", "ozon")
    return windows.lags(a, ["pm_sepuluh", "ozon"], [7, 14, 30]).drop("pm_sepuluh", "ozon")


@register("win2_deltas", AIR + "SELECT station, date, " + ", ".join(
    f"{R(f'{c} - lag({c}, {k}) OVER ({W})')} AS {c}_delta_{k}d" for c in ("pm_sepuluh", "karbon_monoksida")
    for k in (1, 7, 30)) + " FROM panel_air")
def win2_deltas(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh", "karbon_monoksida")
    return windows.deltas(a, ["pm_sepuluh", "karbon_monoksida"], [1, 7, 30]).drop("pm_sepuluh", "karbon_monoksida")


@register("win3_pct_change_padded", AIR + f"""
, ff AS (SELECT station, date,
           last_value(pm_duakomalima IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x
         FROM panel_air)
SELECT station, date, {R(f'x / nullif(lag(x, 7) OVER ({W}), 0) - 1')} AS pm_duakomalima_pct_change_7d,
       {R(f'x / nullif(lag(x, 1) OVER ({W}), 0) - 1')} AS pm_duakomalima_pct_change_1d
FROM ff""")
def win3_pct_change_padded(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_duakomalima")
    return windows.pct_changes(a, ["pm_duakomalima"], [7, 1]).drop("pm_duakomalima")


@register("win4_stabilised_pct_change", AIR + "SELECT station, date, " + ", ".join(
    f"{R(f'(ozon - lag(ozon, {k}) OVER ({W})) / (lag(ozon, {k}) OVER ({W}) + 1e-8) * 100')} AS ozon_pct_change_{k}"
    for k in (1, 7)) + " FROM panel_air")
def win4_stabilised_pct_change(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "ozon")
    return windows.stabilised_pct_change(a, ["ozon"], [1, 7]).drop("ozon")


@register("win5_ratio_growth", tb.with_views("yearly") + f"""
SELECT station, year, n_orders,
       {R('n_orders / nullif(lag(n_orders, 1) OVER (PARTITION BY station ORDER BY year), 0) - 1')} AS growth_1y
FROM yearly""")
def win5_ratio_growth(spark, d):
    y = tb.yearly(spark, d).select("station", "year", "n_orders")
    return windows.ratio_growth(y, "n_orders", 1, "growth_1y", SeriesFrame(("station",), "year"))


_ROLL_COLS = ("pm_sepuluh", "karbon_monoksida")


@register("win6_rolling_mean", AIR + "SELECT station, date, " + ", ".join(
    f"{R(f'avg({c}) OVER ({W} {_rows(n)})')} AS {c}_rollmean_{n}d" for c in _ROLL_COLS for n in (7, 14, 30))
    + " FROM panel_air")
def win6_rolling_mean(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", *_ROLL_COLS)
    return windows.rolling(a, list(_ROLL_COLS), [7, 14, 30], ["mean"], name="{col}_rollmean_{n}d") \
        .drop(*_ROLL_COLS)


@register("win7_rolling_std", AIR + "SELECT station, date, " + ", ".join(
    f"{R(f'CASE WHEN count({c}) OVER ({W} {_rows(30)}) >= 7 THEN stddev_samp({c}) OVER ({W} {_rows(30)}) END')}"
    f" AS {c}_rollstd_30d" for c in _ROLL_COLS) + ", " + ", ".join(
    f"{R(f'stddev_samp({c}) OVER ({W} {_rows(7)})')} AS {c}_rollstd_7d" for c in _ROLL_COLS) + " FROM panel_air")
def win7_rolling_std(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", *_ROLL_COLS)
    a, fr = add_index(a)                      # one row index shared by both rolling passes
    a = windows.rolling(a, list(_ROLL_COLS), [30], ["std"], fr, min_periods=7, name="{col}_rollstd_{n}d")
    return windows.rolling(a, list(_ROLL_COLS), [7], ["std"], fr, name="{col}_rollstd_{n}d") \
        .drop(*_ROLL_COLS, fr.index)


_RAIN_SQL = "CAST(coalesce(sulfur_dioksida - 50 > 0, false) AS INTEGER)"
_UNH_SQL = "CAST(coalesce(pm_sepuluh > 100, false) AS INTEGER)"


@register("win11_rolling_counts", AIR + f"""
, f AS (SELECT station, date, {_RAIN_SQL} AS is_rainy, {_UNH_SQL} AS is_unhealthy FROM panel_air)
SELECT station, date, is_rainy, """ + ", ".join(
    f"CAST(sum(is_rainy) OVER ({W} {_rows(n)}) AS BIGINT) AS rainy_days_{n}d" for n in (7, 14, 30)) + ", " + ", ".join(
    f"CAST(sum(is_unhealthy) OVER ({W} {_rows(n)}) AS BIGINT) AS unhealthy_days_{n}d" for n in (7, 30)) + " FROM f")
def win11_rolling_counts(spark, d):
    a = tb.panel_air(spark, d)
    a = a.select("station", "date", mt.rainy(F.col("sulfur_dioksida") - 50).alias("is_rainy"),
                 mt.above("pm_sepuluh", 100).alias("is_unhealthy"))
    a, fr = add_index(a)
    a = windows.rolling(a, ["is_rainy"], [7, 14, 30], ["sum"], fr, name="rainy_days_{n}d")
    a = windows.rolling(a, ["is_unhealthy"], [7, 30], ["sum"], fr, name="unhealthy_days_{n}d")
    return a.drop("is_unhealthy", fr.index).withColumns(
        {c: F.col(c).cast("long") for c in ["rainy_days_7d", "rainy_days_14d", "rainy_days_30d",
                                            "unhealthy_days_7d", "unhealthy_days_30d"]})


@register("win15_dry_wet_spells", AIR + f"""
, f AS (SELECT station, date, {_RAIN_SQL} AS is_rainy FROM panel_air),
g AS (SELECT *, sum(is_rainy) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g_wet,
             sum(1 - is_rainy) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g_dry FROM f)
SELECT station, date, is_rainy,
  CAST(sum(1 - is_rainy) OVER (PARTITION BY station, g_wet ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       AS INTEGER) AS dry_spell,
  CAST(sum(is_rainy) OVER (PARTITION BY station, g_dry ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       AS INTEGER) AS wet_spell
FROM g""")
def win15_dry_wet_spells(spark, d):
    a = tb.panel_air(spark, d)
    a = a.select("station", "date", mt.rainy(F.col("sulfur_dioksida") - 50).alias("is_rainy"))
    return fills.spells(a, "is_rainy")


@register("win17_deviation_from_mean", AIR + f"""
SELECT station, date, {R(f'ozon - avg(ozon) OVER ({W} {_rows(30)})')} AS ozon_dev_30d,
       {R(f'(ozon - avg(ozon) OVER ({W} {_rows(30)})) / nullif(avg(ozon) OVER ({W} {_rows(30)}), 0) * 100')}
         AS ozon_dev_pct_30d
FROM panel_air""")
def win17_deviation_from_mean(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "ozon")
    return windows.rolling_deviation(a, "ozon", 30).drop("ozon")


@register("win18_history_forecast_rolling", AIR + f"""
, last_day AS (SELECT station, max(date) AS d1 FROM panel_air GROUP BY 1),
hist AS (SELECT station, date, pm_sepuluh, 0 AS is_forecast FROM panel_air),
fut AS (SELECT l.station, CAST(unnest(generate_series(l.d1 + 1, l.d1 + 30, INTERVAL 1 DAY)) AS DATE) AS date,
               CAST(NULL AS DOUBLE) AS pm_sepuluh, 1 AS is_forecast FROM last_day l),
u AS (SELECT * FROM hist UNION ALL SELECT * FROM fut),
p AS (SELECT *, last_value(pm_sepuluh IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM u)
SELECT station, date, {R('v')} AS pm_sepuluh, {R(f'avg(v) OVER ({W} {_rows(7)})')} AS pm_sepuluh_rollmean_7d,
       {R(f'avg(v) OVER ({W} {_rows(30)})')} AS pm_sepuluh_rollmean_30d
FROM p QUALIFY is_forecast = 1""")
def win18_history_forecast_rolling(spark, d):
    """Rolling features of forecast days computed over history + forecast rows per
    station, then only forecast rows kept (the reference keeps the wrong slice)."""
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh")
    last = a.groupBy("station").agg(F.max("date").alias("d1"))
    fut = last.select("station", F.explode(F.sequence(F.date_add("d1", 1), F.date_add("d1", 30))).alias("date"))
    fut = fut.select("station", "date", F.lit(None).cast("double").alias("pm_sepuluh"), F.lit(1).alias("is_forecast"))
    u = a.withColumn("is_forecast", F.lit(0)).unionByName(fut)
    u = fills.ffill(u, "pm_sepuluh")
    u = windows.rolling(u, ["pm_sepuluh"], [7, 30], ["mean"], name="{col}_rollmean_{n}d")
    return u.where("is_forecast = 1").drop("is_forecast")


@register("win19_last_rows", AIR + f"""
SELECT station, date, {R('pm_sepuluh')} AS pm_sepuluh FROM panel_air
QUALIFY row_number() OVER (PARTITION BY station ORDER BY date DESC) <= 30""")
def win19_last_rows(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh")
    return windows.last_rows(a, 30)


@register("win19_latest_row", AIR + f"""
SELECT station, date, {R('ozon')} AS ozon FROM panel_air
QUALIFY row_number() OVER (PARTITION BY station ORDER BY date DESC) = 1""")
def win19_latest_row(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "ozon")
    return windows.latest_row(a)


@register("win21_mean_reverting_noise", AIR + f"""
, cut AS (SELECT CAST(max(date) - INTERVAL 91 DAY AS DATE) AS d FROM panel_air),
vol AS (SELECT avg(s) AS sigma FROM (SELECT station, stddev_samp(pm_sepuluh) AS s FROM panel_air, cut WHERE date <= d GROUP BY station)),
f AS (SELECT station, date, pm_sepuluh, row_number() OVER w AS i, first_value(pm_sepuluh) OVER w AS base,
  CASE WHEN row_number() OVER w = 1 THEN 0.0
       ELSE (CAST('0x' || substr(md5(station || CAST(date AS VARCHAR)), 1, 8) AS BIGINT) / 2147483648.0 - 1) * 0.3 * (SELECT sigma FROM vol) END AS e
  FROM panel_air, cut WHERE date > d WINDOW w AS (PARTITION BY station ORDER BY date))
SELECT a.station, a.date, {R('greatest(any_value(a.base) + sum(b.e * pow(0.9, a.i - b.i)), 0)')} AS pm_sepuluh_noisy
FROM f a JOIN f b ON a.station = b.station AND b.i <= a.i GROUP BY a.station, a.date""")
def win21_mean_reverting_noise(spark, d):
    """The last 91 days stand for the forecast rows; draws come from a digest, so that SQL can make the same."""
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh")
    cut = a.agg(F.date_sub(F.max("date"), 91).alias("_cut"))
    a = attach_params(a, cut)
    old = a.where(F.col("date") <= F.col("_cut"))
    sigma = old.groupBy("station").agg(F.stddev_samp("pm_sepuluh").alias("s")).agg(F.avg("s").alias("sigma"))
    digest = F.md5(F.concat("station", F.col("date").cast("string")).cast("binary"))
    draws = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2147483648.0 - 1
    new = a.where(F.col("date") > F.col("_cut")).drop("_cut")
    return windows.noisy_forecast(new, "pm_sepuluh", sigma, draws, out="pm_sepuluh_noisy").select("station", "date", "pm_sepuluh_noisy")


@register("win22_chronological_split", AIR + """
SELECT station, date, CAST(rn <= floor(n * 0.85) AS INTEGER) AS is_train
FROM (SELECT station, date, row_number() OVER (PARTITION BY station ORDER BY date) AS rn,
             count(*) OVER (PARTITION BY station) AS n FROM panel_air) t""")
def win22_chronological_split(spark, d):
    a = tb.panel_air(spark, d).select("station", "date")
    return windows.positional_split(a, 0.85)


@register("win23_station_ranking", AIR + f"""
SELECT station, {R('avg(pm_sepuluh)')} AS pm_sepuluh_mean,
       CAST(row_number() OVER (ORDER BY avg(pm_sepuluh) DESC) AS INTEGER) AS rank
FROM panel_air GROUP BY station QUALIFY rank <= 10""")
def win23_station_ranking(spark, d):
    a = tb.panel_air(spark, d)
    s = a.groupBy("station").agg(F.avg("pm_sepuluh").alias("pm_sepuluh_mean"))
    return windows.rank_top(s, "pm_sepuluh_mean", 10)


@register("rul_rule_category_rolling_unhealthy", AIR + f"""
, c AS (SELECT station, date, CAST(""" + " OR ".join(
    f"coalesce({p} > {t}, false)" for p, t in rl.UNHEALTHY_ABOVE.items()) + f""" AS INTEGER) AS u FROM panel_air)
SELECT station, date, u AS is_unhealthy, CAST(sum(u) OVER ({W} {_rows(7)}) AS BIGINT) AS unhealthy_days_7d FROM c""")
def rul_rule_category_rolling_unhealthy(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", rl.any_unhealthy().alias("is_unhealthy"))
    a = windows.rolling(a, ["is_unhealthy"], [7], ["sum"], name="unhealthy_days_{n}d")
    return a.withColumn("unhealthy_days_7d", F.col("unhealthy_days_7d").cast("long"))


# ---------------------------------------------------------------- frames of days (survey 2.7)

_DAYS = "PARTITION BY station ORDER BY date"
_PM = "price_max"


def _back(c: str, k: int) -> str:
    return f"max({c}) OVER ({_DAYS} RANGE BETWEEN INTERVAL {k} DAY PRECEDING AND INTERVAL {k} DAY PRECEDING)"


def _span(n: int) -> str:
    return f"({_DAYS} RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)"


@register("win1_win2_win5_days_back", tb.with_views("panel_orders") + "SELECT station, date, " + ", ".join(
    f"{R(_back(_PM, k))} AS price_max_lag_{k}days, {R(f'price_max - {_back(_PM, k)}')} AS price_max_delta_{k}days, "
    f"{R(f'price_max / nullif({_back(_PM, k)}, 0) - 1')} AS price_max_growth_{k}days" for k in (1, 7, 30, 365))
    + " FROM panel_orders")
def win1_win2_win5_days_back(spark, d):
    p = tb.panel_orders(spark, d).select("station", "date", "price_max")
    back = [1, 7, 30, 365]
    x = dayframes.lags_days(p, "price_max", back)
    x = dayframes.deltas_days(x, "price_max", back)
    return dayframes.growth_days(x, "price_max", back).drop("price_max")


@register("win6_win7_win11_days_rolling", tb.with_views("panel_orders") + "SELECT station, date, " + ", ".join(
    f"{R(f'avg(n_orders) OVER {_span(n)}')} AS n_orders_rollmean_{n}days, "
    f"CAST(sum(n_orders) OVER {_span(n)} AS BIGINT) AS n_orders_rollsum_{n}days, "
    f"CAST(count(n_orders) OVER {_span(n)} AS BIGINT) AS n_orders_rollcount_{n}days, "
    f"CASE WHEN count(n_orders) OVER {_span(n)} >= 5 THEN CAST(max(n_orders) OVER {_span(n)} AS BIGINT) END AS n_orders_rollmax_{n}days"
    for n in (7, 30, 365)) + " FROM panel_orders")
def win6_win7_win11_days_rolling(spark, d):
    p = tb.panel_orders(spark, d).select("station", "date", "n_orders")
    return dayframes.rolling_days(p, "n_orders", [7, 30, 365], ["mean", "sum", "count", "max"], min_periods={"max": 5}).drop("n_orders")


@register("win17_days_deviation", tb.with_views("panel_orders") + f"""
SELECT station, date, {R(f'n_orders - avg(n_orders) OVER {_span(30)}')} AS n_orders_dev_30days,
       {R(f'(n_orders - avg(n_orders) OVER {_span(30)}) / avg(n_orders) OVER {_span(30)} * 100')} AS n_orders_dev_pct_30days
FROM panel_orders""")
def win17_days_deviation(spark, d):
    p = tb.panel_orders(spark, d).select("station", "date", "n_orders")
    return dayframes.deviation_days(p, "n_orders", 30).drop("n_orders")
