"""Aggregation, pivot and profiling queries (AGG1-AGG32, AGG34, FLT5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import encode as enc
from ...functions import rules as rl
from ...operators import aggregates as ag
from ...operators import densify as dz
from ...operators import profile as pf
from ...operators import windows
from ...operators.quantiles import quantiles
from ...sources import tables as tb
from . import register
from . import as_double as R

POLL = list(rl.POLLUTANTS)
PARAMS = ("click", "view", "purchase", "signup", "error")
EV = tb.with_views("obs_events")
AIR = tb.with_views("panel_air")


def _wide_events(spark, d):
    """One row per event with the value under its parameter's column."""
    e = tb.obs_events(spark, d)
    return e.select("event_id", "station", "date", "parameter",
                    *[F.when(F.col("parameter") == p, F.col("value")).alias(p) for p in PARAMS])


_WIDE_SQL = "wide AS (SELECT event_id, station, date, parameter, " + ", ".join(
    f"CASE WHEN parameter = '{p}' THEN value END AS {p}" for p in PARAMS) + " FROM obs_events)"


@register("agg1_collapse_duplicates", EV + """
SELECT station, date, """ + R("avg(value)") + """ AS value,
       arg_min(parameter, event_id) FILTER (WHERE parameter IS NOT NULL) AS parameter
FROM obs_events GROUP BY 1, 2""")
def agg1_collapse_duplicates(spark, d):
    e = tb.obs_events(spark, d)
    return ag.collapse_duplicates(e, ["station", "date"], ["value"], ["parameter"], ordinal="event_id")


@register("agg2_group_mean", EV + f"""
SELECT station, parameter, {R('avg(value)')} AS value FROM obs_events GROUP BY 1, 2""")
def agg2_group_mean(spark, d):
    return ag.group_mean(tb.obs_events(spark, d), ["station", "parameter"], ["value"])


@register("agg3_median_and_mean", tb.with_views("obs_events", extra=_WIDE_SQL) + "SELECT station, date, " + ", ".join(
    f"{R(f'quantile_cont({p}, 0.5)')} AS {p}" for p in PARAMS if p != "purchase")
    + f", {R('avg(purchase)')} AS purchase FROM wide GROUP BY 1, 2")
def agg3_median_and_mean(spark, d):
    w = _wide_events(spark, d)
    return ag.median_mean(w, ["station", "date"], [p for p in PARAMS if p != "purchase"], ["purchase"])


@register("agg4_mean_and_median", tb.with_views("panel_orders") + f"""
SELECT station, {R('avg(price_avg)')} AS price_avg_mean, {R('avg(n_orders)')} AS n_orders_mean,
       {R('quantile_cont(price_avg, 0.5)')} AS price_avg_median, {R('quantile_cont(n_orders, 0.5)')} AS n_orders_median
FROM panel_orders GROUP BY 1""")
def agg4_mean_and_median(spark, d):
    return ag.mean_and_median(tb.panel_orders(spark, d), ["station"], ["price_avg", "n_orders"])


@register("agg5_group_sum", EV + f"""
SELECT station, parameter, {R('sum(value)')} AS value FROM obs_events GROUP BY 1, 2""")
def agg5_group_sum(spark, d):
    return ag.group_sum(tb.obs_events(spark, d), ["station", "parameter"], ["value"])


@register("agg6_pivot", EV + "SELECT station, date, " + ", ".join(
    f"{R(f'avg(CASE WHEN parameter = {chr(39) + p + chr(39)} THEN value END)')} AS {p}" for p in PARAMS)
    + " FROM obs_events GROUP BY 1, 2")
def agg6_pivot(spark, d):
    return ag.pivot(tb.obs_events(spark, d), ["station", "date"], "parameter", PARAMS, "value")


@register("agg7_unpivot", AIR + " UNION ALL ".join(
    f"SELECT station, date, '{p}' AS parameter, {R(p)} AS value FROM panel_air" for p in POLL))
def agg7_unpivot(spark, d):
    a = tb.panel_air(spark, d)
    return ag.unpivot(a.select("station", "date", *POLL), ["station", "date"], POLL)


_CATS3 = ("BAIK", "SEDANG", "TIDAK SEHAT")


@register("agg8_crosstab_margins", AIR + """
, ct AS (SELECT station, """ + ", ".join(
    f"CAST(count_if(kategori = '{c}') AS BIGINT) AS \"{c}\"" for c in _CATS3) + """
  , CAST(count_if(kategori NOT IN ('BAIK', 'SEDANG', 'TIDAK SEHAT')) AS BIGINT) AS "Other", count(kategori) AS "All"
         FROM panel_air WHERE kategori IS NOT NULL GROUP BY station)
SELECT * FROM ct
UNION ALL
SELECT 'All', CAST(sum("BAIK") AS BIGINT), CAST(sum("SEDANG") AS BIGINT), CAST(sum("TIDAK SEHAT") AS BIGINT),
       CAST(sum("Other") AS BIGINT), CAST(sum("All") AS BIGINT) FROM ct""")
def agg8_crosstab_margins(spark, d):
    return ag.crosstab(tb.panel_air(spark, d), "station", "kategori", _CATS3)


@register("agg8_counts_by_station_month", AIR + """
, ct AS (SELECT station, CAST(month(date) AS INTEGER) AS month, """ + ", ".join(
    f"CAST(count_if(kategori = '{c}') AS BIGINT) AS \"{c}\"" for c in _CATS3) + """
  , CAST(count_if(kategori NOT IN ('BAIK', 'SEDANG', 'TIDAK SEHAT')) AS BIGINT) AS "Other", count(kategori) AS "All"
         FROM panel_air WHERE kategori IS NOT NULL GROUP BY 1, 2)
SELECT * FROM ct
UNION ALL
SELECT NULL, month, CAST(sum("BAIK") AS BIGINT), CAST(sum("SEDANG") AS BIGINT), CAST(sum("TIDAK SEHAT") AS BIGINT),
       CAST(sum("Other") AS BIGINT), CAST(sum("All") AS BIGINT) FROM ct GROUP BY month""")
def agg8_counts_by_station_month(spark, d):
    a = tb.panel_air(spark, d).withColumn("month", F.month("date"))
    return ag.stacked_counts(a, "station", "month", "kategori", _CATS3)


@register("agg9_value_counts_share", AIR + f"""
SELECT kategori, count(*) AS count, {R('count(*) / sum(count(*)) OVER ()')} AS share
FROM panel_air GROUP BY kategori""")
def agg9_value_counts_share(spark, d):
    return ag.value_counts(tb.panel_air(spark, d), ["kategori"])


@register("agg10_distinct_counts", AIR + """
SELECT count(DISTINCT station) AS station, count(DISTINCT date) AS date, count(DISTINCT kategori) AS kategori
FROM panel_air""")
def agg10_distinct_counts(spark, d):
    return ag.distinct_counts(tb.panel_air(spark, d), ["station", "date", "kategori"])


_AIR_COLS = ["station", "date", *POLL, "kategori", "n_lines"]


@register("agg11_null_report", AIR + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count, "
    f"{R(f'count_if({c} IS NULL) * 100.0 / count(*)')} AS null_pct FROM panel_air" for c in _AIR_COLS))
def agg11_null_report(spark, d):
    return ag.null_report(tb.panel_air(spark, d), _AIR_COLS)


@register("agg11_null_report_top", tb.with_views("panel_air", extra="nr AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS null_count, "
    f"count_if({c} IS NULL) * 100.0 / count(*) AS null_pct FROM panel_air" for c in _AIR_COLS) + ")") + f"""
SELECT "column", null_count, {R('null_pct')} AS null_pct FROM nr WHERE null_pct > 5
ORDER BY null_pct DESC, "column" LIMIT 20""")
def agg11_null_report_top(spark, d):
    return ag.null_report(tb.panel_air(spark, d), _AIR_COLS, min_pct=5, top=20)


@register("agg12_null_pct_by_year", AIR + "SELECT CAST(year(date) AS INTEGER) AS year, " + ", ".join(
    f"round(avg(CAST({c} IS NULL AS DOUBLE)) * 100, 1) AS {c}" for c in ("pm_duakomalima", "karbon_monoksida", "kategori"))
    + " FROM panel_air GROUP BY 1")
def agg12_null_pct_by_year(spark, d):
    a = tb.panel_air(spark, d).withColumn("year", F.year("date"))
    return ag.null_pct_by(a, ["year"], ["pm_duakomalima", "karbon_monoksida", "kategori"])


@register("agg13_sampling_regime", EV + f"""
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT date) AS n_dates,
       count(DISTINCT station) AS n_stations, {R('count(*) / count(DISTINCT date)')} AS rows_per_date
FROM (SELECT station, CAST(date + INTERVAL (event_id % 900) DAY AS DATE) AS date FROM obs_events) t GROUP BY 1""")
def agg13_sampling_regime(spark, d):
    e = tb.obs_events(spark, d)
    e = e.select("station", F.date_add("date", (F.col("event_id") % 900).cast("int")).alias("date"))
    return ag.sampling_regime(e)


@register("agg13_stations_per_date_regime", tb.with_views("panel_orders") + f"""
SELECT CAST(date >= DATE '1998-01-01' AS INTEGER) AS since_1998, {R('median(n)')} AS median_stations_per_date
FROM (SELECT date, count(DISTINCT station) AS n FROM panel_orders GROUP BY 1) t GROUP BY 1""")
def agg13_stations_per_date_regime(spark, d):
    p = tb.panel_orders(spark, d)
    per = p.groupBy("date").agg(F.count_distinct("station").alias("n")) \
           .withColumn("since_1998", (F.col("date") >= F.lit("1998-01-01").cast("date")).cast("int"))
    return quantiles(per, ["n"], [0.5], by=["since_1998"], name="median_stations_per_date")


@register("agg14_duplicate_keys", EV + """
SELECT e.event_id, e.station, e.date, e.parameter FROM obs_events e
SEMI JOIN (SELECT station, date, parameter FROM obs_events GROUP BY 1, 2, 3 HAVING count(*) > 1) k
  ON e.station = k.station AND e.date = k.date AND e.parameter = k.parameter""")
def agg14_duplicate_keys(spark, d):
    e = tb.obs_events(spark, d).select("event_id", "station", "date", "parameter")
    return ag.duplicate_keys(e, ["station", "date", "parameter"])


@register("agg15_panel_completeness", tb.with_views("panel_orders") + """
SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT station) AS n_stations,
       CAST(date_diff('day', min(date), max(date)) + 1 AS INTEGER) AS n_days,
       CAST((date_diff('day', min(date), max(date)) + 1) * count(DISTINCT station) AS BIGINT) AS expected_rows,
       count(*) AS actual_rows
FROM panel_orders""")
def agg15_panel_completeness(spark, d):
    return ag.panel_completeness(tb.panel_orders(spark, d))


_QS = (0.001, 0.25, 0.5, 0.75, 0.9, 0.999)


@register("agg16_exact_quantiles", "SELECT " + ", ".join(
    f"{R(f'quantile_cont(l_extendedprice, {q})')} AS \"l_extendedprice_q{q}\"" for q in _QS)
    + ", " + ", ".join(f"{R(f'quantile_cont(l_quantity, {q})')} AS \"l_quantity_q{q}\"" for q in _QS)
    + " FROM lineitem")
def agg16_exact_quantiles(spark, d):
    li = tb.table(spark, d, "lineitem")
    return quantiles(li, ["l_extendedprice", "l_quantity"], list(_QS))


@register("agg16_quantiles_by_station", AIR + "SELECT station, " + ", ".join(
    f"{R(f'quantile_cont({p}, {q})')} AS \"{p}_q{q}\"" for p in ("pm_sepuluh", "karbon_monoksida") for q in (0.25, 0.5, 0.9))
    + " FROM panel_air GROUP BY 1")
def agg16_quantiles_by_station(spark, d):
    return quantiles(tb.panel_air(spark, d), ["pm_sepuluh", "karbon_monoksida"], [0.25, 0.5, 0.9], by=["station"])


@register("agg17_series_statistics", AIR + f"""
, l AS ({" UNION ALL ".join(f"SELECT station, '{p}' AS parameter, {p} AS value FROM panel_air" for p in POLL)})
SELECT station, parameter, {R('min(value)')} AS min, {R('max(value)')} AS max, {R('avg(value)')} AS mean,
       {R('stddev_samp(value)')} AS std, count(*) AS n, {R('quantile_cont(value, 0.5)')} AS median,
       {R('quantile_cont(value, 0.25)')} AS q1, {R('quantile_cont(value, 0.75)')} AS q3,
       {R('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} AS iqr
FROM l WHERE value IS NOT NULL GROUP BY 1, 2""")
def agg17_series_statistics(spark, d):
    return ag.series_stats(tb.panel_air(spark, d), ["station"], POLL)


_FEATS = ["ozon", "karbon_monoksida", "sulfur_dioksida", "nitrogen_dioksida", "n_lines", "const_one"]
_TARGETS = ["pm_sepuluh", "pm_duakomalima"]


def _corr_sql(x: str, y: str, min_pairs: int) -> str:
    xm, ym = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return (f"CASE WHEN count({xm}) > {min_pairs} THEN covar_pop({xm}, {ym}) / "
            f"nullif(stddev_pop({xm}) * stddev_pop({ym}), 0) END")


_AIRC = tb.with_views("panel_air", extra="ac AS (SELECT *, CAST(n_lines AS DOUBLE) AS n_lines_d, 1.0 AS const_one "
                      "FROM panel_air)")


def _air_feats(spark, d):
    return tb.panel_air(spark, d).withColumn("const_one", F.lit(1.0))


@register("agg18_corr_matrix", _AIRC + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, " + ", ".join(f"{R(_corr_sql(f, t, 30))} AS {t}" for t in _TARGETS) + " FROM ac"
    for f in _FEATS))
def agg18_corr_matrix(spark, d):
    return pf.corr_matrix(_air_feats(spark, d), _FEATS, _TARGETS, min_pairs=30)


@register("agg19_avg_abs_corr_ranking", _AIRC + ", cm AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, " + ", ".join(f"abs({_corr_sql(f, t, 30)}) AS {t}" for t in _TARGETS) + " FROM ac"
    for f in _FEATS) + f""")
SELECT feature, {R('(coalesce(pm_sepuluh, 0) + coalesce(pm_duakomalima, 0)) / nullif((pm_sepuluh IS NOT NULL)::INT + (pm_duakomalima IS NOT NULL)::INT, 0)')}
  AS avg_abs_correlation FROM cm""")
def agg19_avg_abs_corr_ranking(spark, d):
    cm = pf.corr_matrix(_air_feats(spark, d), _FEATS, _TARGETS, min_pairs=30)
    return pf.mean_abs_corr(cm, _TARGETS)


@register("agg20_feature_selection", _AIRC + ", cm AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, " + ", ".join(f"abs({_corr_sql(f, t, 0)}) AS {t}" for t in _TARGETS) + " FROM ac"
    for f in _FEATS) + f""")
SELECT feature, {R('greatest(coalesce(pm_sepuluh, 0), coalesce(pm_duakomalima, 0))')} AS max_abs_correlation,
       greatest(coalesce(pm_sepuluh, 0), coalesce(pm_duakomalima, 0)) >= 0.1 AS keep FROM cm""")
def agg20_feature_selection(spark, d):
    cm = pf.corr_matrix(_air_feats(spark, d), _FEATS, _TARGETS, min_pairs=0)
    return pf.select_features(cm, _TARGETS, 0.1)


@register("agg21_top_correlations", _AIRC + ", cm AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {_corr_sql(f, 'pm_sepuluh', 0)} AS correlation FROM ac"
    for f in _FEATS + ["pm_duakomalima"]) + f""")
SELECT feature, {R('correlation')} AS correlation FROM cm WHERE correlation IS NOT NULL
ORDER BY abs(correlation) DESC, feature LIMIT 15""")
def agg21_top_correlations(spark, d):
    return pf.top_correlations(_air_feats(spark, d), "pm_sepuluh", _FEATS + ["pm_duakomalima"])


@register("agg22_variance_ranking", AIR + "SELECT feature, " + R("variance") + " AS variance FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM panel_air" for c in POLL)
    + ") t ORDER BY variance DESC NULLS LAST, feature LIMIT 20")
def agg22_variance_ranking(spark, d):
    return ag.variance_ranking(tb.panel_air(spark, d), POLL)


@register("agg23_inf_counts", AIR + """
SELECT CAST(count_if(abs(pm_duakomalima / nullif(ozon - 100, 0)) = 'inf'::DOUBLE) AS BIGINT) AS ratio,
       CAST(count_if(abs(pm_sepuluh) = 'inf'::DOUBLE) AS BIGINT) AS pm_sepuluh FROM panel_air""")
def agg23_inf_counts(spark, d):
    a = tb.panel_air(spark, d).select(F.try_divide("pm_duakomalima", F.col("ozon") - 100).alias("ratio"), "pm_sepuluh")
    return ag.inf_counts(a, ["ratio", "pm_sepuluh"]).select(*[F.col(c).cast("long") for c in ["ratio", "pm_sepuluh"]])


# Severity of the categories, best to worst.
_SCORES = {"BAIK": 1.0, "SEDANG": 2.0, "TIDAK SEHAT": 3.0, "SANGAT TIDAK SEHAT": 4.0, "BERBAHAYA": 5.0}
_SCORE_SQL = "CASE kategori " + " ".join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in _SCORES.items()) + " END"


@register("agg24_station_summary", AIR + f"""
SELECT station, count(*) AS days, {R('avg(pm_sepuluh)')} AS pm_sepuluh_mean, {R('avg(ozon)')} AS ozon_mean,
       {R('max(pm_sepuluh)')} AS pm_sepuluh_max, {R('max(ozon)')} AS ozon_max,
       {R('sum(pm_sepuluh)')} AS pm_sepuluh_sum, {R('sum(ozon)')} AS ozon_sum,
       {R("avg(CAST(kategori IN ('TIDAK SEHAT', 'SANGAT TIDAK SEHAT', 'BERBAHAYA') AS DOUBLE))")} AS unhealthy_share,
       """ + ", ".join(f"avg(CAST(kategori = '{c}' AS DOUBLE)) AS \"{c}_share\"" for c in _SCORES) + f""",
       avg({_SCORE_SQL}) AS mean_score,
       CAST(row_number() OVER (ORDER BY avg({_SCORE_SQL}) NULLS LAST, station) AS INTEGER) AS rank
FROM panel_air GROUP BY station""")
def agg24_station_summary(spark, d):
    a = tb.panel_air(spark, d)
    return ag.station_summary(a, ["pm_sepuluh", "ozon"], "kategori", F.col("kategori").isin(*enc.UNHEALTHY), _SCORES)


_LAGS = (1, 3, 5, 7, 14, 30)


@register("agg25_autocorrelation", AIR + ", l AS (SELECT pm_sepuluh AS x, " + ", ".join(
    f"lag(pm_sepuluh, {k}) OVER (PARTITION BY station ORDER BY date) AS l{k}" for k in _LAGS) + " FROM panel_air) SELECT "
    + ", ".join(f"{R(_corr_sql('x', f'l{k}', 0))} AS acf_lag_{k}" for k in _LAGS) + " FROM l")
def agg25_autocorrelation(spark, d):
    return pf.autocorrelation(tb.panel_air(spark, d), "pm_sepuluh", _LAGS)


@register("agg26_volatility", AIR + f"""
SELECT {R('avg(s1)')} AS pm_sepuluh_volatility, {R('avg(s2)')} AS ozon_volatility
FROM (SELECT station, stddev_samp(pm_sepuluh) AS s1, stddev_samp(ozon) AS s2 FROM panel_air GROUP BY 1) t""")
def agg26_volatility(spark, d):
    return ag.volatility(tb.panel_air(spark, d), ["pm_sepuluh", "ozon"])


@register("agg27_seasonal_means", AIR + f"""
SELECT station, CAST(month(date) AS INTEGER) AS month, {R('avg(pm_sepuluh)')} AS pm_sepuluh, {R('avg(ozon)')} AS ozon
FROM panel_air GROUP BY 1, 2""")
def agg27_seasonal_means(spark, d):
    return ag.seasonal_means(tb.panel_air(spark, d), ["pm_sepuluh", "ozon"])


@register("agg28_station_ratio_median", AIR + f"""
, v AS (SELECT station, pm_duakomalima / pm_sepuluh AS r FROM panel_air
        WHERE pm_duakomalima IS NOT NULL AND pm_sepuluh IS NOT NULL AND pm_sepuluh > 0 AND station <> 'DKI3'),
per AS (SELECT station, quantile_cont(r, 0.5) AS m FROM v GROUP BY 1),
ov AS (SELECT quantile_cont(r, 0.5) AS m FROM v)
SELECT s.station, {R('coalesce(per.m, ov.m)')} AS ratio, CAST(per.m IS NULL AS INTEGER) AS used_fallback
FROM (SELECT DISTINCT station FROM panel_air) s LEFT JOIN per ON s.station = per.station, ov""")
def agg28_station_ratio_median(spark, d):
    a = tb.panel_air(spark, d)
    # one station has no valid pairs, to exercise the overall-median fallback
    a = a.withColumn("pm_duakomalima", F.when(F.col("station") != "DKI3", F.col("pm_duakomalima")))
    return ag.station_ratio_median(a, "pm_duakomalima", "pm_sepuluh")


@register("agg29_cross_station_mean", AIR + f"""
SELECT date, {R('avg(pm_sepuluh)')} AS pm_sepuluh, {R('avg(karbon_monoksida)')} AS karbon_monoksida
FROM panel_air GROUP BY 1""")
def agg29_cross_station_mean(spark, d):
    return ag.cross_station_mean(tb.panel_air(spark, d), ["pm_sepuluh", "karbon_monoksida"])


@register("agg30_parameter_availability", tb.with_views("panel_air") + """
, l AS (""" + " UNION ALL ".join(
    f"SELECT station, '{p}' AS parameter, {p} AS value FROM panel_air WHERE station <> 'DKI2' OR '{p}' <> 'ozon'"
    for p in POLL) + """)
SELECT parameter, count(DISTINCT station) AS n_sources,
       CAST(count(DISTINCT station) = (SELECT count(DISTINCT station) FROM panel_air) AS INTEGER) AS in_all, 1 AS in_any
FROM l WHERE value IS NOT NULL GROUP BY 1""")
def agg30_parameter_availability(spark, d):
    a = tb.panel_air(spark, d)
    a = a.withColumn("ozon", F.when(F.col("station") != "DKI2", F.col("ozon")))
    return ag.availability_sets(a, "station", POLL)


@register("agg31_date_range", tb.with_views("panel_orders") + """
SELECT station, min(date) AS min_date, max(date) AS max_date, count(*) AS rows,
       CAST(date_diff('day', min(date), max(date)) + 1 AS INTEGER) AS days
FROM panel_orders GROUP BY 1""")
def agg31_date_range(spark, d):
    return ag.date_range(tb.panel_orders(spark, d), by=["station"])


@register("agg32_forecast_range_check", AIR + f"""
, last AS (SELECT station, pm_sepuluh AS v FROM panel_air QUALIFY row_number() OVER (PARTITION BY station ORDER BY date DESC) = 1),
mean30 AS (SELECT station, avg(pm_sepuluh) AS v FROM (SELECT station, pm_sepuluh FROM panel_air
           QUALIFY row_number() OVER (PARTITION BY station ORDER BY date DESC) <= 30) t GROUP BY 1),
fc AS (SELECT 'persistence' AS method, v * 1.3 AS pm_sepuluh FROM last UNION ALL SELECT 'mean30', v FROM mean30),
h AS (SELECT min(pm_sepuluh) AS lo, max(pm_sepuluh) AS hi FROM panel_air),
st AS (SELECT method, 'pm_sepuluh' AS parameter, avg(pm_sepuluh) AS mean, stddev_samp(pm_sepuluh) AS std,
              min(pm_sepuluh) AS min, max(pm_sepuluh) AS max FROM fc GROUP BY 1)
SELECT method, parameter, {R('mean')} AS mean, {R('std')} AS std, {R('min')} AS min, {R('max')} AS max,
       {R('max - min')} AS range, {R('lo')} AS hist_min, {R('hi')} AS hist_max,
       CASE WHEN min >= lo * 0.8 AND max <= hi * 1.2 THEN 'OK' ELSE 'OUT_OF_RANGE' END AS status
FROM st, h""")
def agg32_forecast_range_check(spark, d):
    from ...operators import windows
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh")
    last = windows.latest_row(a).select(F.lit("persistence").alias("method"),
                                        (F.col("pm_sepuluh") * 1.3).alias("pm_sepuluh"))
    m30 = windows.last_rows(a, 30).groupBy("station").agg(F.avg("pm_sepuluh").alias("pm_sepuluh")) \
        .select(F.lit("mean30").alias("method"), "pm_sepuluh")
    return ag.range_check(a, last.unionByName(m30), ["pm_sepuluh"])


@register("agg34_daily_change_stats", AIR + f"""
, l AS (SELECT pm_sepuluh - lag(pm_sepuluh, 1) OVER (PARTITION BY station ORDER BY date) AS x FROM panel_air)
SELECT {R('avg(x)')} AS pm_sepuluh_diff_mean, {R('stddev_samp(x)')} AS pm_sepuluh_diff_std,
       {R('avg(CASE WHEN x IS NOT NULL THEN CAST(x > 0 AS DOUBLE) END)')} AS pm_sepuluh_share_up FROM l""")
def agg34_daily_change_stats(spark, d):
    return ag.daily_change_stats(tb.panel_air(spark, d), ["pm_sepuluh"])


@register("agg15_densified_completeness", tb.with_views("panel_orders") + """
SELECT count(*) AS actual_rows FROM (SELECT DISTINCT station FROM panel_orders) s,
  (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM panel_orders) g""")
def agg15_densified_completeness(spark, d):
    """After densifying, actual rows equal days x stations (the reference's invariant)."""
    return dz.densify_panel(tb.panel_orders(spark, d)).agg(F.count(F.lit(1)).alias("actual_rows"))


@register("flt5_minimum_support", EV + """
SELECT station, parameter, count(value) AS n_values FROM obs_events GROUP BY 1, 2 HAVING count(value) >= 30""")
def flt5_minimum_support(spark, d):
    """Keep groups with enough observations (``having count >= n``)."""
    e = tb.obs_events(spark, d)
    return e.groupBy("station", "parameter").agg(F.count("value").alias("n_values")) \
            .where(F.col("n_values") >= 30)


# Each pollutant's values of the 30 days before, against every pollutant: 180 features x 6 targets.
_WIDE_LAGS = range(1, 31)
_WIDE = [f"{p}_lag_{k}d" for p in rl.POLLUTANTS for k in _WIDE_LAGS]


@register("agg18_full_width", tb.with_views("panel_air") + ", w AS (SELECT " + ", ".join(rl.POLLUTANTS) + ", " + ", ".join(
    f"lag({p}, {k}) OVER (PARTITION BY station ORDER BY date) AS {p}_lag_{k}d" for p in rl.POLLUTANTS for k in _WIDE_LAGS)
    + " FROM panel_air), l AS (SELECT * FROM w UNPIVOT (x FOR feature IN (" + ", ".join(_WIDE) + ")))\nSELECT feature, " + ", ".join(
    f"{R(f'CASE WHEN regr_count(x, {t}) > 30 THEN corr(x, {t}) END')} AS {t}" for t in rl.POLLUTANTS) + " FROM l GROUP BY feature")
def agg18_full_width(spark, d):
    from ...operators import widecorr
    a = tb.panel_air(spark, d).select("station", "date", *rl.POLLUTANTS)
    return widecorr.corr_matrix_wide(windows.lags(a, list(rl.POLLUTANTS), list(_WIDE_LAGS)), _WIDE, list(rl.POLLUTANTS))
