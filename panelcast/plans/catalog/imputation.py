"""Imputation, capping and bounds queries (IMP1-IMP11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import densify as dz
from ...operators import impute as im
from ...operators import windows
from ...sources import tables as tb
from . import register
from . import as_double as R

AIR = tb.with_views("panel_air")
W = "PARTITION BY station ORDER BY date"


@register("imp1_ratio_imputation", AIR + f"""
, v AS (SELECT station, pm_sepuluh / pm_duakomalima AS r FROM panel_air
        WHERE pm_sepuluh IS NOT NULL AND pm_duakomalima IS NOT NULL AND pm_duakomalima > 0),
per AS (SELECT station, quantile_cont(r, 0.5) AS m FROM v GROUP BY 1),
ov AS (SELECT quantile_cont(r, 0.5) AS m FROM v),
ratio AS (SELECT s.station, coalesce(per.m, ov.m) AS ratio FROM (SELECT DISTINCT station FROM panel_air) s
          LEFT JOIN per ON s.station = per.station, ov)
SELECT a.station, a.date, {R('''CASE WHEN a.pm_duakomalima IS NULL AND a.pm_sepuluh IS NOT NULL
                           THEN a.pm_sepuluh / nullif(r.ratio, 0) ELSE a.pm_duakomalima END''')} AS pm_duakomalima
FROM panel_air a LEFT JOIN ratio r ON a.station = r.station""")
def imp1_ratio_imputation(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh", "pm_duakomalima")
    return im.ratio_impute(a, "pm_duakomalima", "pm_sepuluh").select("station", "date", "pm_duakomalima")


_IMP2_COLS = ("pm_duakomalima", "karbon_monoksida")


@register("imp2_station_then_global_median", AIR + """
, a AS (SELECT station, date, pm_duakomalima,
               CASE WHEN station <> 'DKI3' THEN karbon_monoksida END AS karbon_monoksida FROM panel_air),
sm AS (SELECT station, quantile_cont(pm_duakomalima, 0.5) AS m1, quantile_cont(karbon_monoksida, 0.5) AS m2
       FROM a GROUP BY 1),
f AS (SELECT a.station, a.date, coalesce(a.pm_duakomalima, sm.m1) AS pm_duakomalima,
             coalesce(a.karbon_monoksida, sm.m2) AS karbon_monoksida FROM a JOIN sm ON a.station = sm.station),
gm AS (SELECT quantile_cont(pm_duakomalima, 0.5) AS g1, quantile_cont(karbon_monoksida, 0.5) AS g2 FROM f)
SELECT station, date, """ + R("coalesce(pm_duakomalima, g1)") + " AS pm_duakomalima, " + R(
    "coalesce(karbon_monoksida, g2)") + " AS karbon_monoksida FROM f, gm")
def imp2_station_then_global_median(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_duakomalima", "karbon_monoksida")
    a = a.withColumn("karbon_monoksida", F.when(F.col("station") != "DKI3", F.col("karbon_monoksida")))
    return im.fill_station_then_global(a, list(_IMP2_COLS))


@register("imp3_train_median_fill", AIR + """
, a AS (SELECT station, date, pm_duakomalima, karbon_monoksida,
               CASE WHEN date > DATE '1999-12-31' THEN ozon END AS ozon_late FROM panel_air),
med AS (SELECT quantile_cont(pm_duakomalima, 0.5) AS m1, quantile_cont(karbon_monoksida, 0.5) AS m2,
               quantile_cont(ozon_late, 0.5) AS m3 FROM a WHERE date <= DATE '1999-12-31')
SELECT station, date, """ + ", ".join([
    R("coalesce(pm_duakomalima, m1, 0)") + " AS pm_duakomalima",
    R("coalesce(karbon_monoksida, m2, 0)") + " AS karbon_monoksida",
    R("coalesce(ozon_late, m3, 0)") + " AS ozon_late"]) + """
FROM a, med WHERE date > DATE '1999-12-31'""")
def imp3_train_median_fill(spark, d):
    a = tb.panel_air(spark, d).select(
        "station", "date", "pm_duakomalima", "karbon_monoksida",
        F.when(F.col("date") > F.lit("1999-12-31").cast("date"), F.col("ozon")).alias("ozon_late"))
    cols = ["pm_duakomalima", "karbon_monoksida", "ozon_late"]
    cut = F.lit("1999-12-31").cast("date")
    med = im.fit_medians(a.where(F.col("date") <= cut), cols)
    return im.apply_medians(a.where(F.col("date") > cut), med, cols, default=0.0)


@register("imp4_inf_to_median", AIR + """
, a AS (SELECT station, date, CASE WHEN n_lines % 4 = 0 THEN 'inf'::DOUBLE
                                   WHEN n_lines % 6 = 0 THEN '-inf'::DOUBLE ELSE ozon END AS ozon FROM panel_air),
b AS (SELECT station, date, CASE WHEN abs(ozon) = 'inf'::DOUBLE THEN NULL ELSE ozon END AS ozon FROM a)
SELECT station, date, """ + R("coalesce(ozon, (SELECT quantile_cont(ozon, 0.5) FROM b))") + " AS ozon FROM b")
def imp4_inf_to_median(spark, d):
    a = tb.panel_air(spark, d)
    n = F.col("n_lines")
    a = a.select("station", "date", F.when(n % 4 == 0, F.lit(float("inf"))).when(n % 6 == 0, F.lit(float("-inf")))
                 .otherwise(F.col("ozon")).alias("ozon"))
    return im.replace_inf(a, ["ozon"])


@register("imp4_inf_to_cap", AIR + f"""
SELECT station, date, {R("CASE WHEN n_lines % 4 = 0 THEN 1e10 WHEN n_lines % 6 = 0 THEN -1e10 ELSE ozon END")} AS ozon
FROM panel_air""")
def imp4_inf_to_cap(spark, d):
    a = tb.panel_air(spark, d)
    n = F.col("n_lines")
    a = a.select("station", "date", F.when(n % 4 == 0, F.lit(float("inf"))).when(n % 6 == 0, F.lit(float("-inf")))
                 .otherwise(F.col("ozon")).alias("ozon"))
    return im.replace_inf(a, ["ozon"], cap=1e10)


def _clip_sql(src: str, lim: str, c: str) -> str:
    return f"CASE WHEN {src}.{c} < {lim}.lo_{c} THEN {lim}.lo_{c} WHEN {src}.{c} > {lim}.hi_{c} THEN {lim}.hi_{c} ELSE {src}.{c} END"


_WC = ("ozon", "karbon_monoksida")


def _lim_sql(name: str, src: str) -> str:
    return f"{name} AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.001) AS lo_{c}, quantile_cont({c}, 0.999) AS hi_{c}" for c in _WC) + f" FROM {src})"


@register("imp5_winsorise_train_forecast", AIR + """
, tr AS (SELECT station, date, ozon, karbon_monoksida FROM panel_air WHERE date <= DATE '1999-12-31'),
fc AS (SELECT station, date, ozon, karbon_monoksida FROM panel_air WHERE date > DATE '1999-12-31'),
""" + _lim_sql("l1", "tr") + """,
tc AS (SELECT tr.station, tr.date, """ + ", ".join(f"{_clip_sql('tr', 'l1', c)} AS {c}" for c in _WC) + """ FROM tr, l1),
""" + _lim_sql("l2", "tc") + """
SELECT 'train' AS part, station, date, """ + ", ".join(f"{R(c)} AS {c}" for c in _WC) + """ FROM tc
UNION ALL
SELECT 'forecast', fc.station, fc.date, """ + ", ".join(f"{R(_clip_sql('fc', 'l2', c))}" for c in _WC) + " FROM fc, l2")
def imp5_winsorise_train_forecast(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", *_WC)
    cut = F.lit("1999-12-31").cast("date")
    t, f = im.winsorise(a.where(F.col("date") <= cut), a.where(F.col("date") > cut), list(_WC))
    return t.select(F.lit("train").alias("part"), "*").unionByName(f.select(F.lit("forecast").alias("part"), "*"))


_CAPS = {"pm_sepuluh": 120.0, "karbon_monoksida": 4500.0}


@register("imp6_cap_upper", AIR + "SELECT station, date, " + ", ".join(
    f"{R(f'CASE WHEN {c} > {cap} THEN {cap} ELSE {c} END')} AS {c}" for c, cap in _CAPS.items()) + " FROM panel_air")
def imp6_cap_upper(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", *_CAPS)
    return im.cap_upper(a, _CAPS)


@register("imp6_cap_report", AIR + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} > {cap}) AS BIGINT) AS n_capped, {R(f'max({c})')} AS original_max, "
    f"{cap} ::DOUBLE AS cap FROM panel_air" for c, cap in _CAPS.items()))
def imp6_cap_report(spark, d):
    return im.cap_report(tb.panel_air(spark, d), _CAPS)


_BACK_SQL = """fit AS (SELECT * FROM panel_orders WHERE date >= DATE '1997-01-01'),
season AS (SELECT station, month(date) AS m, avg(price_avg) AS s FROM fit GROUP BY 1, 2),
med AS (SELECT station, quantile_cont(price_avg, 0.5) AS md FROM fit GROUP BY 1),
sk AS (SELECT s.station, CAST(unnest(generate_series(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS date
       FROM (SELECT DISTINCT station FROM panel_orders) s),
back AS (SELECT k.station, k.date, coalesce(s.s, m.md) AS price_avg FROM sk k
         LEFT JOIN season s ON k.station = s.station AND month(k.date) = s.m LEFT JOIN med m ON k.station = m.station)"""


def _backcast(spark, d):
    p = tb.panel_orders(spark, d).select("station", "date", "price_avg")
    fit = p.where(F.col("date") >= F.lit("1997-01-01").cast("date"))
    sk = dz.date_skeleton(p.select("station"), "1995-01-01", "1996-12-31")
    return p, fit, im.backcast_seasonal(sk, fit, ["price_avg"])


@register("imp7_backcast_seasonal", tb.with_views("panel_orders", extra=_BACK_SQL) + f"""
SELECT station, date, {R('price_avg')} AS price_avg FROM back""")
def imp7_backcast_seasonal(spark, d):
    return _backcast(spark, d)[2]


@register("imp8_gap_year_interpolation", tb.with_views("panel_orders") + f"""
, obs AS (SELECT station, date, price_avg FROM panel_orders WHERE year(date) <> 1998),
gap AS (SELECT s.station, CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS date,
               CAST(NULL AS DOUBLE) AS price_avg FROM (SELECT DISTINCT station FROM panel_orders) s),
u AS (SELECT * FROM obs UNION ALL SELECT * FROM gap),
nb AS (SELECT station, date, price_avg,
    last_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    last_value(CASE WHEN price_avg IS NOT NULL THEN date END IGNORE NULLS)
      OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
    first_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
    first_value(CASE WHEN price_avg IS NOT NULL THEN date END IGNORE NULLS)
      OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM u)
SELECT station, date, {R('''CASE WHEN price_avg IS NOT NULL THEN price_avg
    WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * date_diff('day', pt, date) / date_diff('day', pt, nt)
    ELSE coalesce(pv, nv) END''')} AS price_avg FROM nb""")
def imp8_gap_year_interpolation(spark, d):
    p = tb.panel_orders(spark, d).select("station", "date", "price_avg")
    obs = p.where(F.year("date") != 1998)
    gap = dz.date_skeleton(p.select("station"), "1998-01-01", "1998-12-31")
    return im.gap_interpolate(obs, gap, ["price_avg"])


_FC_SQL = """last AS (SELECT station, date AS d1, pm_sepuluh AS v FROM panel_air
                 QUALIFY row_number() OVER (PARTITION BY station ORDER BY date DESC) = 1),
fc AS (SELECT station, CAST(unnest(generate_series(d1 + 1, d1 + 60, INTERVAL 1 DAY)) AS DATE) AS date,
              v AS v0, CASE WHEN station IN ('DKI1', 'DKI2') THEN 0.04 ELSE 0.002 END AS g FROM last),
fc2 AS (SELECT station, date, v0 * (1 + g * date_diff('day', (SELECT max(date) FROM panel_air), date)) AS pm_sepuluh FROM fc),
q AS (SELECT station, min(pm_sepuluh) AS mn, max(pm_sepuluh) AS mx, quantile_cont(pm_sepuluh, 0.25) AS q1,
             quantile_cont(pm_sepuluh, 0.5) AS q2, quantile_cont(pm_sepuluh, 0.75) AS q3 FROM panel_air GROUP BY 1),
b AS (SELECT station, greatest(mn * 0.8, q2 - 3 * (q3 - q1)) AS lo, least(mx * 1.2, q2 + 3 * (q3 - q1)) AS hi FROM q),
sh AS (SELECT f.station, avg(CAST(f.pm_sepuluh < b.lo OR f.pm_sepuluh > b.hi AS DOUBLE)) AS share
       FROM fc2 f JOIN b ON f.station = b.station GROUP BY 1),
season AS (SELECT station, month(date) AS m, avg(pm_sepuluh) AS s FROM panel_air GROUP BY 1, 2),
med AS (SELECT station, quantile_cont(pm_sepuluh, 0.5) AS md FROM panel_air GROUP BY 1)"""


def _naive_forecast(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh")
    last = windows.latest_row(a)
    _, d1 = dz.date_bounds(a)
    fut = last.select("station", F.col("pm_sepuluh").alias("v0"),
                      F.explode(F.sequence(F.date_add("date", 1), F.date_add("date", 60))).alias("date"))
    g = F.when(F.col("station").isin("DKI1", "DKI2"), 0.04).otherwise(0.002)
    fut = fut.select("station", "date", (F.col("v0") * (F.lit(1) + g * F.datediff("date", F.lit(d1)))).alias("pm_sepuluh"))
    return a, fut


@register("imp9_forecast_bounds", tb.with_views("panel_air", extra=_FC_SQL) + f"""
SELECT f.station, f.date,
  {R('''CASE WHEN sh.share > 0.3 THEN coalesce(s.s, m.md)
            WHEN f.pm_sepuluh < b.lo THEN b.lo WHEN f.pm_sepuluh > b.hi THEN b.hi ELSE f.pm_sepuluh END''')} AS pm_sepuluh,
  CAST(sh.share > 0.3 AS INTEGER) AS used_seasonal
FROM fc2 f JOIN b ON f.station = b.station JOIN sh ON f.station = sh.station
LEFT JOIN season s ON f.station = s.station AND month(f.date) = s.m LEFT JOIN med m ON f.station = m.station""")
def imp9_forecast_bounds(spark, d):
    a, fut = _naive_forecast(spark, d)
    return im.bounded_forecast(fut, a, "pm_sepuluh")


@register("imp10_fill_constant", AIR + f"""
SELECT station, date, coalesce(kategori, 'no_holiday') AS kategori, {R('coalesce(karbon_monoksida, 0)')} AS karbon_monoksida
FROM panel_air""")
def imp10_fill_constant(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "kategori", "karbon_monoksida")
    return im.fill_constant(a, {"kategori": "no_holiday", "karbon_monoksida": 0.0})


@register("imp11_stitch_provenance", tb.with_views("panel_orders", extra=_BACK_SQL) + """
, obs AS (SELECT station, date FROM panel_orders WHERE date >= DATE '1997-01-01' AND date <= DATE '2000-12-31'),
fc AS (SELECT station, date FROM panel_orders WHERE date > DATE '2000-12-31'),
u AS (SELECT date, 'backcast' AS source FROM back UNION ALL SELECT date, 'observed' FROM obs
      UNION ALL SELECT date, 'forecast' FROM fc)
SELECT CAST(year(date) AS INTEGER) AS year, source, count(*) AS rows FROM u GROUP BY 1, 2""")
def imp11_stitch_provenance(spark, d):
    p, fit, back = _backcast(spark, d)
    obs = p.where((F.col("date") >= F.lit("1997-01-01").cast("date")) & (F.col("date") <= F.lit("2000-12-31").cast("date")))
    fc = p.where(F.col("date") > F.lit("2000-12-31").cast("date"))
    _, prov = im.stitch({"backcast": back, "observed": obs, "forecast": fc})
    return prov
