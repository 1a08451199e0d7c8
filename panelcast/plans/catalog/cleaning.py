"""Stateless cleaning, calendar, arithmetic, encoding, rule and filter queries
(STR1-6, DT1-7, MTH1-9, ENC1-4, RUL1-3, FLT1-4, FLT6-7, AGG33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import dates as dt
from ...functions import encode as enc
from ...functions import maths as mt
from ...functions import predicates as pr
from ...functions import rules as rl
from ...functions import text as tx
from ...operators import aggregates as ag
from ...sources import tables as tb
from . import register
from . import as_double as R

def _sql_number(expr: str) -> str:
    t = f"trim({expr})"
    return (f"CASE WHEN {t} NOT IN ('---', '-', '') AND regexp_matches({t}, '{tx.NUMBER_RE}') "
            f"THEN TRY_CAST({t} AS DOUBLE) END")


def _sql_title(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({expr}), ' '), "
            f"lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')")


# ---------------------------------------------------------------- text (STR)

@register("str1_station_code", tb.with_views("dirty_orders") + r"""
SELECT k, nullif(regexp_extract(station_txt, 'DKI\d', 0), '') AS station,
       coalesce(upper(nullif(regexp_extract(station_txt, '(?i)DKI\d+', 0), '')), station_txt) AS station_loose
FROM dirty_orders""")
def str1_station_code(spark, d):
    x = tb.dirty_orders(spark, d)
    return x.select("k", tx.station_code("station_txt").alias("station"),
                    tx.station_code_or_keep("station_txt").alias("station_loose"))


@register("str2_sentinel_to_number", tb.with_views("dirty_orders") + f"""
SELECT k, price_txt, {R(_sql_number('price_txt'))} AS price FROM dirty_orders""")
def str2_sentinel_to_number(spark, d):
    x = tb.dirty_orders(spark, d)
    return x.select("k", "price_txt", tx.to_number("price_txt").alias("price"))


@register("str3_european_number", tb.with_views("dirty_orders") + f"""
SELECT k, {R(_sql_number("replace(replace(price_eu, '.', ''), ',', '.')"))} AS price FROM dirty_orders""")
def str3_european_number(spark, d):
    x = tb.dirty_orders(spark, d)
    return x.select("k", tx.european_number("price_eu").alias("price"))


_CENSOR = r"regexp_replace(price_censored, '^[<>≤≥\s]+|[<>=≤≥\s]+$', '', 'g')"


@register("str4_censored_value", tb.with_views("dirty_orders") + f"""
SELECT k, {_CENSOR} AS stripped,
       {R(_sql_number(f"replace(replace({_CENSOR}, '.', ''), ',', '.')"))} AS price
FROM dirty_orders""")
def str4_censored_value(spark, d):
    x = tb.dirty_orders(spark, d)
    return x.select("k", tx.strip_censoring("price_censored").alias("stripped"),
                    tx.censored_number("price_censored").alias("price"))


@register("str5_title_prefix_suffix", f"""
SELECT c.c_custkey,
       {_sql_title('lower(n.n_name)')} AS city,
       CASE WHEN starts_with('Kota Administrasi ' || n.n_name, 'Kota Administrasi ')
            THEN substr('Kota Administrasi ' || n.n_name, 19) END AS stripped,
       regexp_replace(lower(n.n_name) || '_days_since_update', '_days_since_update$', '') AS base_name,
       upper(c.c_mktsegment) AS segment
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def str5_title_prefix_suffix(spark, d):
    c = tb.table(spark, d, "customer")
    n = tb.table(spark, d, "nation")
    x = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return x.select(
        "c_custkey", tx.title_case(F.lower("n_name")).alias("city"),
        tx.strip_prefix(F.concat(F.lit("Kota Administrasi "), F.col("n_name")), "Kota Administrasi ").alias("stripped"),
        tx.strip_suffix(F.concat(F.lower("n_name"), F.lit("_days_since_update")), "_days_since_update").alias("base_name"),
        F.upper("c_mktsegment").alias("segment"))


@register("str6_zero_pad_substring", tb.with_views("dirty_orders") + """
SELECT k, lpad(CAST(month(order_date) AS VARCHAR), 2, '0') AS mm,
       substr(date_txt, 1, 4) AS head4, substr(CAST(k AS VARCHAR), 2, 3) AS mid3
FROM dirty_orders""")
def str6_zero_pad_substring(spark, d):
    x = tb.dirty_orders(spark, d)
    return x.select("k", tx.zero_pad(F.month("order_date"), 2).alias("mm"),
                    tx.slice_text("date_txt", 1, 4).alias("head4"),
                    tx.slice_text(F.col("k"), 2, 3).alias("mid3"))


# ---------------------------------------------------------------- dates (DT)

@register("dt1_parse_first_layout", tb.with_views("dirty_orders") + """
SELECT k, CAST(try_strptime(date_txt, '%Y-%m-%d') AS DATE) AS date FROM dirty_orders""")
def dt1_parse_first_layout(spark, d):
    x = tb.dirty_orders(spark, d)
    return x.select("k", dt.parse_date("date_txt").alias("date"))


@register("dt2_parse_mixed_layouts", tb.with_views("dirty_orders") + """
SELECT k, CAST(coalesce(try_strptime(date_txt, '%Y-%m-%d'), try_strptime(date_txt, '%d/%m/%Y')) AS DATE) AS date
FROM dirty_orders""")
def dt2_parse_mixed_layouts(spark, d):
    x = tb.dirty_orders(spark, d)
    return x.select("k", dt.parse_date_any("date_txt", ("yyyy-MM-dd", "dd/MM/yyyy")).alias("date"))


@register("dt3_excel_serial", tb.with_views("dirty_orders") + f"""
SELECT k, CASE WHEN contains(date_txt, '-') THEN CAST(try_strptime(date_txt, '%Y-%m-%d') AS DATE)
               WHEN ({_sql_number('date_txt')}) > 40000
               THEN CAST(DATE '1899-12-30' + CAST(floor({_sql_number('date_txt')}) AS INTEGER) AS DATE)
          END AS date
FROM dirty_orders""")
def dt3_excel_serial(spark, d):
    x = tb.dirty_orders(spark, d)
    return x.select("k", dt.date_or_serial("date_txt").alias("date"))


@register("dt4_date_from_parts", tb.with_views("dirty_orders") + """
SELECT k,
  CAST(try_strptime(CAST(p // 100 AS VARCHAR) || '-' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') || '-15', '%Y-%m-%d') AS DATE)
    AS period_date,
  CAST(try_strptime(CAST(y AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-'
       || lpad(CAST(dd + 2 AS VARCHAR), 2, '0'), '%Y-%m-%d') AS DATE) AS shifted_day,
  CAST(try_strptime(CAST(y AS VARCHAR) || '-' || CASE WHEN m <= 6 THEN '03' ELSE '09' END || '-15', '%Y-%m-%d') AS DATE)
    AS semester_date
FROM (SELECT k, CAST(year(order_date) * 100 + month(order_date) AS INTEGER) AS p,
             year(order_date) AS y, month(order_date) AS m, day(order_date) AS dd FROM dirty_orders) t""")
def dt4_date_from_parts(spark, d):
    x = tb.dirty_orders(spark, d)
    od = F.col("order_date")
    p = (F.year(od) * 100 + F.month(od)).cast("int")
    sem = F.when(F.month(od) <= 6, 1).otherwise(2)
    return x.select("k", dt.period_to_date(p, 15).alias("period_date"),
                    dt.date_from_parts(F.year(od), F.month(od), F.dayofmonth(od) + 2).alias("shifted_day"),
                    dt.semester_to_date(F.year(od), sem).alias("semester_date"))


@register("dt5_calendar_parts", tb.with_views("panel_orders") + """
SELECT station, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CAST(quarter(date) AS INTEGER) AS quarter, CAST(day(date) AS INTEGER) AS day_of_month,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
       CAST(weekofyear(date) AS INTEGER) AS week_of_year
FROM panel_orders""")
def dt5_calendar_parts(spark, d):
    p = tb.panel_orders(spark, d)
    return p.select("station", "date", *[v.alias(k) for k, v in dt.calendar_parts("date").items()])


@register("dt6_weekend_season_trend", tb.with_views("panel_orders") + """
SELECT station, date, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
       CAST(month(date) IN (11, 12, 1, 2, 3) AS INTEGER) AS is_wet_season,
       CAST(year(date) - 2015 AS INTEGER) AS yearly_trend
FROM panel_orders""")
def dt6_weekend_season_trend(spark, d):
    p = tb.panel_orders(spark, d)
    return p.select("station", "date", dt.is_weekend().alias("is_weekend"),
                    dt.is_wet_season().alias("is_wet_season"), dt.years_since().alias("yearly_trend"))


@register("dt7_cyclical", tb.with_views("panel_orders") + f"""
SELECT station, date,
  {R('sin(2 * pi() * (isodow(date) - 1) / 7.0)')} AS dow_sin, {R('cos(2 * pi() * (isodow(date) - 1) / 7.0)')} AS dow_cos,
  {R('sin(2 * pi() * month(date) / 12.0)')} AS month_sin, {R('cos(2 * pi() * month(date) / 12.0)')} AS month_cos,
  {R('sin(2 * pi() * dayofyear(date) / 365.25)')} AS doy_sin, {R('cos(2 * pi() * dayofyear(date) / 365.25)')} AS doy_cos
FROM panel_orders""")
def dt7_cyclical(spark, d):
    p = tb.panel_orders(spark, d)
    ds, dc = dt.cyclical(F.weekday("date"), 7)
    ms, mc = dt.cyclical(F.month("date"), 12)
    ys, yc = dt.cyclical(F.dayofyear("date"), 365.25)
    return p.select("station", "date", ds.alias("dow_sin"), dc.alias("dow_cos"), ms.alias("month_sin"),
                    mc.alias("month_cos"), ys.alias("doy_sin"), yc.alias("doy_cos"))


# ---------------------------------------------------------------- maths (MTH)

@register("mth1_log", tb.with_views("panel_air") + f"""
SELECT station, date, {R('CASE WHEN nitrogen_dioksida > 0 THEN ln(nitrogen_dioksida) END')} AS log_no2,
       {R('CASE WHEN ozon - 100 > 0 THEN ln(ozon - 100) END')} AS log_o3_excess
FROM panel_air""")
def mth1_log(spark, d):
    a = tb.panel_air(spark, d)
    return a.select("station", "date", mt.log_positive("nitrogen_dioksida").alias("log_no2"),
                    mt.log_positive(F.col("ozon") - 100).alias("log_o3_excess"))


@register("mth2_safe_ratio", tb.with_views("panel_air") + f"""
SELECT station, date, {R('pm_duakomalima / nullif(pm_sepuluh, 0)')} AS pm_fine_ratio,
       {R('pm_duakomalima / (pm_sepuluh + 1e-5)')} AS pm_fine_ratio_eps,
       {R('pm_sepuluh / nullif(ozon - 100, 0)')} AS ratio_zero_guarded
FROM panel_air""")
def mth2_safe_ratio(spark, d):
    a = tb.panel_air(spark, d)
    return a.select("station", "date", mt.safe_ratio("pm_duakomalima", "pm_sepuluh").alias("pm_fine_ratio"),
                    mt.ratio_eps("pm_duakomalima", "pm_sepuluh").alias("pm_fine_ratio_eps"),
                    mt.safe_ratio("pm_sepuluh", F.col("ozon") - 100).alias("ratio_zero_guarded"))


@register("mth3_mth4_indices", tb.with_views("panel_air") + f"""
SELECT station, date,
  {R('pm_duakomalima * 0.5 + pm_sepuluh * 0.3 + ozon * 0.2')} AS aqi_proxy,
  {R('(pm_duakomalima / 55.5 + pm_sepuluh / 150.0 + ozon / 235.0) / 3')} AS aqi_proxy_norm,
  {R('sulfur_dioksida + karbon_monoksida / 100.0 + nitrogen_dioksida')} AS gaseous_pollutant_index,
  {R('(sulfur_dioksida + nitrogen_dioksida) / 2')} AS gaseous_index_mean,
  {R('pm_duakomalima + pm_sepuluh')} AS pm_total
FROM panel_air""")
def mth3_mth4_indices(spark, d):
    a = tb.panel_air(spark, d)
    return a.select(
        "station", "date",
        mt.aqi_weighted("pm_duakomalima", "pm_sepuluh", "ozon").alias("aqi_proxy"),
        mt.aqi_normalised("pm_duakomalima", "pm_sepuluh", "ozon").alias("aqi_proxy_norm"),
        mt.gas_index("sulfur_dioksida", "karbon_monoksida", "nitrogen_dioksida").alias("gaseous_pollutant_index"),
        mt.gas_index_mean("sulfur_dioksida", "nitrogen_dioksida").alias("gaseous_index_mean"),
        mt.pm_total("pm_duakomalima", "pm_sepuluh").alias("pm_total"))


_POLL = list(rl.POLLUTANTS)


@register("mth5_spike_flags", tb.with_views("panel_air", extra="thr AS (SELECT "
          + ", ".join(f"quantile_cont({p}, 0.9) AS t_{p}" for p in _POLL) + " FROM panel_air)") + """
SELECT station, date, """ + ", ".join(
    f"CAST(coalesce({p} > t_{p}, false) AS INTEGER) AS {p}_spike" for p in _POLL) + ", CAST(" + " + ".join(
    f"CAST(coalesce({p} > t_{p}, false) AS INTEGER)" for p in _POLL) + """ AS INTEGER) AS elevated_pollutant_count
FROM panel_air, thr""")
def mth5_spike_flags(spark, d):
    a = tb.panel_air(spark, d)
    return ag.spike_flags(a, _POLL, q=0.9).select(
        "station", "date", *[f"{p}_spike" for p in _POLL], "elevated_pollutant_count")


@register("mth6_mth7_weather_derived", tb.with_views("panel_ship") + f"""
SELECT station, date,
  CAST(coalesce(disc_avg - 0.05 > 0, false) AS INTEGER) AS is_rainy,
  {R('qty_avg + 0.5 * (tax_avg * 1000) - 0.1 * (disc_avg * 100)')} AS heat_index,
  {R('qty_avg + 0.5 * (tax_avg * 1000)')} AS heat_index_simple,
  {R('qty_avg - 0.5 * (disc_avg * 100)')} AS feels_like_temp,
  {R('(qty_avg + 5) - (qty_avg - 5 * tax_avg * 100)')} AS temp_range,
  CAST(coalesce((qty_avg + 5) - (qty_avg - 5 * tax_avg * 100) > 8, false) AS INTEGER) AS temp_inversion_proxy,
  {R('qty_avg * (tax_avg * 1000) / 100')} AS temp_humidity_interaction,
  {R('(disc_avg - 0.05) * (disc_avg * 100)')} AS rain_wind_interaction
FROM panel_ship""")
def mth6_mth7_weather_derived(spark, d):
    s = tb.panel_ship(spark, d)
    temp, hum, wind = F.col("qty_avg"), F.col("tax_avg") * 1000, F.col("disc_avg") * 100
    rain = F.col("disc_avg") - 0.05
    tmax, tmin = temp + 5, temp - F.col("tax_avg") * 100 * 5
    return s.select(
        "station", "date", mt.rainy(rain).alias("is_rainy"),
        mt.heat_index(temp, hum, wind).alias("heat_index"), mt.heat_index(temp, hum).alias("heat_index_simple"),
        mt.feels_like(temp, wind).alias("feels_like_temp"), mt.diurnal_range(tmax, tmin).alias("temp_range"),
        mt.inversion_flag(tmax, tmin).alias("temp_inversion_proxy"),
        mt.interaction(temp, hum, 100).alias("temp_humidity_interaction"),
        mt.interaction(rain, wind).alias("rain_wind_interaction"))


_DEG_SQL = "CASE WHEN n_lines % 9 = 0 THEN NULL ELSE CAST((n_lines * 37 + 3 * ozon) % 400 AS DOUBLE) - 20 END"


@register("mth8_compass_bins", tb.with_views("panel_air") + f"""
SELECT station, date, deg, CASE
  WHEN deg IS NULL THEN NULL
  WHEN (CASE WHEN deg > 337.5 THEN deg - 360 ELSE deg END) < -22.5 THEN NULL
  WHEN (CASE WHEN deg > 337.5 THEN deg - 360 ELSE deg END) > 337.5 THEN NULL
  ELSE (['N','NE','E','SE','S','SW','W','NW'])[greatest(CAST(ceil(((CASE WHEN deg > 337.5 THEN deg - 360 ELSE deg END) - 22.5) / 45) AS INTEGER), 0) + 1]
  END AS wind_direction_cardinal
FROM (SELECT station, date, {_DEG_SQL} AS deg FROM panel_air) t""")
def mth8_compass_bins(spark, d):
    a = tb.panel_air(spark, d)
    n = F.col("n_lines")
    deg = F.when(n % 9 == 0, F.lit(None).cast("double")).otherwise(
        ((n * 37 + F.col("ozon") * 3) % 400).cast("double") - 20)
    x = a.select("station", "date", deg.alias("deg"))
    return x.select("station", "date", "deg", mt.compass_8("deg").alias("wind_direction_cardinal"))


@register("mth9_clip_non_negative", tb.with_views("panel_air") + f"""
SELECT station, date, {R('CASE WHEN ozon - 100 < 0 THEN 0 ELSE ozon - 100 END')} AS o3_excess,
       {R('CASE WHEN pm_duakomalima - 40 < 0 THEN 0 ELSE pm_duakomalima - 40 END')} AS pm25_excess
FROM panel_air""")
def mth9_clip_non_negative(spark, d):
    a = tb.panel_air(spark, d)
    return a.select("station", "date", mt.clip_lower(F.col("ozon") - 100).alias("o3_excess"),
                    mt.clip_lower(F.col("pm_duakomalima") - 40).alias("pm25_excess"))


# ---------------------------------------------------------------- encodings (ENC)

@register("enc1_ordinal_encodings", tb.with_views("panel_air") + """
SELECT station, date, kategori,
  CASE kategori WHEN 'BAIK' THEN 1 WHEN 'SEDANG' THEN 2 WHEN 'TIDAK SEHAT' THEN 3
       WHEN 'SANGAT TIDAK SEHAT' THEN 4 WHEN 'BERBAHAYA' THEN 5 END AS kategori_encoded,
  CASE kategori WHEN 'BAIK' THEN 0 WHEN 'SEDANG' THEN 1 WHEN 'TIDAK SEHAT' THEN 2
       WHEN 'SANGAT TIDAK SEHAT' THEN 3 WHEN 'BERBAHAYA' THEN 4 END AS kategori_score,
  CASE kategori WHEN 'BAIK' THEN 0 WHEN 'SEDANG' THEN 1 WHEN 'TIDAK SEHAT' THEN 2 END AS kategori_simple
FROM panel_air""")
def enc1_ordinal_encodings(spark, d):
    a = tb.panel_air(spark, d)
    return a.select("station", "date", "kategori",
                    enc.ordinal("kategori", enc.ORDINAL_1_5).alias("kategori_encoded"),
                    enc.ordinal("kategori", enc.ORDINAL_0_4).alias("kategori_score"),
                    enc.ordinal("kategori", enc.SIMPLE_0_2).alias("kategori_simple"))


@register("enc2_label_encode", tb.with_views("panel_orders") + """
SELECT p.station, p.date, CAST(c.code AS INTEGER) AS station_encoded
FROM panel_orders p JOIN (SELECT station, dense_rank() OVER (ORDER BY station) - 1 AS code
                          FROM (SELECT DISTINCT station FROM panel_orders) s) c ON p.station = c.station""")
def enc2_label_encode(spark, d):
    p = tb.panel_orders(spark, d).select("station", "date")
    return enc.label_encode(p, "station").select("station", "date", "station_encoded")


_STATIONS = ("DKI1", "DKI2", "DKI3", "DKI4", "DKI5")


@register("enc3_one_hot_station", tb.with_views("panel_orders") + """
SELECT station, date, """ + ", ".join(
    f"CAST(station = '{s}' AS INTEGER) AS stasiun_{s}" for s in _STATIONS) + " FROM panel_orders")
def enc3_one_hot_station(spark, d):
    p = tb.panel_orders(spark, d)
    return p.select("station", "date", *[v.alias(k) for k, v in enc.one_hot("station", _STATIONS, "stasiun").items()])


@register("enc4_collapse_category", tb.with_views("panel_air") + f"""
SELECT station, date, kategori_full,
  CASE WHEN kategori_full IN ('SANGAT TIDAK SEHAT', 'BERBAHAYA') THEN 'TIDAK SEHAT' ELSE kategori_full END AS kategori
FROM (SELECT station, date, CASE WHEN pm_sepuluh > 140 THEN 'BERBAHAYA' WHEN pm_sepuluh > 120 THEN 'SANGAT TIDAK SEHAT'
                                 ELSE kategori END AS kategori_full FROM panel_air) t""")
def enc4_collapse_category(spark, d):
    a = tb.panel_air(spark, d)
    full = F.when(F.col("pm_sepuluh") > 140, "BERBAHAYA").when(F.col("pm_sepuluh") > 120, "SANGAT TIDAK SEHAT") \
        .otherwise(F.col("kategori"))
    x = a.select("station", "date", full.alias("kategori_full"))
    return x.select("station", "date", "kategori_full", enc.collapse_category("kategori_full").alias("kategori"))


# ---------------------------------------------------------------- rules (RUL, AGG33)

def _band_sql(p: str, strict: bool) -> str:
    cats = ["BAIK", "SEDANG", "TIDAK SEHAT", "SANGAT TIDAK SEHAT", "BERBAHAYA"]
    parts = []
    for cat, (lo, hi) in zip(cats, rl.BANDS[p]):
        if strict:
            cond = f"{p} >= {lo}" if hi == rl.INF else f"{p} BETWEEN {lo} AND {hi}"
        else:
            cond = "true" if hi == rl.INF else f"{p} <= {hi}"
        parts.append(f"WHEN {cond} THEN '{cat}'")
    return f"CASE WHEN {p} IS NULL THEN NULL " + " ".join(parts) + " ELSE 'BERBAHAYA' END"


_ORD = "CASE {c} WHEN 'BAIK' THEN 1 WHEN 'SEDANG' THEN 2 WHEN 'TIDAK SEHAT' THEN 3 WHEN 'SANGAT TIDAK SEHAT' THEN 4 WHEN 'BERBAHAYA' THEN 5 END"


def _overall_sql(strict: bool) -> str:
    ords = ", ".join(_ORD.format(c=f"({_band_sql(p, strict)})") for p in _POLL)
    return ("CASE coalesce(greatest(" + ords + "), 1) WHEN 1 THEN 'BAIK' WHEN 2 THEN 'SEDANG' "
            "WHEN 3 THEN 'TIDAK SEHAT' WHEN 4 THEN 'SANGAT TIDAK SEHAT' WHEN 5 THEN 'BERBAHAYA' END")


@register("rul1_band_category", tb.with_views("panel_air") + "SELECT station, date, " + ", ".join(
    f"{_band_sql(p, True)} AS {p}_kategori" for p in _POLL) + ", " + ", ".join(
    f"{_band_sql(p, False)} AS {p}_kategori_cont" for p in _POLL) + " FROM panel_air")
def rul1_band_category(spark, d):
    a = tb.panel_air(spark, d)
    return a.select("station", "date", *[rl.band_category(p, p, True).alias(f"{p}_kategori") for p in _POLL],
                    *[rl.band_category(p, p, False).alias(f"{p}_kategori_cont") for p in _POLL])


@register("rul2_overall_category", tb.with_views("panel_air") + f"""
SELECT station, date, {_overall_sql(True)} AS kategori_rule,
       CASE WHEN {_overall_sql(True)} IN ('SANGAT TIDAK SEHAT', 'BERBAHAYA') THEN 'TIDAK SEHAT'
            ELSE {_overall_sql(True)} END AS category,
       {_overall_sql(False)} AS kategori_rule_cont
FROM panel_air""")
def rul2_overall_category(spark, d):
    a = tb.panel_air(spark, d)
    strict = rl.rule_category(strict_gaps=True)
    return a.select("station", "date", strict.alias("kategori_rule"),
                    enc.collapse_category(strict).alias("category"),
                    rl.rule_category(strict_gaps=False).alias("kategori_rule_cont"))


@register("rul3_any_unhealthy", tb.with_views("panel_air") + "SELECT station, date, CAST(" + " OR ".join(
    f"coalesce({p} > {t}, false)" for p, t in rl.UNHEALTHY_ABOVE.items()) + " AS INTEGER) AS is_unhealthy FROM panel_air")
def rul3_any_unhealthy(spark, d):
    a = tb.panel_air(spark, d)
    return a.select("station", "date", rl.any_unhealthy().alias("is_unhealthy"))


@register("agg33_threshold_band_counts", tb.with_views("panel_air") + "SELECT " + ", ".join(
    f"CAST(count_if({p} BETWEEN {lo} AND {hi}) AS BIGINT) AS {p}_{cat.lower().replace(' ', '_')}"
    for p in _POLL for cat, (lo, hi) in zip(enc.CATEGORIES, rl.BANDS[p]) if hi != rl.INF) + " FROM panel_air")
def agg33_threshold_band_counts(spark, d):
    a = tb.panel_air(spark, d)
    return ag.band_counts(a, rl.BANDS, enc.CATEGORIES)


# ---------------------------------------------------------------- filters (FLT)

@register("flt1_drop_no_data_label", tb.with_views("panel_air") + """
SELECT station, date, kategori FROM panel_air WHERE kategori IS DISTINCT FROM 'TIDAK ADA DATA'""")
def flt1_drop_no_data_label(spark, d):
    return pr.drop_sentinel(tb.panel_air(spark, d)).select("station", "date", "kategori")


@register("flt2_drop_null_cells", tb.with_views("panel_air") + """
SELECT station, date, pm_duakomalima, karbon_monoksida FROM panel_air
WHERE station IS NOT NULL AND date IS NOT NULL AND pm_duakomalima IS NOT NULL AND karbon_monoksida IS NOT NULL""")
def flt2_drop_null_cells(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_duakomalima", "karbon_monoksida")
    return pr.drop_null_keys(a, ["station", "date", "pm_duakomalima", "karbon_monoksida"])


@register("flt3_time_range_split", """
SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS price,
       CAST(CAST(o_orderdate AS DATE) <= DATE '1999-12-31' AS INTEGER) AS is_train
FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'""")
def flt3_time_range_split(spark, d):
    o = tb.table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("1997-01-01"))
    x = o.select(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"))
    return x.withColumn("is_train", pr.in_range("date", end="1999-12-31").cast("int"))


@register("flt4_membership_flags", tb.with_views("panel_air") + """
SELECT station, date, CAST(coalesce(kategori IN ('TIDAK SEHAT', 'SANGAT TIDAK SEHAT', 'BERBAHAYA'), false) AS INTEGER)
         AS is_unhealthy,
       CAST(coalesce(month(date) IN (11, 12, 1, 2, 3), false) AS INTEGER) AS is_wet_season
FROM panel_air""")
def flt4_membership_flags(spark, d):
    a = tb.panel_air(spark, d)
    return a.select("station", "date", enc.is_unhealthy_label("kategori").alias("is_unhealthy"),
                    pr.member_flag(F.month("date"), dt.WET_SEASON_MONTHS).alias("is_wet_season"))


@register("flt6_overlap_range", tb.with_views("panel_orders", "panel_ship") + """
SELECT a.station, greatest(a.d0, b.d0) AS overlap_start, least(a.d1, b.d1) AS overlap_end,
       CAST(date_diff('day', greatest(a.d0, b.d0), least(a.d1, b.d1)) + 1 AS INTEGER) AS overlap_days
FROM (SELECT station, min(date) AS d0, max(date) AS d1 FROM panel_orders GROUP BY 1) a
JOIN (SELECT station, min(date) AS d0, max(date) AS d1 FROM panel_ship GROUP BY 1) b ON a.station = b.station""")
def flt6_overlap_range(spark, d):
    return ag.overlap_range(tb.panel_orders(spark, d), tb.panel_ship(spark, d))


@register("flt7_negative_counts", tb.with_views("panel_air") + """
SELECT station, CAST(count_if(ozon - 100 < 0) AS BIGINT) AS negative_o3_excess,
       CAST(count_if(pm_sepuluh < 0) AS BIGINT) AS negative_pm10
FROM panel_air GROUP BY station""")
def flt7_negative_counts(spark, d):
    a = tb.panel_air(spark, d)
    return a.groupBy("station").agg(pr.negative_count(F.col("ozon") - 100).alias("negative_o3_excess"),
                                    pr.negative_count("pm_sepuluh").alias("negative_pm10"))
