"""Join queries (JN1-JN6, JN9, JN10, JN14-JN16, PRJ10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import text as tx
from ...operators import densify as dz
from ...operators import joins as jn
from ...sources import tables as tb
from . import register
from . import as_double as R

W = "PARTITION BY station ORDER BY date"


def calendar(spark, d):
    """Holiday-style calendar derived from orders: one row per order day."""
    o = tb.table(spark, d, "orders")
    return (o.groupBy(F.to_date("o_orderdate").alias("date"))
             .agg((F.count_if(F.col("o_orderpriority") == "1-URGENT") == 0).cast("int").alias("is_holiday_nasional"))
             .withColumn("is_weekend", (F.weekday("date") >= 5).cast("int")))


CAL_SQL = """cal AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(count_if(o_orderpriority = '1-URGENT') = 0 AS INTEGER) AS is_holiday_nasional,
         CAST(isodow(CAST(o_orderdate AS DATE)) >= 6 AS INTEGER) AS is_weekend
  FROM orders GROUP BY 1, 3)"""


@register("jn1_multiway_left_join", tb.with_views("panel_air", "panel_ship", "panel_orders", extra=CAL_SQL) + f"""
SELECT a.station, a.date, {R('a.pm_sepuluh')} AS pm_sepuluh, a.n_lines,
       {R('s.qty_avg')} AS qty_avg, {R('s.revenue')} AS revenue,
       {R('o.price_avg')} AS price_avg, o.n_orders, c.is_holiday_nasional
FROM panel_air a
LEFT JOIN panel_ship s ON a.station = s.station AND a.date = s.date
LEFT JOIN panel_orders o ON a.station = o.station AND a.date = o.date
LEFT JOIN cal c ON a.date = c.date""")
def jn1_multiway_left_join(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh", "n_lines")
    s = tb.panel_ship(spark, d).select("station", "date", "qty_avg", "revenue", "n_lines")
    o = tb.panel_orders(spark, d).select("station", "date", "price_avg", "n_orders")
    x = jn.join_panels(a, [s, o])
    return jn.join_by_date(x, calendar(spark, d).select("date", "is_holiday_nasional"))


@register("jn2_calendar_join", tb.with_views("panel_air", extra=CAL_SQL) + """
SELECT a.station, a.date, c.is_holiday_nasional, c.is_weekend
FROM panel_air a LEFT JOIN cal c ON a.date = c.date""")
def jn2_calendar_join(spark, d):
    a = tb.panel_air(spark, d).select("station", "date")
    return jn.join_by_date(a, calendar(spark, d))


@register("jn3_inner_join", tb.with_views("panel_orders", "panel_ship") + f"""
SELECT o.station, o.date, {R('o.price_avg')} AS price_avg, {R('s.qty_avg')} AS qty_avg
FROM panel_orders o JOIN panel_ship s ON o.station = s.station AND o.date = s.date""")
def jn3_inner_join(spark, d):
    o = tb.panel_orders(spark, d).select("station", "date", "price_avg")
    s = tb.panel_ship(spark, d).select("station", "date", "qty_avg")
    return jn.join_panels(o, [s], how="inner")


@register("jn4_dimension_lookup", """
SELECT l.l_orderkey, l.l_linenumber, 'DKI' || CAST(n.n_regionkey + 1 AS VARCHAR) AS station
FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def jn4_dimension_lookup(spark, d):
    li = tb.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    s = tb.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    n = tb.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"),
        F.concat(F.lit("DKI"), (F.col("n_regionkey") + 1).cast("string")).alias("station"))
    dim = jn.lookup_join(s, n, "s_nationkey").select("l_suppkey", "station")
    return jn.lookup_join(li, dim, "l_suppkey").select("l_orderkey", "l_linenumber", "station")


# Fixed dictionary: title-cased place name -> station code.
CITY_TO_STATION = {"Nation_0": "DKI1", "Nation_1": "DKI2", "Nation_2": "DKI3", "Nation_3": "DKI4", "Nation_4": "DKI5"}
_CASE = "CASE " + " ".join(f"WHEN city = '{k}' THEN '{v}'" for k, v in CITY_TO_STATION.items()) + " END"
_TITLE = ("array_to_string(list_transform(string_split(lower(n.n_name), ' '), "
          "lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')")


@register("jn5_dictionary_lookup", f"""
SELECT c_custkey, city, {_CASE} AS station FROM (
  SELECT c.c_custkey, {_TITLE} AS city FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey) t""")
def jn5_dictionary_lookup(spark, d):
    c = tb.table(spark, d, "customer")
    n = tb.table(spark, d, "nation")
    x = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        "c_custkey", tx.title_case(F.lower("n_name")).alias("city"))
    return x.withColumn("station", jn.map_lookup("city", CITY_TO_STATION))


@register("jn5_unmatched_report", f"""
SELECT city, count(*) AS n_rows FROM (
  SELECT {_TITLE} AS city FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey) t
WHERE city NOT IN ({", ".join(f"'{k}'" for k in CITY_TO_STATION)}) GROUP BY city""")
def jn5_unmatched_report(spark, d):
    c = tb.table(spark, d, "customer")
    n = tb.table(spark, d, "nation")
    x = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(tx.title_case(F.lower("n_name")).alias("city"))
    dim = spark.createDataFrame([(k, v) for k, v in CITY_TO_STATION.items()], "city string, station string")
    return jn.unmatched(x, F.broadcast(dim), "city").groupBy("city").agg(F.count(F.lit(1)).alias("n_rows"))


_TYPES = {"click": "physical", "view": "physical", "purchase": "chemical", "signup": "chemical", "error": "bio"}
_PARAMS = ("click", "view", "purchase", "signup", "error")


def _typed_events(spark, d):
    e = tb.obs_events(spark, d)
    t = F.when(F.col("parameter").isin("click", "view"), "physical") \
         .when(F.col("parameter").isin("purchase", "signup"), "chemical").otherwise("bio")
    return e.withColumn("jenis_parameter", t)


@register("jn6_complete_pivot", tb.with_views("obs_events") + f"""
, typed AS (SELECT *, CASE WHEN parameter IN ('click', 'view') THEN 'physical'
                           WHEN parameter IN ('purchase', 'signup') THEN 'chemical' ELSE 'bio' END AS jenis_parameter
            FROM obs_events),
have AS (SELECT station, date FROM typed WHERE value IS NOT NULL GROUP BY 1, 2
         HAVING count(DISTINCT jenis_parameter) = 3)
SELECT t.station, t.date, """ + ", ".join(
    f"{R(f'avg(CASE WHEN parameter = ' + repr(p) + ' THEN value END)')} AS {p}" for p in _PARAMS) + """
FROM typed t SEMI JOIN have h ON t.station = h.station AND t.date = h.date GROUP BY 1, 2""")
def jn6_complete_pivot(spark, d):
    e = _typed_events(spark, d)
    return jn.complete_pivot(e, ["station", "date"], "jenis_parameter", ["physical", "chemical", "bio"],
                             "parameter", _PARAMS)


_FUT_SQL = """mx AS (SELECT max(date) AS d1 FROM panel_air),
fut AS (SELECT s.station, CAST(unnest(generate_series(m.d1 + 1, m.d1 + 30, INTERVAL 1 DAY)) AS DATE) AS date
        FROM (SELECT DISTINCT station FROM panel_air) s, mx m)"""


def _future(spark, d):
    a = tb.panel_air(spark, d)
    d0, d1 = dz.date_bounds(a)
    import datetime as _dt
    return a, dz.date_skeleton(a.select("station"), d1 + _dt.timedelta(days=1), d1 + _dt.timedelta(days=30)), d1


@register("jn9_last_known_row_latest", tb.with_views("panel_air", extra=_FUT_SQL) + f"""
SELECT f.station, f.date, {R('l.pm_sepuluh')} AS pm_sepuluh, {R('l.ozon')} AS ozon
FROM fut f LEFT JOIN (SELECT station, pm_sepuluh, ozon FROM panel_air
                      QUALIFY row_number() OVER (PARTITION BY station ORDER BY date DESC) = 1) l
  ON f.station = l.station""")
def jn9_last_known_row_latest(spark, d):
    a, fut, _ = _future(spark, d)
    return jn.last_known_row(a, fut, ["pm_sepuluh", "ozon"])


@register("jn9_last_known_row_at_end_date", tb.with_views("panel_air", extra=_FUT_SQL) + f"""
SELECT f.station, f.date, {R('l.pm_sepuluh')} AS pm_sepuluh, {R('l.ozon')} AS ozon
FROM fut f LEFT JOIN (SELECT station, pm_sepuluh, ozon FROM panel_air
                      WHERE date = (SELECT d1 - 3 FROM mx)) l ON f.station = l.station""")
def jn9_last_known_row_at_end_date(spark, d):
    a, fut, d1 = _future(spark, d)
    import datetime as _dt
    return jn.last_known_row(a, fut, ["pm_sepuluh", "ozon"], at_date=d1 - _dt.timedelta(days=3))


@register("jn10_asof_reindex", tb.with_views("panel_orders") + f"""
, sk AS (SELECT s.station, CAST(unnest(generate_series(DATE '1994-12-20', b.d1, INTERVAL 1 DAY)) AS DATE) AS date
         FROM (SELECT DISTINCT station FROM panel_orders) s, (SELECT max(date) AS d1 FROM panel_orders) b),
od AS (SELECT DISTINCT date FROM panel_orders),
m AS (SELECT k.date, (SELECT max(o.date) FROM od o WHERE o.date <= k.date) AS asof
      FROM (SELECT DISTINCT date FROM sk) k),
j AS (SELECT k.station, k.date, p.price_avg FROM sk k JOIN m ON k.date = m.date
      LEFT JOIN panel_orders p ON p.station = k.station AND p.date = m.asof)
SELECT station, date, {R(f'first_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')}
         AS price_avg
FROM j""")
def jn10_asof_reindex(spark, d):
    p = tb.panel_orders(spark, d).select("station", "date", "price_avg")
    _, d1 = dz.date_bounds(p)
    sk = dz.date_skeleton(p.select("station"), "1994-12-20", d1)
    return jn.asof_reindex(p, sk, ["price_avg"])


@register("jn14_key_overlap", tb.with_views("panel_orders", "panel_ship") + """
SELECT station, date FROM panel_orders INTERSECT SELECT station, date FROM panel_ship""")
def jn14_key_overlap(spark, d):
    return jn.key_overlap(tb.panel_orders(spark, d), tb.panel_ship(spark, d), ["station", "date"])


@register("jn15_seasonal_lookup_fill", tb.with_views("panel_orders") + f"""
, fit AS (SELECT * FROM panel_orders WHERE date <= DATE '1998-12-31'),
season AS (SELECT station, month(date) AS m, avg(price_avg) AS s FROM fit GROUP BY 1, 2),
med AS (SELECT station, quantile_cont(price_avg, 0.5) AS md FROM fit GROUP BY 1),
sk AS (SELECT s.station, CAST(unnest(generate_series(DATE '1999-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS date
       FROM (SELECT DISTINCT station FROM panel_orders) s),
dense AS (SELECT k.station, k.date, p.price_avg FROM sk k LEFT JOIN panel_orders p ON k.station = p.station AND k.date = p.date)
SELECT d.station, d.date, {R('coalesce(d.price_avg, s.s, m.md)')} AS price_avg
FROM dense d LEFT JOIN season s ON d.station = s.station AND month(d.date) = s.m
LEFT JOIN med m ON d.station = m.station""")
def jn15_seasonal_lookup_fill(spark, d):
    p = tb.panel_orders(spark, d).select("station", "date", "price_avg")
    fit = p.where(F.col("date") <= F.lit("1998-12-31").cast("date"))
    sk = dz.date_skeleton(p.select("station"), "1999-01-01", "2001-08-01")
    dense = dz.densify(p, sk)
    return jn.seasonal_fill(dense, ["price_avg"], fit)


@register("jn16_target_encoding", tb.with_views("panel_air") + f"""
SELECT a.station, a.date, {R('e.m')} AS station_pm_sepuluh_mean
FROM panel_air a JOIN (SELECT station, avg(pm_sepuluh) AS m FROM panel_air GROUP BY 1) e ON a.station = e.station""")
def jn16_target_encoding(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh")
    return jn.target_encode(a, "station", "pm_sepuluh", out="station_pm_sepuluh_mean").drop("pm_sepuluh")
