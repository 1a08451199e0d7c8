"""Skeleton, densify, fills and staleness on the sparse orders panel (JN7, JN8, JN11, WIN8-WIN16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import densify as dz
from ...operators import fills, windows
from ...operators.frames import STATION_DATE
from ...sources import tables as tb
from . import register, doubles
from . import as_double as R

# Shared oracle CTEs: skeleton over the global date range x stations, then densify.
DENSE_SQL = """bounds AS (SELECT min(date) AS d0, max(date) AS d1 FROM panel_orders),
skeleton AS (
  SELECT s.station, CAST(unnest(generate_series(b.d0, b.d1, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT station FROM panel_orders) s, bounds b),
dense AS (
  SELECT k.station, k.date, p.price_avg, p.price_max, p.n_orders
  FROM skeleton k LEFT JOIN panel_orders p ON k.station = p.station AND k.date = p.date)"""

W = "PARTITION BY station ORDER BY date"


def dense_orders(spark, d):
    return dz.densify_panel(tb.panel_orders(spark, d))


@register("jn7_date_skeleton", tb.with_views("panel_orders", extra=DENSE_SQL)
          + "SELECT station, date FROM skeleton")
def jn7_date_skeleton(spark, d):
    p = tb.panel_orders(spark, d)
    d0, d1 = dz.date_bounds(p)
    return dz.date_skeleton(p.select("station"), d0, d1)


@register("jn8_densify", tb.with_views("panel_orders", extra=DENSE_SQL)
          + f"SELECT {doubles('price_avg', 'price_max')} FROM dense")
def jn8_densify(spark, d):
    return dense_orders(spark, d)


@register("win8_ffill", tb.with_views("panel_orders", extra=DENSE_SQL) + f"""
SELECT {doubles('price_avg', 'price_ffill')} FROM (
  SELECT station, date, price_avg,
         last_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS price_ffill
  FROM dense)""")
def win8_ffill(spark, d):
    x = dense_orders(spark, d).select("station", "date", "price_avg")
    return fills.ffill(x.withColumn("price_ffill", F.col("price_avg")), "price_ffill")


@register("win9_bfill", tb.with_views("panel_orders", extra=DENSE_SQL) + f"""
SELECT {doubles('price_avg', 'price_bfill')} FROM (
  SELECT station, date, price_avg,
         first_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
           AS price_bfill
  FROM dense)""")
def win9_bfill(spark, d):
    x = dense_orders(spark, d).select("station", "date", "price_avg")
    return fills.bfill(x, "price_avg", suffix="_bfill").select(
        "station", "date", "price_avg", F.col("price_avg_bfill").alias("price_bfill"))


@register("win10_bfill_then_ffill", tb.with_views("panel_orders", extra=DENSE_SQL) + f"""
SELECT {doubles('price_avg', 'bf_ff', 'ff_bf')} FROM (
  SELECT station, date, price_avg,
    coalesce(first_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
             last_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS bf_ff,
    coalesce(last_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ff_bf
  FROM dense)""")
def win10_bfill_then_ffill(spark, d):
    x = dense_orders(spark, d).select("station", "date", "price_avg")
    x = fills.fill_both(x, "price_avg", first="bfill", suffix="_bf_ff")
    x = fills.fill_both(x, "price_avg", first="ffill", suffix="_ff_bf")
    return x.select("station", "date", "price_avg", F.col("price_avg_bf_ff").alias("bf_ff"),
                    F.col("price_avg_ff_bf").alias("ff_bf"))


FLAGSHIP_SQL = tb.with_views("panel_orders", extra=DENSE_SQL) + f"""
, filled AS (
  SELECT station, date, price_avg,
         last_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price_ffill,
         CAST(coalesce(date_diff('day',
              last_value(CASE WHEN price_avg IS NOT NULL THEN date END IGNORE NULLS)
                OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), date), -1) AS INTEGER)
           AS days_since_update
  FROM dense)
SELECT {doubles('price_avg', 'price_ffill', 'price_roll7')} FROM (
  SELECT *, avg(price_ffill) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS price_roll7
  FROM filled)"""


def flagship(spark, d):
    """Densify the sparse panel, forward fill, count staleness, 7-day mean (JN7+JN8+WIN8+WIN12+WIN6)."""
    x = dense_orders(spark, d).select("station", "date", "price_avg")
    x = fills.days_since(x.withColumn("price_ffill", F.col("price_avg")), F.col("price_avg").isNotNull(),
                         "days_since_update", also_ffill=["price_ffill"], row_index="_rn")
    x = windows.rolling(x, "price_ffill", [7], ["mean"], STATION_DATE.with_index("_rn"), name="price_roll7")
    return x.select("station", "date", "price_avg", "price_ffill", "days_since_update", "price_roll7")


register("win12_days_since_update", FLAGSHIP_SQL)(flagship)


@register("win13_staleness_counter", tb.with_views("panel_orders", extra=DENSE_SQL) + f"""
, idx AS (SELECT *, row_number() OVER ({W}) AS rn FROM dense)
SELECT station, date, {R('price_avg')} AS price_avg, CAST(rn - coalesce(last_value(CASE WHEN price_avg IS NOT NULL THEN rn END IGNORE NULLS)
         OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS price_avg_days_stale
FROM (SELECT station, date, rn,
        last_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price_avg,
        price_avg AS raw FROM idx) t
""".replace("CASE WHEN price_avg IS NOT NULL", "CASE WHEN raw IS NOT NULL"))
def win13_staleness_counter(spark, d):
    x = dense_orders(spark, d).select("station", "date", "price_avg")
    return fills.staleness_counter(x, "price_avg")


@register("win14_availability_flag", tb.with_views("panel_orders", extra=DENSE_SQL) + """
, first_obs AS (SELECT station, min(date) AS d_first FROM panel_orders WHERE price_avg IS NOT NULL GROUP BY 1)
SELECT k.station, k.date, CAST(coalesce(k.date >= f.d_first, false) AS INTEGER) AS price_avg_available
FROM skeleton k LEFT JOIN first_obs f ON k.station = f.station""")
def win14_availability_flag(spark, d):
    p = tb.panel_orders(spark, d)
    x = dz.densify_panel(p).select("station", "date", "price_avg")
    return fills.availability_flag(x, "price_avg", source=p).select(
        "station", "date", "price_avg_available")


@register("win16_time_interpolation", tb.with_views("panel_orders", extra=DENSE_SQL) + f"""
, nb AS (
  SELECT station, date, price_avg,
    last_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    last_value(CASE WHEN price_avg IS NOT NULL THEN date END IGNORE NULLS)
      OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
    first_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
    first_value(CASE WHEN price_avg IS NOT NULL THEN date END IGNORE NULLS)
      OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt
  FROM dense)
SELECT station, date, {R('price_avg')} AS price_avg, {R("""CASE
    WHEN price_avg IS NOT NULL THEN price_avg
    WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * date_diff('day', pt, date) / date_diff('day', pt, nt)
    ELSE coalesce(pv, nv) END""")} AS price_interp
FROM nb""")
def win16_time_interpolation(spark, d):
    x = dense_orders(spark, d).select("station", "date", "price_avg")
    return fills.interpolate_time(x, "price_avg", suffix="_interp").select(
        "station", "date", "price_avg", F.col("price_avg_interp").alias("price_interp"))


@register("jn11_reindex_ffill_bfill_staleness", tb.with_views("panel_orders") + f"""
, stations AS (SELECT DISTINCT station FROM panel_orders),
skeleton AS (
  SELECT s.station, CAST(unnest(generate_series(DATE '1996-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS DATE) AS date
  FROM stations s),
dense AS (SELECT k.station, k.date, p.price_avg FROM skeleton k
          LEFT JOIN panel_orders p ON k.station = p.station AND k.date = p.date),
obs AS (SELECT station, date FROM panel_orders WHERE price_avg IS NOT NULL)
SELECT station, date, {R(f"""coalesce(
    last_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(price_avg IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")} AS price_avg,
  CAST(coalesce(date_diff('day', (SELECT max(o.date) FROM obs o WHERE o.station = dense.station AND o.date <= dense.date), date), -1)
       AS INTEGER) AS days_since_update
FROM dense""")
def jn11_reindex_ffill_bfill_staleness(spark, d):
    """Exact reindex onto 1996..2000: observations off the skeleton are lost for the
    values, but staleness counts from any observation at or before the day."""
    p = tb.panel_orders(spark, d).select("station", "date", "price_avg")
    sk = dz.date_skeleton(p.select("station"), "1996-01-01", "2000-12-31")
    # observations before the window still count for staleness: union them in, then drop
    obs = p.filter(F.col("price_avg").isNotNull()).select(
        "station", "date", F.lit(None).cast("double").alias("price_avg"), F.lit(True).alias("_obs"),
        F.lit(False).alias("_on_grid"))
    grid = dz.densify(p, sk).select("station", "date", "price_avg",
                                    F.col("price_avg").isNotNull().alias("_obs"), F.lit(True).alias("_on_grid"))
    pre = obs.filter(F.col("date") < F.lit("1996-01-01").cast("date"))
    x = grid.unionByName(pre)
    x = fills.days_since(x, F.col("_obs"), "days_since_update")
    x = x.filter("_on_grid").drop("_obs", "_on_grid")
    x = fills.fill_both(x, "price_avg", first="ffill")
    return x.select("station", "date", "price_avg", "days_since_update")
