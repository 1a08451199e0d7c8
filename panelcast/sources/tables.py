"""Driver tables and the panel views derived from them.

The driver's tables carry no stations or pollutants, so every registered query
derives a daily panel from them.  Each view exists twice, as a lazy DataFrame
and as SQL text for the DuckDB oracle; both must define the same rows.

==============  ===========================================================
view            stands in for
==============  ===========================================================
panel_orders    sparse daily air-quality panel (orders by customer region)
panel_ship      dense daily weather panel (lineitem by supplier region)
obs_events      long measurements (station, parameter, value, ts)
yearly          coarse yearly counts per station (population)
points          sampling points (first two embedding components)
==============  ===========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _station(region_key) -> F.Column:
    return F.concat(F.lit("DKI"), (region_key + 1).cast("string"))


def panel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, date) -> price_avg, price_max, n_orders.  ~70 % of keys present."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # nation is a fixed 25-row dimension: broadcasting it is bounded at any scale.
    # customer grows with the data, so its join is left to the planner / AQE.
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey))
    return (j.groupBy(_station(F.col("n_regionkey")).alias("station"),
                      F.to_date("o_orderdate").alias("date"))
             .agg(F.avg("o_totalprice").alias("price_avg"),
                  F.max("o_totalprice").alias("price_max"),
                  F.count(F.lit(1)).alias("n_orders")))


PANEL_ORDERS_SQL = """panel_orders AS (
  SELECT 'DKI' || CAST(n.n_regionkey + 1 AS VARCHAR) AS station,
         CAST(o.o_orderdate AS DATE) AS date,
         avg(o.o_totalprice) AS price_avg,
         max(o.o_totalprice) AS price_max,
         count(*) AS n_orders
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2)"""


def panel_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, date) -> qty_avg, disc_avg, tax_avg, revenue, n_lines.  Nearly dense."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = (li.join(s, li.l_suppkey == s.s_suppkey)
           .join(F.broadcast(n), F.col("s_nationkey") == n.n_nationkey))
    return (j.groupBy(_station(F.col("n_regionkey")).alias("station"),
                      F.to_date("l_shipdate").alias("date"))
             .agg(F.avg("l_quantity").alias("qty_avg"),
                  F.avg("l_discount").alias("disc_avg"),
                  F.avg("l_tax").alias("tax_avg"),
                  F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                  F.count(F.lit(1)).alias("n_lines")))


PANEL_SHIP_SQL = """panel_ship AS (
  SELECT 'DKI' || CAST(n.n_regionkey + 1 AS VARCHAR) AS station,
         CAST(l.l_shipdate AS DATE) AS date,
         avg(l.l_quantity) AS qty_avg,
         avg(l.l_discount) AS disc_avg,
         avg(l.l_tax) AS tax_avg,
         sum(l.l_extendedprice * (1 - l.l_discount)) AS revenue,
         count(*) AS n_lines
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY 1, 2)"""


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long measurements: event_id, ts, date, station, parameter, value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", F.to_date("ts").alias("date"),
        F.concat(F.lit("DKI"), (F.col("user_id") % 5 + 1).cast("string")).alias("station"),
        F.col("event_type").alias("parameter"), "value")


OBS_EVENTS_SQL = """obs_events AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS date,
         'DKI' || CAST(user_id % 5 + 1 AS VARCHAR) AS station,
         event_type AS parameter, value
  FROM events)"""


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, year) -> n_orders, total: a coarse, population-like series."""
    p = panel_orders(spark, sf_dir)
    return (p.groupBy("station", F.year("date").alias("year"))
             .agg(F.sum("n_orders").alias("n_orders"),
                  F.sum(F.col("price_avg") * F.col("n_orders")).alias("total")))


YEARLY_SQL = """yearly AS (
  SELECT station, CAST(year(date) AS INTEGER) AS year,
         CAST(sum(n_orders) AS BIGINT) AS n_orders, sum(price_avg * n_orders) AS total
  FROM panel_orders GROUP BY 1, 2)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling points: vec_id, x, y (first two embedding components, doubles)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id",
                    F.col("embedding")[0].cast("double").alias("x"),
                    F.col("embedding")[1].cast("double").alias("y"),
                    "label")


POINTS_SQL = """points AS (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x,
         CAST(embedding[2] AS DOUBLE) AS y, label
  FROM embeddings)"""


def panel_air(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, date) -> the six pollutant columns, kategori label, n_lines.

    Every value is a ratio of exact integer sums (quantities, discount and tax
    in hundredths, whole prices), so any engine computes the same doubles and
    band boundaries classify identically.  Some cells are NULL and some labels
    are the no-data sentinel or NULL, as in the raw air-quality files.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = (li.join(s, li.l_suppkey == s.s_suppkey)
           .join(F.broadcast(n), F.col("s_nationkey") == n.n_nationkey))
    cnt = F.count(F.lit(1))
    g = (j.groupBy(_station(F.col("n_regionkey")).alias("station"),
                   F.to_date("l_shipdate").alias("date"))
          .agg(cnt.alias("n_lines"),
               F.sum("l_quantity").alias("q"),
               F.sum(F.round(F.col("l_discount") * 100)).alias("dsc"),
               F.sum(F.round(F.col("l_tax") * 100)).alias("tx"),
               F.sum(F.round("l_extendedprice")).alias("px")))
    n_ = F.col("n_lines")
    return g.select(
        "station", "date",
        (F.lit(3.0) * F.col("q") / n_).alias("pm_sepuluh"),
        F.when(n_ % 7 != 0, F.lit(1.5) * F.col("q") / n_).alias("pm_duakomalima"),
        (F.lit(10.0) * F.col("dsc") / n_).alias("sulfur_dioksida"),
        F.when(n_ % 5 != 0, F.col("px") / n_ / F.lit(10.0)).alias("karbon_monoksida"),
        (F.lit(25.0) * F.col("tx") / n_).alias("ozon"),
        (F.lit(15.0) * n_).cast("double").alias("nitrogen_dioksida"),
        F.when(n_ % 11 == 0, F.lit("TIDAK ADA DATA"))
         .when(n_ % 13 == 0, F.lit(None).cast("string"))
         .when(F.lit(3.0) * F.col("q") / n_ > 100, F.lit("TIDAK SEHAT"))
         .when(F.lit(3.0) * F.col("q") / n_ > 50, F.lit("SEDANG"))
         .otherwise(F.lit("BAIK")).alias("kategori"),
        "n_lines")


PANEL_AIR_SQL = """panel_air AS (
  SELECT station, date,
         3.0 * q / n_lines AS pm_sepuluh,
         CASE WHEN n_lines % 7 <> 0 THEN 1.5 * q / n_lines END AS pm_duakomalima,
         10.0 * dsc / n_lines AS sulfur_dioksida,
         CASE WHEN n_lines % 5 <> 0 THEN px / n_lines / 10.0 END AS karbon_monoksida,
         25.0 * tx / n_lines AS ozon,
         CAST(15.0 * n_lines AS DOUBLE) AS nitrogen_dioksida,
         CASE WHEN n_lines % 11 = 0 THEN 'TIDAK ADA DATA'
              WHEN n_lines % 13 = 0 THEN NULL
              WHEN 3.0 * q / n_lines > 100 THEN 'TIDAK SEHAT'
              WHEN 3.0 * q / n_lines > 50 THEN 'SEDANG'
              ELSE 'BAIK' END AS kategori,
         n_lines
  FROM (
    SELECT 'DKI' || CAST(n.n_regionkey + 1 AS VARCHAR) AS station,
           CAST(l.l_shipdate AS DATE) AS date,
           count(*) AS n_lines,
           sum(l.l_quantity) AS q,
           sum(round(l.l_discount * 100)) AS dsc,
           sum(round(l.l_tax * 100)) AS tx,
           sum(round(l.l_extendedprice)) AS px
    FROM lineitem l
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey
    GROUP BY 1, 2) g)"""


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-file style text derived from orders: sentinels, European numbers,
    censored values, mixed date layouts, spreadsheet serials, station labels."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    d = F.to_date("o_orderdate")
    serial = F.concat((F.datediff(d, F.lit("1899-12-30").cast("date")) + 7305).cast("string"), F.lit(".625"))
    return o.select(
        k.alias("k"), F.col("o_totalprice").alias("price"), d.alias("order_date"),
        F.when(k % 17 == 0, F.lit("---")).when(k % 19 == 0, F.lit(""))
         .when(k % 23 == 0, F.lit("-")).otherwise(price).alias("price_txt"),
        F.replace(price, F.lit("."), F.lit(",")).alias("price_eu"),
        F.concat(F.when(k % 4 == 0, F.lit("<")).when(k % 4 == 1, F.lit("<=")).when(k % 4 == 2, F.lit(" "))
                  .otherwise(F.lit("")), F.replace(price, F.lit("."), F.lit(","))).alias("price_censored"),
        F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
         .when(k % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(serial).alias("date_txt"),
        F.when(k % 29 == 0, F.lit("O3"))
         .otherwise(F.concat(F.when(F.col("o_custkey") % 2 == 0, F.lit("Stasiun DKI"))
                                   .otherwise(F.lit("stasiun dki")),
                             (F.col("o_custkey") % 5 + 1).cast("string"),
                             F.lit(" Kebon Jeruk"))).alias("station_txt"),
        F.col("o_orderpriority").alias("priority"))


DIRTY_ORDERS_SQL = """dirty_orders AS (
  SELECT o_orderkey AS k, o_totalprice AS price, CAST(o_orderdate AS DATE) AS order_date,
         CASE WHEN o_orderkey % 17 = 0 THEN '---' WHEN o_orderkey % 19 = 0 THEN ''
              WHEN o_orderkey % 23 = 0 THEN '-'
              ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS price_txt,
         replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',') AS price_eu,
         CASE o_orderkey % 4 WHEN 0 THEN '<' WHEN 1 THEN '<=' WHEN 2 THEN ' ' ELSE '' END
           || replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',') AS price_censored,
         CASE o_orderkey % 3 WHEN 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')
              WHEN 1 THEN strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y')
              ELSE CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) + 7305 AS VARCHAR) || '.625'
         END AS date_txt,
         CASE WHEN o_orderkey % 29 = 0 THEN 'O3'
              ELSE CASE WHEN o_custkey % 2 = 0 THEN 'Stasiun DKI' ELSE 'stasiun dki' END
                   || CAST(o_custkey % 5 + 1 AS VARCHAR) || ' Kebon Jeruk' END AS station_txt,
         o_orderpriority AS priority
  FROM orders)"""


VIEW_SQL = {
    "panel_orders": PANEL_ORDERS_SQL,
    "panel_ship": PANEL_SHIP_SQL,
    "obs_events": OBS_EVENTS_SQL,
    "yearly": YEARLY_SQL,
    "points": POINTS_SQL,
    "panel_air": PANEL_AIR_SQL,
    "dirty_orders": DIRTY_ORDERS_SQL,
}
_VIEW_DEPS = {"yearly": ("panel_orders",)}


def with_views(*names: str, extra: str | None = None) -> str:
    """``WITH`` clause holding the named views (dependencies first) plus ``extra`` CTEs."""
    ordered: list[str] = []
    for name in names:
        for dep in _VIEW_DEPS.get(name, ()):
            if dep not in ordered:
                ordered.append(dep)
        if name not in ordered:
            ordered.append(name)
    parts = [VIEW_SQL[n] for n in ordered]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"
