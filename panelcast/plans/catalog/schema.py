"""Schema harmonisation, column-set and set-operation queries (PRJ1-PRJ13, SET1-SET4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import rules as rl
from ...operators import profile as pf
from ...operators.aggregates import attach_params
from ...operators import schema as sc
from ...operators import windows
from ...sources import tables as tb
from . import register
from . import as_double as R

POLL = list(rl.POLLUTANTS)
AIR = tb.with_views("panel_air")

# Old-layout short names -> canonical pollutant names.
OLD_TO_CANONICAL = {"pm10": "pm_sepuluh", "pm25": "pm_duakomalima", "so2": "sulfur_dioksida",
                    "co": "karbon_monoksida", "o3": "ozon", "no2": "nitrogen_dioksida", "categori": "kategori"}


@register("prj1_family_rename_union", AIR + "SELECT station, date, " + ", ".join(f"{R(p)} AS {p}" for p in POLL)
          + ", kategori FROM panel_air")
def prj1_family_rename_union(spark, d):
    """Early years carry short names, later years canonical ones; rename per family, union."""
    a = tb.panel_air(spark, d).select("station", "date", *POLL, "kategori")
    inv = {v: k for k, v in OLD_TO_CANONICAL.items()}
    early = sc.rename(a.where(F.year("date") <= 1997), inv)
    late = a.where(F.year("date") > 1997)
    return sc.harmonise([sc.rename(early, OLD_TO_CANONICAL), late], ["station", "date", *POLL, "kategori"])


# Three naming vocabularies of one parameter set.
PARAM_ALIASES = {"CLICK": "click_rate", "CLICKS": "click_rate", "KLIK": "click_rate",
                 "VIEW": "view_rate", "VIEWS": "view_rate", "PURCHASE": "purchase_value",
                 "BELI": "purchase_value", "SIGNUP": "signup_count", "ERROR": "error_count"}


@register("prj2_parameter_aliases", tb.with_views("obs_events") + """
SELECT event_id, CASE upper(trim(p)) """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PARAM_ALIASES.items())
    + """ ELSE upper(trim(p)) END AS parameter
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper(parameter)
                            WHEN event_id % 3 = 1 THEN ' ' || parameter || 's' ELSE parameter END AS p FROM obs_events) t""")
def prj2_parameter_aliases(spark, d):
    e = tb.obs_events(spark, d)
    raw = F.when(F.col("event_id") % 3 == 0, F.upper("parameter")) \
           .when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.col("parameter"), F.lit("s"))) \
           .otherwise(F.col("parameter"))
    return e.select("event_id", sc.standardise_names(raw, PARAM_ALIASES).alias("parameter"))


@register("prj3_set1_union_missing_columns", tb.with_views("panel_air", "panel_ship") + f"""
SELECT 'air' AS source, station, date, {R('pm_sepuluh')} AS pm_sepuluh, NULL::DOUBLE AS qty_avg, n_lines FROM panel_air
UNION ALL
SELECT 'ship', station, date, NULL::DOUBLE, {R('qty_avg')}, n_lines FROM panel_ship""")
def prj3_set1_union_missing_columns(spark, d):
    a = tb.panel_air(spark, d).select(F.lit("air").alias("source"), "station", "date", "pm_sepuluh", "n_lines")
    s = tb.panel_ship(spark, d).select(F.lit("ship").alias("source"), "station", "date", "qty_avg", "n_lines")
    return sc.harmonise([a, s], ["source", "station", "date", "pm_sepuluh", "qty_avg", "n_lines"])


@register("prj4_first_present_column", tb.with_views("points") + f"""
SELECT vec_id, {R('x')} AS lintang FROM points WHERE label = 0
UNION ALL SELECT vec_id, {R('y')} FROM points WHERE label <> 0""")
def prj4_first_present_column(spark, d):
    p = tb.points(spark, d)
    a = sc.first_present(p.where("label = 0").select("vec_id", F.col("x").alias("latitude")),
                         ["lintang", "latitude", "lintang_selatan"], "lintang")
    b = sc.first_present(p.where("label <> 0").select("vec_id", F.col("y").alias("lintang_selatan")),
                         ["lintang", "latitude", "lintang_selatan"], "lintang")
    return a.unionByName(b)


@register("prj5_prj8_order_and_id", AIR + f"""
SELECT strftime(date, '%Y-%m-%d') || '_' || station AS ID, date, station, {R('pm_sepuluh')} AS pm_sepuluh,
       {R('ozon')} AS ozon, kategori FROM panel_air""")
def prj5_prj8_order_and_id(spark, d):
    a = tb.panel_air(spark, d).select("kategori", "ozon", "pm_sepuluh", "station", "date")
    a = sc.with_id(a)
    return sc.order_columns(a, ["ID", "date", "station"], ["pm_sepuluh", "ozon"])


@register("prj6_prj7_feature_columns", AIR + f"""
SELECT station, date, {R('sulfur_dioksida')} AS sulfur_dioksida, {R('karbon_monoksida')} AS karbon_monoksida,
       {R('ozon')} AS ozon, {R('nitrogen_dioksida')} AS nitrogen_dioksida, {R('pm_sepuluh_lag_7d')} AS pm_sepuluh_lag_7d
FROM (SELECT *, lag(pm_sepuluh, 7) OVER (PARTITION BY station ORDER BY date) AS pm_sepuluh_lag_7d FROM panel_air) t""")
def prj6_prj7_feature_columns(spark, d):
    a = tb.panel_air(spark, d)
    a = windows.lags(a, ["pm_sepuluh"], [7])
    a = windows.rolling(a, ["pm_sepuluh"], [3], ["mean"], name="{col}_rolling_{n}")
    feats = sc.feature_columns(a, meta=["station", "date"], targets=["pm_sepuluh", "pm_duakomalima"],
                               exclude=["n_lines"], patterns=[r"^kategori"])
    feats = sc.drop_dominant(feats, "pm_sepuluh", keep=["pm_sepuluh_lag_7d"])
    return a.select("station", "date", *feats)


@register("prj9_strip_units", tb.with_views("panel_ship") + f"""
SELECT station, date, {R('qty_avg')} AS temperature_2m_mean, {R('disc_avg * 100')} AS wind_speed_10m_mean
FROM panel_ship""")
def prj9_strip_units(spark, d):
    s = tb.panel_ship(spark, d).select("station", "date", F.col("qty_avg").alias("temperature_2m_mean (°C)"),
                                       (F.col("disc_avg") * 100).alias("wind_speed_10m_mean (km/h)"))
    return sc.strip_units(s)


@register("prj11_schema_alignment", tb.with_views("panel_air", "panel_ship") + """
SELECT c AS "column", CAST(c IN ('station', 'date', 'n_lines', 'pm_sepuluh', 'pm_duakomalima', 'sulfur_dioksida',
  'karbon_monoksida', 'ozon', 'nitrogen_dioksida', 'kategori') AS INTEGER) AS in_a,
  CAST(c IN ('station', 'date', 'qty_avg', 'disc_avg', 'tax_avg', 'revenue', 'n_lines') AS INTEGER) AS in_b,
  (SELECT count(*) FROM panel_air) AS rows_a, (SELECT count(*) FROM panel_ship) AS rows_b
FROM (SELECT unnest(['station', 'date', 'pm_sepuluh', 'pm_duakomalima', 'sulfur_dioksida', 'karbon_monoksida', 'ozon',
       'nitrogen_dioksida', 'kategori', 'n_lines', 'qty_avg', 'disc_avg', 'tax_avg', 'revenue']) AS c) t""")
def prj11_schema_alignment(spark, d):
    a, b = tb.panel_air(spark, d), tb.panel_ship(spark, d)
    diff = sc.column_diff(a, b)
    names = diff["both"] + diff["only_a"] + diff["only_b"]
    rows = [(c, int(c in a.columns), int(c in b.columns)) for c in names]
    cols = spark.createDataFrame(rows, "column string, in_a int, in_b int")
    counts = attach_params(a.agg(F.count(F.lit(1)).alias("rows_a")), b.agg(F.count(F.lit(1)).alias("rows_b")))
    return attach_params(cols, counts)


_FAMILIES = {"lag": r"_lag_\d+d$", "rolling": r"_roll(mean|std|sum)_\d+d$", "change": r"_(delta|pct_change)_\d+d$"}


def _generated(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh", "ozon")
    a = windows.lags(a, ["pm_sepuluh", "ozon"], [7, 14])
    a = windows.rolling(a, ["pm_sepuluh"], [7], ["mean", "std"])
    return windows.deltas(a, ["ozon"], [1])


@register("prj12_prj13_feature_families", AIR + """
SELECT family, count(*) AS n_features, max(n) AS rows FROM (
  SELECT unnest(['pm_sepuluh_lag_7d', 'pm_sepuluh_lag_14d', 'pm_sepuluh_rollmean_7d', 'pm_sepuluh_rollstd_7d']) AS c,
         'x' AS dummy) f,
  (SELECT count(*) AS n FROM panel_air) r,
  LATERAL (SELECT CASE WHEN regexp_matches(c, '_lag_\\d+d$') THEN 'lag'
                       WHEN regexp_matches(c, '_roll(mean|std|sum)_\\d+d$') THEN 'rolling' ELSE 'other' END AS family)
GROUP BY family""".replace("\\\\", "\\"))
def prj12_prj13_feature_families(spark, d):
    g = _generated(spark, d)
    keep = sc.derived_from([c for c in g.columns if c not in ("station", "date")], ["pm_sepuluh"])
    keep = [c for c in keep if c != "pm_sepuluh"]
    names = spark.createDataFrame([(c,) for c in keep], "column string")
    fam = sc.families(names, _FAMILIES)
    n = g.agg(F.count(F.lit(1)).alias("rows"))
    return attach_params(fam, n)


@register("set2_key_set_difference", tb.with_views("panel_orders", "panel_ship") + """
SELECT station, date, 'orders_only' AS side FROM (SELECT station, date FROM panel_orders EXCEPT ALL SELECT station, date FROM panel_ship)
UNION ALL
SELECT station, date, 'ship_only' FROM (SELECT station, date FROM panel_ship EXCEPT ALL SELECT station, date FROM panel_orders)""")
def set2_key_set_difference(spark, d):
    _, a_only, b_only = sc.key_sets(tb.panel_orders(spark, d), tb.panel_ship(spark, d), ["station", "date"])
    return a_only.withColumn("side", F.lit("orders_only")).unionByName(b_only.withColumn("side", F.lit("ship_only")))


_FEATS = ["ozon", "karbon_monoksida", "sulfur_dioksida", "nitrogen_dioksida", "n_lines"]


def _corr_sql(x: str, y: str) -> str:
    xm, ym = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"covar_pop({xm}, {ym}) / nullif(stddev_pop({xm}) * stddev_pop({ym}), 0)"


@register("set3_must_have_plus_top", AIR + ", s AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs({_corr_sql(f, 'pm_sepuluh')}) AS score FROM panel_air" for f in _FEATS) + """),
u AS (SELECT 'n_lines' AS feature, 0 AS r UNION ALL SELECT 'pm_duakomalima', 1
      UNION ALL SELECT feature, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, feature) + 1 AS INTEGER) FROM s),
m AS (SELECT feature, min(r) AS r FROM u GROUP BY 1)
SELECT feature, CAST(r + 1 AS INTEGER) AS position FROM m ORDER BY r LIMIT 4""")
def set3_must_have_plus_top(spark, d):
    cm = pf.corr_matrix(tb.panel_air(spark, d), _FEATS, ["pm_sepuluh"], min_pairs=0)
    ranked = cm.select("feature", F.abs("pm_sepuluh").alias("score"))
    return sc.ordered_top(["n_lines", "pm_duakomalima"], ranked, 4)


@register("set4_source_priority", tb.with_views("panel_orders", "panel_ship") + f"""
, u AS (SELECT station, CAST(year(date) AS INTEGER) AS year, 1 AS priority, 'orders' AS source,
               CAST(sum(n_orders) AS BIGINT) AS n FROM panel_orders WHERE year(date) BETWEEN 1995 AND 1998 GROUP BY 1, 2
        UNION ALL
        SELECT station, CAST(year(date) AS INTEGER), 2, 'lines', CAST(sum(n_lines) AS BIGINT) FROM panel_ship GROUP BY 1, 2)
SELECT station, year, priority, source, n FROM u
QUALIFY row_number() OVER (PARTITION BY station, year ORDER BY priority) = 1""")
def set4_source_priority(spark, d):
    o = tb.panel_orders(spark, d).where(F.year("date").between(1995, 1998)) \
          .groupBy("station", F.year("date").alias("year")).agg(F.sum("n_orders").alias("n")) \
          .select("station", "year", F.lit(1).alias("priority"), F.lit("orders").alias("source"), "n")
    s = tb.panel_ship(spark, d).groupBy("station", F.year("date").alias("year")).agg(F.sum("n_lines").alias("n")) \
          .select("station", "year", F.lit(2).alias("priority"), F.lit("lines").alias("source"), "n")
    return sc.prefer_sources(o.unionByName(s), ["station", "year"], "priority")


@register("prj10_left_wins_on_collision", tb.with_views("panel_air", "panel_ship") + f"""
SELECT a.station, a.date, a.n_lines, {R('s.qty_avg')} AS qty_avg
FROM panel_air a LEFT JOIN panel_ship s ON a.station = s.station AND a.date = s.date""")
def prj10_left_wins_on_collision(spark, d):
    """Both panels carry ``n_lines``; the right copy is dropped before the join."""
    from ...operators import joins as jn
    a = tb.panel_air(spark, d).select("station", "date", "n_lines")
    s = tb.panel_ship(spark, d).select("station", "date", "qty_avg", F.lit(-1).alias("n_lines"))
    return jn.join_panels(a, [s])


@register("srt1_sorted_sink_order", AIR + f"""
SELECT station, date, {R('pm_sepuluh')} AS pm_sepuluh FROM panel_air ORDER BY station, date""")
def srt1_sorted_sink_order(spark, d):
    """Global sort only at the sink (range-partitioned sort, no single-task gather)."""
    return tb.panel_air(spark, d).select("station", "date", "pm_sepuluh").orderBy("station", "date")


@register("srt2_top_k_days", AIR + f"""
SELECT station, date, {R('pm_sepuluh')} AS pm_sepuluh FROM panel_air
WHERE pm_sepuluh IS NOT NULL ORDER BY pm_sepuluh DESC, station, date LIMIT 20""")
def srt2_top_k_days(spark, d):
    """Top-k as ``orderBy.limit`` (TakeOrderedAndProject: per-partition top k, then merge)."""
    a = tb.panel_air(spark, d).where(F.col("pm_sepuluh").isNotNull())
    return a.select("station", "date", "pm_sepuluh").orderBy(F.col("pm_sepuluh").desc(), "station", "date").limit(20)
