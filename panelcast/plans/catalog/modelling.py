"""Modelling queries (ML1-ML18).

Fitted models (trees, forests, recursive forecasts, LSH oversampling) get the
rows-only check.  Everything around them is checked against SQL using
deterministic probability columns derived from the panel: class scores
``-|pm10 - centre| / 25`` turned into probabilities with a softmax.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from ...functions import dates as dtf
from ...functions import encode as enc
from ...operators import densify as dz
from ...operators import modelling as ml
from ...operators import recursive as rc
from ...operators import windows
from ...operators.frames import checkpoint
from ...sources import tables as tb
from . import register
from . import as_double as R

AIR = tb.with_views("panel_air")
W = "PARTITION BY station ORDER BY date"
CLASSES = ("BAIK", "SEDANG", "TIDAK SEHAT")
CENTRES = (30.0, 75.0, 120.0)
CENTRES_B = (40.0, 80.0, 110.0)
PROBS = ("prob_baik", "prob_sedang", "prob_tidak_sehat")


def _label(col="pm_sepuluh"):
    c = F.col(col)
    return F.when(c > 100, "TIDAK SEHAT").when(c > 50, "SEDANG").otherwise("BAIK")


_LABEL_SQL = "CASE WHEN pm_sepuluh > 100 THEN 'TIDAK SEHAT' WHEN pm_sepuluh > 50 THEN 'SEDANG' ELSE 'BAIK' END"


def _probs(centres, names=PROBS):
    s = [F.exp(-F.abs(F.col("pm_sepuluh") - F.lit(c)) / F.lit(25.0)) for c in centres]
    tot = s[0] + s[1] + s[2]
    return {n: x / tot for n, x in zip(names, s)}


def _probs_sql(centres, names=PROBS):
    s = [f"exp(-abs(pm_sepuluh - {c}) / 25.0)" for c in centres]
    tot = f"({s[0]} + {s[1]} + {s[2]})"
    return ", ".join(f"{x} / {tot} AS {n}" for n, x in zip(names, s))


def _argmax_sql(probs, classes=CLASSES, weights=(1.0, 1.0, 1.0)):
    """Arg-max with ties to the earlier class, as ``array_max`` over (p, -i) structs."""
    ws = [f"{p} * {w}" for p, w in zip(probs, weights)]
    tot = "(" + " + ".join(ws) + ")"
    ps = [f"({x}) / {tot}" for x in ws]
    return (f"CASE WHEN {ps[0]} >= {ps[1]} AND {ps[0]} >= {ps[2]} THEN '{classes[0]}' "
            f"WHEN {ps[1]} >= {ps[2]} THEN '{classes[1]}' ELSE '{classes[2]}' END")


def _features(spark, d):
    # a fit reads its rows again and again: the panel, which scans lineitem, is computed once
    a = checkpoint(tb.panel_air(spark, d).select("station", "date", "pm_sepuluh", "ozon", "sulfur_dioksida",
                                                 "nitrogen_dioksida", "karbon_monoksida"))
    a = windows.lags(a, ["pm_sepuluh"], [1, 7])
    a = a.withColumns({"month": F.month("date").cast("double"), "day_of_week": F.weekday("date").cast("double")})
    return a


FEATS = ["pm_sepuluh_lag_1d", "pm_sepuluh_lag_7d", "ozon", "sulfur_dioksida", "nitrogen_dioksida",
         "karbon_monoksida", "month", "day_of_week"]
CUT = "1999-12-31"


@register("ml1_gbt_regressor", None, note="fitted boosted trees: rows-only")
def ml1_gbt_regressor(spark, d):
    a = _features(spark, d).where(F.col("pm_sepuluh").isNotNull())
    train, test = ml.fill_features(a.where(F.col("date") <= F.lit(CUT).cast("date")),
                                   [a.where(F.col("date") > F.lit(CUT).cast("date"))], FEATS)
    model = ml.fit_regressor(train, FEATS, "pm_sepuluh", maxIter=30, maxDepth=5)
    return model.transform(test).select("station", "date", "pm_sepuluh", "pm_sepuluh_pred")


@register("ml2_persistence_metrics", AIR + f"""
, l AS (SELECT station, pm_sepuluh AS y, lag(pm_sepuluh, 1) OVER ({W}) AS p FROM panel_air)
SELECT station, count(*) AS n, {R('avg(abs(y - p))')} AS mae, {R('sqrt(avg((y - p) * (y - p)))')} AS rmse,
       {R('1.0 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0)')} AS r2
FROM l WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY station""")
def ml2_persistence_metrics(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh")
    a = windows.lags(a, ["pm_sepuluh"], [1], name="p")
    return ml.regression_metrics(a, "pm_sepuluh", "p", by=["station"])


@register("ml3_ml17_weighted_forest_probabilities", None, note="fitted forest: rows-only")
def ml3_ml17_weighted_forest_probabilities(spark, d):
    a = _features(spark, d).where(F.col("pm_sepuluh").isNotNull()).withColumn("kategori", _label())
    a = checkpoint(ml.balanced_weights(a, "kategori"))
    idx = StringIndexer(inputCol="kategori", outputCol="label", stringOrderType="alphabetAsc").fit(a)
    a = idx.transform(a)
    feats = [f for f in FEATS if f not in ("pm_sepuluh_lag_1d",)]
    train, test = ml.fill_features(a.where(F.col("date") <= F.lit(CUT).cast("date")),
                                   [a.where(F.col("date") > F.lit(CUT).cast("date"))], feats)
    model = ml.fit_classifier(train, feats, "label", numTrees=30)
    scored = model.transform(test)
    scored = ml.probability_columns(scored, list(idx.labels))
    pred = F.get(F.array(*[F.lit(x) for x in idx.labels]), F.col("prediction").cast("int"))
    return scored.select("station", "date", "kategori", pred.alias("predicted"),
                         *[f"prob_{c.lower().replace(' ', '_')}" for c in idx.labels])


@register("ml3_boosted_classes", None, note="fitted boosted trees per class: rows-only")
def ml3_boosted_classes(spark, d):
    """One weighted boosted model per class, probabilities normalised."""
    a = _features(spark, d).where(F.col("pm_sepuluh").isNotNull()).withColumn("kategori", _label())
    a = ml.balanced_weights(a, "kategori")
    feats = [f for f in FEATS if f not in ("pm_sepuluh_lag_1d",)]
    train, test = ml.fill_features(a.where(F.col("date") <= F.lit(CUT).cast("date")),
                                   [a.where(F.col("date") > F.lit(CUT).cast("date"))], feats)
    models = ml.fit_boosted_classes(checkpoint(train), feats, "kategori", CLASSES, maxIter=20, maxDepth=4)
    return ml.boosted_probabilities(test, models).select("station", "date", "kategori", "predicted", *PROBS)


@register("ml4_balanced_class_weights", AIR + f"""
, c AS (SELECT {_LABEL_SQL} AS kategori, count(*) AS nc FROM panel_air GROUP BY 1)
SELECT kategori, {R('(SELECT sum(nc) FROM c) / ((SELECT count(*) FROM c) * nc)')} AS weight FROM c""")
def ml4_balanced_class_weights(spark, d):
    a = tb.panel_air(spark, d).withColumn("kategori", _label())
    return ml.balanced_weights(a, "kategori").select("kategori", "weight").distinct()


@register("ml5_stratified_split_counts", AIR + f"""
, c AS (SELECT {_LABEL_SQL} AS kategori, count(*) AS n FROM panel_air GROUP BY 1)
SELECT kategori, 1 AS is_train, CAST(floor(n * 0.85) AS BIGINT) AS rows FROM c
UNION ALL SELECT kategori, 0, CAST(n - floor(n * 0.85) AS BIGINT) FROM c""")
def ml5_stratified_split_counts(spark, d):
    a = tb.panel_air(spark, d).withColumn("kategori", _label())
    s = ml.stratified_split(a, "kategori", ["station", "date"], 0.85)
    return s.groupBy("kategori", "is_train").agg(F.count(F.lit(1)).alias("rows"))


_PRED_SQL = f"""lab AS (SELECT station, date, {_LABEL_SQL} AS y FROM panel_air),
pr AS (SELECT station, date, y, lag(y, 1) OVER ({W}) AS p FROM lab),
ev AS (SELECT * FROM pr WHERE p IS NOT NULL)"""


def _pred_frame(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", _label().alias("y"))
    return windows.lags(a, ["y"], [1], name="p").where(F.col("p").isNotNull())


@register("ml6_ml18_classification_report", tb.with_views("panel_air", extra=_PRED_SQL) + f"""
, tp AS (SELECT y AS cls, count(*) AS support, count_if(y = p) AS tp FROM ev GROUP BY 1),
pc AS (SELECT p AS cls, count(*) AS predicted FROM ev GROUP BY 1),
r AS (SELECT coalesce(tp.cls, pc.cls) AS cls, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
             coalesce(predicted, 0) AS predicted FROM tp FULL JOIN pc ON tp.cls = pc.cls)
SELECT cls, {R('tp / nullif(predicted, 0)')} AS precision, {R('tp / nullif(support, 0)')} AS recall,
       {R('2 * (tp / nullif(predicted, 0)) * (tp / nullif(support, 0)) / nullif(tp / nullif(predicted, 0) + tp / nullif(support, 0), 0)')} AS f1,
       CAST(support AS BIGINT) AS support, {R('(SELECT avg(CAST(y = p AS DOUBLE)) FROM ev)')} AS accuracy FROM r""")
def ml6_ml18_classification_report(spark, d):
    return ml.classification_report(_pred_frame(spark, d), "y", "p")


@register("ml6_confusion_matrix", tb.with_views("panel_air", extra=_PRED_SQL) + "SELECT y, " + ", ".join(
    f"CAST(count_if(p = '{c}') AS BIGINT) AS \"{c}\"" for c in CLASSES) + " FROM ev GROUP BY y")
def ml6_confusion_matrix(spark, d):
    return ml.confusion(_pred_frame(spark, d), "y", "p", CLASSES)


@register("ml7_feature_importance", None, note="fitted model importances: rows-only")
def ml7_feature_importance(spark, d):
    a = _features(spark, d).where(F.col("pm_sepuluh").isNotNull() & F.col("pm_sepuluh_lag_1d").isNotNull())
    (a,) = ml.fill_features(a, [], FEATS)
    model = ml.fit_regressor(a, FEATS, "pm_sepuluh", maxIter=10, maxDepth=4)
    rank, share = ml.feature_importance(model, FEATS)
    return rank.join(share, "family")


@register("ml8_multi_target_regressors", None, note="fitted boosted trees: rows-only")
def ml8_multi_target_regressors(spark, d):
    a = _features(spark, d).where(F.col("pm_sepuluh_lag_7d").isNotNull())
    train, test = ml.fill_features(a.where(F.col("date") <= F.lit(CUT).cast("date")),
                                   [a.where(F.col("date") > F.lit(CUT).cast("date"))], FEATS)
    models = ml.fit_regressors(train, FEATS, ["ozon", "nitrogen_dioksida"], maxIter=10, maxDepth=4)
    out = test.select("station", "date")
    for t, m in models.items():
        out = out.join(m.transform(test).select("station", "date", f"{t}_pred"), ["station", "date"])
    return out


_FUTURE_SQL = """mx AS (SELECT max(date) AS d1 FROM panel_air),
fut AS (SELECT s.station, CAST(unnest(generate_series(m.d1 + 1, m.d1 + 30, INTERVAL 1 DAY)) AS DATE) AS date
        FROM (SELECT DISTINCT station FROM panel_air) s, mx m)"""


@register("ml9_persistence_forecast_frame", tb.with_views("panel_air", extra=_FUTURE_SQL) + f"""
SELECT f.station, f.date, CAST(month(f.date) AS INTEGER) AS month, CAST(isodow(f.date) - 1 AS INTEGER) AS day_of_week,
       CAST(quarter(f.date) AS INTEGER) AS quarter, CAST(dayofyear(f.date) AS INTEGER) AS day_of_year,
       CAST(dense_rank() OVER (ORDER BY f.station) - 1 AS INTEGER) AS station_encoded,
       {R('sin(2 * pi() * month(f.date) / 12.0)')} AS month_sin, {R('cos(2 * pi() * month(f.date) / 12.0)')} AS month_cos,
       {R('l.pm_sepuluh')} AS pm_sepuluh, {R('l.ozon')} AS ozon
FROM fut f LEFT JOIN (SELECT station, pm_sepuluh, ozon FROM panel_air
                      QUALIFY row_number() OVER (PARTITION BY station ORDER BY date DESC) = 1) l ON f.station = l.station""")
def ml9_persistence_forecast_frame(spark, d):
    from ...operators import joins as jn
    a = tb.panel_air(spark, d)
    _, d1 = dz.date_bounds(a)
    fut = dz.date_skeleton(a.select("station"), d1 + _dt.timedelta(days=1), d1 + _dt.timedelta(days=30))
    ms, mc = dtf.cyclical(F.month("date"), 12)
    fut = enc.label_encode(fut, "station")
    fut = fut.select("station", "date", F.month("date").alias("month"), F.weekday("date").alias("day_of_week"),
                     F.quarter("date").alias("quarter"), F.dayofyear("date").alias("day_of_year"), "station_encoded",
                     ms.alias("month_sin"), mc.alias("month_cos"))
    return jn.last_known_row(a, fut, ["pm_sepuluh", "ozon"])


@register("ml10_recursive_forecast", None, note="recursive forecast of a boosted model: rows-only; its state has SQL below")
def ml10_recursive_forecast(spark, d):
    """91 days by a boosted model of the survey's settings, on lags, rolling state and the calendar."""
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh").where(F.col("pm_sepuluh").isNotNull())
    h = rc.History()
    feats = h.names(["pm_sepuluh"]) + rc.CALENDAR
    train = checkpoint(rc.recursive_features(a, ["pm_sepuluh"], h).na.drop())
    model = ml.fit_regressor(train, feats, "pm_sepuluh", maxIter=100, maxDepth=6, stepSize=0.1)
    return rc.recursive_forecast(a, {"pm_sepuluh": model}, 91, h)


# A rule of fixed weights in place of a model; steps of 1/16 keep all sums exact, so that every engine gets the same doubles.
_RULE = "floor(({l1} * 0.5 + {l7} * 0.125 + {m7} * 0.25 + {m30} * 0.125 + {month} % 2 + {dow} * 0.25) * 16) / 16"


@register("ml10_recursive_state", tb.with_views("panel_orders").replace("WITH ", "WITH RECURSIVE ", 1) + """
, h AS (SELECT station, max(date) AS date, list(n_orders::DOUBLE ORDER BY date) AS v FROM (
          SELECT * FROM panel_orders QUALIFY row_number() OVER (PARTITION BY station ORDER BY date DESC) <= 30) t GROUP BY station),
r AS (SELECT station, date, v, 0 AS i FROM h
      UNION ALL
      SELECT station, CAST(date + INTERVAL 1 DAY AS DATE), list_append(v, """ + _RULE.format(
    l1="v[-1]", l7="v[-7]", m7="list_avg(v[-7:])", m30="list_avg(v[-30:])", month="month(date + INTERVAL 1 DAY)",
    dow="(isodow(date + INTERVAL 1 DAY) - 1)") + """)[-30:], i + 1 FROM r WHERE i < 91)
SELECT station, date, CAST(v[-1] AS DOUBLE) AS n_orders FROM r WHERE i > 0""")
def ml10_recursive_state(spark, d):
    """The rolling state over 91 steps, driven by a rule that SQL can follow."""
    from pyspark.ml.feature import SQLTransformer
    p = tb.panel_orders(spark, d).select("station", "date", F.col("n_orders").cast("double").alias("n_orders"))
    rule = SQLTransformer(statement="SELECT *, " + _RULE.format(
        l1="n_orders_lag_1", l7="n_orders_lag_7", m7="n_orders_rolling_7", m30="n_orders_rolling_30", month="month(date)",
        dow="weekday(date)") + " AS n_orders_pred FROM __THIS__")
    return rc.recursive_forecast(p, {"n_orders": rule}, 91)


@register("ml11_drift_correction", tb.with_views("panel_air", extra=_FUTURE_SQL) + f"""
, hm AS (SELECT station, avg(pm_sepuluh) AS m FROM panel_air GROUP BY 1),
last AS (SELECT station, pm_sepuluh AS v FROM panel_air QUALIFY row_number() OVER (PARTITION BY station ORDER BY date DESC) = 1),
x AS (SELECT f.station, f.date, l.v * 1.2 AS pred, date_diff('day', (SELECT d1 FROM mx), f.date) - 1 AS i, hm.m
      FROM fut f JOIN last l ON f.station = l.station JOIN hm ON f.station = hm.station)
SELECT station, date, {R('CASE WHEN i = 0 THEN pred ELSE pred + least(0.1 + 0.005 * i, 0.3) * (m - pred) END')} AS pm_sepuluh
FROM x""")
def ml11_drift_correction(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh")
    _, d1 = dz.date_bounds(a)
    fut = dz.date_skeleton(a.select("station"), d1 + _dt.timedelta(days=1), d1 + _dt.timedelta(days=30))
    last = windows.latest_row(a).select("station", (F.col("pm_sepuluh") * 1.2).alias("pred"))
    hm = a.groupBy("station").agg(F.avg("pm_sepuluh").alias("m"))
    x = fut.join(last, "station").join(hm, "station").withColumn("i", F.datediff("date", F.lit(d1)) - 1)
    return x.select("station", "date", ml.drift_correct(F.col("pred"), F.col("i"), F.col("m")).alias("pm_sepuluh"))


# Draws from a digest, so that SQL can make the same: uniform in [-1, 1).
_DRAW_SQL = "(CAST('0x' || substr(md5(f.station || CAST(f.date AS VARCHAR)), 1, 8) AS BIGINT) / 2147483648.0 - 1)"


@register("ml11_drift_correction_with_noise", tb.with_views("panel_air", extra=_FUTURE_SQL) + f"""
, hm AS (SELECT station, avg(pm_sepuluh) AS m, stddev_samp(pm_sepuluh) AS s FROM panel_air GROUP BY 1),
last AS (SELECT station, pm_sepuluh AS v FROM panel_air QUALIFY row_number() OVER (PARTITION BY station ORDER BY date DESC) = 1),
x AS (SELECT f.station, f.date, l.v * 1.2 AS pred, date_diff('day', (SELECT d1 FROM mx), f.date) - 1 AS i, hm.m, hm.s, {_DRAW_SQL} AS e
      FROM fut f JOIN last l ON f.station = l.station JOIN hm ON f.station = hm.station)
SELECT station, date, {R('CASE WHEN i = 0 THEN pred + e * s * 0.05 ELSE pred + least(0.1 + 0.005 * i, 0.3) * (m - pred) + e * s * 0.1 END')} AS pm_sepuluh
FROM x""")
def ml11_drift_correction_with_noise(spark, d):
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh")
    _, d1 = dz.date_bounds(a)
    fut = dz.date_skeleton(a.select("station"), d1 + _dt.timedelta(days=1), d1 + _dt.timedelta(days=30))
    last = windows.latest_row(a).select("station", (F.col("pm_sepuluh") * 1.2).alias("pred"))
    hm = a.groupBy("station").agg(F.avg("pm_sepuluh").alias("m"), F.stddev_samp("pm_sepuluh").alias("s"))
    x = fut.join(last, "station").join(hm, "station").withColumn("i", F.datediff("date", F.lit(d1)) - 1)
    digest = F.md5(F.concat("station", F.col("date").cast("string")).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2147483648.0 - 1
    return x.select("station", "date", ml.drift_correct(F.col("pred"), F.col("i"), F.col("m"), draw, F.col("s")).alias("pm_sepuluh"))


_AR_SQL = f"""h AS (SELECT station, date, price_avg AS v FROM panel_orders
               WHERE price_avg IS NOT NULL),
d1 AS (SELECT *, v - lag(v, 1) OVER ({W}) AS dd FROM h),
d2 AS (SELECT *, lag(dd, 1) OVER ({W}) AS dp FROM d1),
fit AS (SELECT station, regr_slope(dd, dp) AS b, regr_intercept(dd, dp) AS a, count(v) AS n, avg(v) AS mean,
               arg_max(v, date) AS last, max(date) AS t0, arg_max(dd, date) AS d0 FROM d2 GROUP BY 1),
l10 AS (SELECT station, avg(v) AS m10 FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY station ORDER BY date DESC) <= 10) t GROUP BY 1),
g AS (SELECT avg(v) AS g FROM h),
hz AS (SELECT s.station, CAST(unnest(generate_series(DATE '2001-08-02', DATE '2001-08-31', INTERVAL 1 DAY)) AS DATE) AS date
       FROM (SELECT DISTINCT station FROM panel_orders) s),
j AS (SELECT hz.station, hz.date, fit.*, l10.m10, g.g, CAST(date_diff('day', fit.t0, hz.date) AS DOUBLE) AS hh,
             coalesce(fit.d0, 0.0) AS dz
      FROM hz LEFT JOIN fit ON hz.station = fit.station LEFT JOIN l10 ON hz.station = l10.station, g),
k AS (SELECT *, (1.0 - pow(b, hh)) / nullif(1.0 - b, 0) AS geo FROM j)"""


@register("ml12_ar1_fallback_forecast", tb.with_views("panel_orders", extra=_AR_SQL) + f"""
SELECT station, date,
  {R('''CASE WHEN n IS NULL THEN g WHEN n < 10 THEN mean WHEN b IS NULL OR abs(b) >= 1 THEN m10
            ELSE last + (a * ((hh - b * geo) / nullif(1.0 - b, 0)) + dz * b * geo) END''')} AS price_avg,
  CASE WHEN n IS NULL THEN 'global_mean' WHEN n < 10 THEN 'series_mean' WHEN b IS NULL OR abs(b) >= 1 THEN 'last10_mean'
       ELSE 'ar1' END AS method
FROM k""")
def ml12_ar1_fallback_forecast(spark, d):
    p = tb.panel_orders(spark, d).select("station", "date", "price_avg").where(F.col("price_avg").isNotNull())
    stations = tb.panel_orders(spark, d).select("station")
    hz = dz.date_skeleton(stations, "2001-08-02", "2001-08-31")
    return ml.ar1_forecast(p, hz, "price_avg")


_SCEN = {"s1": (1.0, 1.0, 1.0), "s2": (2.0, 0.5, 1.5), "s3": (3.0, 0.3, 2.0)}


@register("ml13_threshold_adjusted_prediction", AIR + f"""
, p AS (SELECT station, date, {_probs_sql(CENTRES)} FROM panel_air WHERE pm_sepuluh IS NOT NULL)
SELECT station, date, """ + ", ".join(f"{_argmax_sql(PROBS, weights=w)} AS pred_{k}" for k, w in _SCEN.items())
    + " FROM p")
def ml13_threshold_adjusted_prediction(spark, d):
    a = tb.panel_air(spark, d).where(F.col("pm_sepuluh").isNotNull())
    a = a.select("station", "date", *[v.alias(k) for k, v in _probs(CENTRES).items()])
    return a.select("station", "date", *[ml.threshold_adjust(PROBS, w, CLASSES).alias(f"pred_{k}")
                                         for k, w in _SCEN.items()])


@register("ml14_minority_oversampling", None, note="synthetic rows of seeded draws: rows-only; the neighbours have SQL below")
def ml14_minority_oversampling(spark, d):
    a = _features(spark, d).na.drop().withColumn("kategori", _label())
    counts = {r["kategori"]: r["count"] for r in a.groupBy("kategori").count().collect()}
    minority = min(counts, key=counts.get)
    needed = max(counts.values()) - counts[minority]
    feats = ["ozon", "sulfur_dioksida", "nitrogen_dioksida", "pm_sepuluh_lag_1d"]
    return ml.oversample_minority(a, feats, "kategori", minority, needed)


@register("ml14_exact_neighbours", tb.with_views("points") + """
, f AS (SELECT vec_id, x, y FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance
      FROM f a JOIN f b ON a.vec_id <> b.vec_id)
SELECT id, neighbour, distance, CAST(nr AS INTEGER) AS nr
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS nr FROM d) t WHERE nr <= 2""")
def ml14_exact_neighbours(spark, d):
    """The two nearest other points of every point."""
    from ...operators.neighbours import nearest_neighbours
    p = tb.points(spark, d).select(F.col("vec_id").cast("long").alias("vec_id"), "x", "y")
    n = nearest_neighbours(p, "vec_id", ["x", "y"], 2, cell_rows=64)
    return n.select(F.col("_a").alias("id"), F.col("_b").alias("neighbour"), F.col("_dist").alias("distance"), F.col("_nr").alias("nr"))


_PB = tuple(p + "_b" for p in PROBS)


@register("ml15_soft_voting", AIR + f"""
, p AS (SELECT station, date, {_probs_sql(CENTRES)}, {_probs_sql(CENTRES_B, _PB)} FROM panel_air
        WHERE pm_sepuluh IS NOT NULL)
SELECT station, date, """ + ", ".join(f"{R(f'({a} + {b}) / 2.0')} AS {a}" for a, b in zip(PROBS, _PB)) + " FROM p")
def ml15_soft_voting(spark, d):
    a = tb.panel_air(spark, d).where(F.col("pm_sepuluh").isNotNull())
    a = a.select("station", "date", *[v.alias(k) for k, v in _probs(CENTRES).items()],
                 *[v.alias(k) for k, v in _probs(CENTRES_B, _PB).items()])
    avg = ml.soft_vote([PROBS, _PB])
    return a.select("station", "date", *[c.alias(n) for c, n in zip(avg, PROBS)])


@register("ml15_fitted_voters", None, note="three fitted classifiers: rows-only")
def ml15_fitted_voters(spark, d):
    """Boosted class models, a forest and a logistic model, fitted on the same weighted rows; their probabilities averaged."""
    a = _features(spark, d).where(F.col("pm_sepuluh").isNotNull()).withColumn("kategori", _label())
    a = ml.balanced_weights(a, "kategori")
    feats = [f for f in FEATS if f not in ("pm_sepuluh_lag_1d",)]
    train, test = ml.fill_features(a.where(F.col("date") <= F.lit(CUT).cast("date")),
                                   [a.where(F.col("date") > F.lit(CUT).cast("date"))], feats)
    voters = ml.fit_voters(checkpoint(train), feats, "kategori", CLASSES, boosted={"maxIter": 10, "maxDepth": 4}, trees=30)
    return ml.vote(test, voters, CLASSES).select("station", "date", "kategori", "predicted", *PROBS)


@register("ml16_category_confidence_summary", AIR + f"""
, p AS (SELECT station, date, {_probs_sql(CENTRES)} FROM panel_air WHERE pm_sepuluh IS NOT NULL),
c AS (SELECT {_argmax_sql(PROBS)} AS category, greatest(prob_baik, prob_sedang, prob_tidak_sehat) AS confidence FROM p)
SELECT 'softmax' AS method, category, count(*) AS n, {R('avg(confidence)')} AS mean_confidence FROM c GROUP BY 2""")
def ml16_category_confidence_summary(spark, d):
    a = tb.panel_air(spark, d).where(F.col("pm_sepuluh").isNotNull())
    a = a.select(*[v.alias(k) for k, v in _probs(CENTRES).items()])
    cat, conf = ml.attach_category(PROBS, CLASSES)
    x = a.select(cat.alias("category"), conf.alias("confidence"))
    return x.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence")) \
            .select(F.lit("softmax").alias("method"), "category", "n", "mean_confidence")
