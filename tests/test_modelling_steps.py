"""Recursive forecasts, boosted classes and fallback forecasts against plain Python."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from panelcast.operators import modelling as ml
from panelcast.operators import recursive as rc

D0 = dt.date(2021, 1, 1)


def panel(spark, days=120, seed=1):
    r = random.Random(seed)
    rows = []
    for s, n in (("S1", days), ("S2", days), ("S3", 2)):  # S3 is shorter than every width but one
        for i in range(n):
            if r.random() < 0.8 or n < 5:
                rows.append((s, D0 + dt.timedelta(days=i), 1000 + 20 * math.sin(i / 5) + r.gauss(0, 3), max(0.0, r.gauss(5, 4)), ord(s[1]) * 1.0))
    rows.append(("S1", D0 + dt.timedelta(days=days + 3), None, 1.0, 49.0))
    return spark.createDataFrame(rows, "station string, date date, a double, b double, code double"), rows


def plain_features(values, h):
    out = []
    for k in h.lags:
        out.append(values[-k] if len(values) >= k else None)
    for n in h.means:
        out.append(statistics.fmean(values[-n:]) if values else None)
    for n in h.stds:
        out.append(statistics.stdev(values[-n:]) if len(values[-n:]) > 1 else None)
    return out


def test_training_features_equal_plain_python(spark):
    df, rows = panel(spark)
    h = rc.History((1, 7), (3, 7), (3,))
    got = rc.recursive_features(df.dropna(subset=["a"]), ["a"], h).collect()
    for q in got:
        past = [v for s, d, v, _, _ in sorted(rows, key=lambda x: x[1]) if s == q.station and d < q.date and v is not None]
        for name, want in zip(h.names(["a"]), plain_features(past, h)):
            assert q[name] == (pytest.approx(want, rel=1e-9, abs=1e-9) if want is not None else None)
        assert q.month_sin == pytest.approx(math.sin(2 * math.pi * q.date.month / 12))


def test_forecast_of_91_days_equals_a_step_by_step_recomputation(spark):
    """The rolling state against features made anew from the whole history at every step, with tree models."""
    df, rows = panel(spark)
    h = rc.History((1, 3, 30), (3, 30), (3, 7))
    targets = ["a", "b"]
    feats = h.names(targets) + rc.CALENDAR + ["code"]
    train = rc.recursive_features(df.dropna(subset=targets), targets, h).na.drop().coalesce(2).cache()
    models = {t: Pipeline(stages=[ml.assemble(feats), GBTRegressor(featuresCol="features", labelCol=t, predictionCol=f"{t}_pred",
                                                                  maxIter=3, maxDepth=3, seed=1)]).fit(train) for t in targets}
    fill = {f: 7.0 for f in feats}
    got = {(q.station, q.date): q for q in rc.recursive_forecast(df, models, 91, h, static=["code"], fill=fill, checkpoint_every=6).collect()}
    assert len(got) == 3 * 91
    known = [x for x in rows if x[2] is not None and x[3] is not None]
    assert min(d for _, d in got) == D0 + dt.timedelta(days=2)
    # every predicted day's features anew from history and the predictions before it, then the models once over all of them
    asked = []
    for s in ("S1", "S2", "S3"):
        past = {t: [x[2 + i] for x in sorted(known, key=lambda x: x[1]) if x[0] == s] for i, t in enumerate(targets)}
        day = max(x[1] for x in known if x[0] == s)
        for _ in range(91):
            day += dt.timedelta(days=1)
            made = [v if v is not None else 7.0 for t in targets for v in plain_features(past[t], h)]
            asked.append((s, day, *made, ord(s[1]) * 1.0))
            for t in targets:
                past[t].append(got[(s, day)][t])
    x = spark.createDataFrame(asked, "station string, date date, " + ", ".join(f"{n} double" for n in h.names(targets)) + ", code double")
    x = x.withColumns(rc.calendar_features("date"))
    for t, m in models.items():
        x = m.transform(x).drop("features")
    for q in x.collect():
        for t in targets:
            assert got[(q.station, q.date)][t] == pytest.approx(max(q[f"{t}_pred"], 0.0), rel=1e-9)


def test_boosted_classes_are_the_normalised_class_models(spark):
    r = random.Random(2)
    rows = [(i, r.gauss(0, 1) + 3 * (i % 3), r.gauss(0, 1) - 2 * (i % 3), ["x", "y y", "z"][i % 3]) for i in range(300)]
    df = ml.balanced_weights(spark.createDataFrame(rows, "i int, f double, g double, label string"), "label").coalesce(2).cache()
    models = ml.fit_boosted_classes(df, ["f", "g"], "label", ["x", "y y", "z", "never"], maxIter=4, maxDepth=3, subsamplingRate=1.0)
    assert models["never"] == 0
    got = {q.i: q for q in ml.boosted_probabilities(df, models).collect()}
    assert len(got) == 300 and sum(q.predicted == q.label for q in got.values()) > 270
    alone = {c: {q.i: q.probability[1] for q in models[c].transform(df).collect()} for c in ("x", "y y", "z")}
    for i, q in got.items():
        total = sum(alone[c][i] for c in alone)
        for c, name in (("x", "prob_x"), ("y y", "prob_y_y"), ("z", "prob_z")):
            assert q[name] == pytest.approx(alone[c][i] / total)
        assert q.prob_never == 0 and q.prob_x + q.prob_y_y + q.prob_z == pytest.approx(1)


def test_votes_are_the_means_of_three_fitted_models(spark):
    r = random.Random(7)
    rows = [(i, r.gauss(0, 1) + 3 * (i % 3), r.gauss(0, 1), ["x", "y y", "z"][i % 3]) for i in range(240)]
    classes = ["x", "y y", "z", "never"]
    df = ml.balanced_weights(spark.createDataFrame(rows, "i int, f double, g double, label string"), "label").coalesce(2).cache()
    voters = ml.fit_voters(df, ["f", "g"], "label", classes, boosted={"maxIter": 3, "maxDepth": 3, "subsamplingRate": 1.0}, trees=5)
    got = ml.vote(df, voters, classes).collect()
    assert len(got) == 240 and sum(q.predicted == q.label for q in got) > 200
    for q in got:
        for c in ("x", "y_y", "z", "never"):
            each = [q[f"{m}_prob_{c}"] for m in ("boosted", "forest", "logistic")]
            assert q[f"prob_{c}"] == pytest.approx(sum(each) / 3)
        assert q.prob_x + q.prob_y_y + q.prob_z + q.prob_never == pytest.approx(1) and q.prob_never < 0.05


def test_ar1_falls_back_step_by_step(spark):
    """No history: mean of all; under ten values: the series' mean; no fit: mean of the last ten."""
    r = random.Random(3)
    rows = [("ar", D0 + dt.timedelta(days=i), 10 + r.gauss(0, 1)) for i in range(60)]
    rows += [("few", D0 + dt.timedelta(days=i), float(i)) for i in range(5)]
    rows += [("flat", D0 + dt.timedelta(days=i), 4.0) for i in range(30)]
    h = spark.createDataFrame(rows, "station string, date date, v double")
    hz = spark.createDataFrame([(s, D0 + dt.timedelta(days=70)) for s in ("ar", "few", "flat", "none")], "station string, date date")
    got = {q.station: q for q in ml.ar1_forecast(h, hz, "v").collect()}
    assert {s: q.method for s, q in got.items()} == {"ar": "ar1", "few": "series_mean", "flat": "last10_mean", "none": "global_mean"}
    assert got["few"].v == 2.0 and got["flat"].v == 4.0 and got["none"].v == pytest.approx(statistics.fmean(v for _, _, v in rows))


def test_models_read_a_settled_panel(spark, tmp_path):
    """A fit's many passes read the panel, not the tables it comes from."""
    from panelcast.plans.catalog.modelling import _features

    r = random.Random(7)
    lines = [(i % 10, dt.datetime(1999, 12, 1) + dt.timedelta(days=r.randrange(60)), float(r.randint(1, 50)), r.randint(0, 10) / 100, r.randint(0, 8) / 100, r.uniform(900, 9000))
             for i in range(3000)]
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_discount double, l_tax double, l_extendedprice double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i) for i in range(10)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, i % 5) for i in range(10)], "n_nationkey long, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    a = _features(spark, str(tmp_path))
    assert a.inputFiles() == []
    rows = {(x.station, x.date): x for x in a.collect()}
    assert len(rows) == len({(x[0] % 5, x[1]) for x in lines})
    for (s, d), x in rows.items():
        own = sorted(k[1] for k in rows if k[0] == s)
        at = own.index(d)
        assert x.pm_sepuluh_lag_1d == (rows[s, own[at - 1]].pm_sepuluh if at >= 1 else None)
        assert x.pm_sepuluh_lag_7d == (rows[s, own[at - 7]].pm_sepuluh if at >= 7 else None)
