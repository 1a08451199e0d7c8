"""Ties, hot groups, sub-daily series, long horizons and values of any size pass through unchanged."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import fills, spatial, windows
from panelcast.operators.frames import SeriesFrame
from panelcast.operators.quantiles import kth_smallest, quantiles
from panelcast.plans import flows
from panelcast.plans.catalog import REGISTRY, register


def test_quantiles_with_four_fifths_ties_and_a_hot_group(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 50}", 0.0 if r.random() < 0.8 else r.gauss(0, 1e6)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]
    got = {x["g"]: x for x in quantiles(df, "x", probs, by=["g"]).collect()}
    for g in got:
        own = [x for k, x in rows if k == g]
        for p in probs:
            assert got[g][f"x_q{p}"] == pytest.approx(float(np.quantile(own, p)), rel=1e-12, abs=1e-9)
    one = quantiles(df, "x", probs).first()
    assert one["x_q0.9"] == pytest.approx(float(np.quantile([x for _, x in rows], 0.9)), rel=1e-12)


def test_quantile_plan_has_no_nested_loop_over_data(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    for q in (quantiles(df, ["x", "y"], [0.5], by=["k"]), quantiles(df, "x", [0.5])):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_kth_smallest_keeps_all_64_bits(spark):
    base = (1 << 62) + 1
    df = spark.createDataFrame([("a", base + i) for i in range(100)], "g string, h long")
    assert kth_smallest(df, "h", ["g"], 42, out="k").first()["k"] == base + 41


def test_hourly_forward_fill_follows_the_hours(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h), float(h) if h in (3, 9) else None) for h in range(30)]
    df = spark.createDataFrame(rows, "station string, at timestamp, v double")
    got = {x["at"].day * 24 + x["at"].hour - 24: x["v"] for x in fills.ffill(df, "v", SeriesFrame(("station",), "at")).collect()}
    assert [got[h] for h in range(30)] == [None] * 3 + [3.0] * 6 + [9.0] * 21


def test_five_thousand_rows_on_one_station_day(spark):
    day = spark.range(5000).select(F.lit("DKI1").alias("station"), F.lit("2024-01-01").cast("date").alias("date"),
                                   F.lit("BAIK").alias("kategori"), F.col("id").alias("_ingest"),
                                   F.when(F.col("id") == 4999, 2.0).otherwise(1.0).alias("pm_sepuluh"))
    nxt = spark.createDataFrame([("DKI1", dt.date(2024, 1, 2), "BAIK", 9000, None)],
                                "station string, date date, kategori string, _ingest long, pm_sepuluh double")
    out = flows.clean_air_quality(day.unionByName(nxt), ["pm_sepuluh"]).orderBy("date").collect()
    assert [x["pm_sepuluh"] for x in out] == [pytest.approx(5001 / 5000), 2.0]


def test_registered_results_are_exact_doubles(spark):
    values = [1e-5, math.inf, 1e16, -1e-12]

    @register("exact_doubles_probe")
    def probe(s, d):
        return s.createDataFrame([(v,) for v in values], "v double")

    try:
        assert [r["v"] for r in REGISTRY["exact_doubles_probe"].build(spark, "").collect()] == values
    finally:
        del REGISTRY["exact_doubles_probe"]


def test_noise_over_twenty_thousand_steps(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("s").alias("station"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                               (F.sin(F.col("id").cast("double")) * 2).alias("draw"))
    got = windows.mean_reverting_noise(df, F.col("draw"), F.lit(0.5)).orderBy("date").collect()
    v, want = 0.0, []
    for i in range(n):
        v = 0.0 if i == 0 else 0.9 * v + 0.5 * 2 * math.sin(float(i))
        want.append(v)
    assert np.allclose([x["noise"] for x in got], want, rtol=1e-9, atol=1e-12)


def test_nearest_region_with_a_far_outlier_and_without_edges(spark):
    edges = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 0.0), ("a", 1.0, 0.0, 1.0, 1.0), ("b", 9.0, 9.0, 10.0, 9.0), ("b", 10.0, 9.0, 10.0, 10.0)],
                                  "region string, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 0.5, 0.4), (2, 1e7, 1e7), (3, -500.0, 3.0), (4, 5.4, 5.4)], "id long, x double, y double")
    got = {r["id"]: (r["region"], r["distance"]) for r in spatial.nearest(pts, edges).collect()}
    assert got[1][0] == "a" and got[2][0] == "b" and got[3][0] == "a" and got[4][0] == "b"
    assert got[2][1] == pytest.approx(math.hypot(1e7 - 10, 1e7 - 10))
    assert spatial.nearest(pts, edges.limit(0)).count() == 0 and spatial.within(pts, edges.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 7, 300])
def test_quantile_ranges_are_split_until_each_is_small(spark, monkeypatch, most):
    """One global group and a skewed one, with clustered values, refined over several rounds: exact, and never over the bound."""
    from panelcast.operators import quantiles as qt
    r = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 4}", r.choice([r.gauss(0, 1e-9), r.random() * 1e9, float(r.randint(0, 5)), -1.5])) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, x double")
    monkeypatch.setattr(qt, "RANKED_ROWS", most)
    monkeypatch.setattr(qt, "GRID", 15)
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = qt.quantiles(df, "x", probs).first()
    want = np.quantile([x for _, x in rows], probs)
    assert [got[f"x_q{p}"] for p in probs] == pytest.approx(list(want), rel=1e-12, abs=1e-18)
    by = {q["g"]: q for q in qt.quantiles(df, "x", [0.5, 0.9], by=["g"]).collect()}
    for g, q in by.items():
        own = [x for k, x in rows if k == g]
        assert [q["x_q0.5"], q["x_q0.9"]] == pytest.approx(list(np.quantile(own, [0.5, 0.9])), rel=1e-12, abs=1e-18)
    kth = {q["g"]: q["kth"] for q in qt.kth_smallest(df, "x", ["g"], F.floor(F.col("n") * 0.3)).collect()}
    for g, v in kth.items():
        own = sorted(x for k, x in rows if k == g)
        assert v == own[int(len(own) * 0.3) - 1]
