"""Quantiles, joins, densify and schema helpers on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.operators import densify, joins, schema
from panelcast.operators.frames import assert_unique
from panelcast.operators.quantiles import kth_smallest, quantiles


def test_quantiles_exact(spark):
    df = spark.range(0, 20000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 10007 / 3.0).alias("x"))
    probs = [0.001, 0.25, 0.5, 0.9, 0.999]
    got = quantiles(df, ["x"], probs, by=["g"]).orderBy("g").collect()
    ref = df.groupBy("g").agg(*[F.percentile("x", p).alias(str(p)) for p in probs]).orderBy("g").collect()
    for a, b in zip(got, ref):
        for p in probs:
            assert abs(a[f"x_q{p}"] - b[str(p)]) < 1e-9
    k = kth_smallest(df, "x", ["g"], F.floor(F.col("n") * 0.5)).orderBy("g").collect()
    assert len(k) == 3


def test_asof_reindex_takes_global_dates(spark):
    obs = spark.createDataFrame([("A", dt.date(2020, 1, 2), 1.0), ("B", dt.date(2020, 1, 3), 2.0),
                                 ("A", dt.date(2020, 1, 5), 3.0)], "station string, date date, v double")
    sk = densify.date_skeleton(obs.select("station"), "2020-01-01", "2020-01-06")
    got = {(r.station, r.date.day): r.v for r in joins.asof_reindex(obs, sk, ["v"]).collect()}
    # A on day 4: last obs date overall is day 3, where A is NULL -> bfill from day 5
    assert got[("A", 4)] == 3.0 and got[("A", 1)] == 1.0 and got[("B", 6)] is None and got[("B", 2)] == 2.0


def test_assert_unique_raises(spark):
    df = spark.createDataFrame([("A", 1), ("A", 1)], "station string, d int")
    with pytest.raises(ValueError):
        assert_unique(df, ["station", "d"])


def test_densify_expected_rows(spark):
    p = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0), ("B", dt.date(2020, 1, 4), 2.0)],
                              "station string, date date, v double")
    assert densify.densify_panel(p).count() == 8


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`t (°C)` double, `w (km/h)` double")
    assert schema.strip_units(df).columns == ["t", "w"]
    with pytest.raises(ValueError):
        schema.first_present(df, ["lat", "latitude"], "lintang")
    assert schema.drop_dominant(["x_rolling_1", "x_lag_7", "y"], "x", keep=["x_lag_7"]) == ["x_lag_7", "y"]


def test_oversample_exact_count(spark):
    from panelcast.operators.modelling import oversample_minority
    df = spark.range(0, 300).select((F.col("id") % 17).cast("double").alias("a"),
                                    (F.col("id") % 5).cast("double").alias("b"),
                                    F.when(F.col("id") % 10 == 0, "min").otherwise("maj").alias("y"))
    out = oversample_minority(df, ["a", "b"], "y", "min", 47)
    assert out.count() == 47
    assert out.where("y <> 'min'").count() == 0


def test_wide_correlations_equal_pairwise_complete_ones(spark):
    import random

    import numpy as np

    from panelcast.operators import widecorr
    r = random.Random(4)
    rows = []
    for i in range(400):
        a = r.gauss(1e6, 1)
        rows.append((a if r.random() < 0.8 else None, a + r.gauss(0, 2) if r.random() < 0.7 else None, 5.0, 1.0 if i < 20 else None,
                     float("inf") if i == 3 else r.random()))
    cols = ["a", "b", "flat", "few", "odd"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    got = {q.feature: q for q in widecorr.corr_matrix_wide(df, cols, ["a", "b"]).collect()}
    x = np.array([[np.nan if v is None or np.isinf(v) else v for v in row] for row in rows])
    for i, f in enumerate(cols):
        for j, t in enumerate(["a", "b"]):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if f in ("flat", "few"):
                assert got[f][t] is None
            else:
                assert abs(got[f][t] - np.corrcoef(x[ok, i], x[ok, j])[0, 1]) < 1e-9
    none = widecorr.corr_matrix_wide(df.limit(0), cols, ["a"]).collect()
    assert [tuple(q) for q in none] == [(c, None) for c in cols]


@pytest.mark.parametrize("cell_rows, k", [(5, 2), (40, 3), (10_000, 2)])
def test_exact_neighbours_equal_brute_force(spark, cell_rows, k):
    """Clusters, far outliers, many copies of one position, ties on a grid, missing features."""
    import random

    from panelcast.operators.neighbours import nearest_neighbours
    r = random.Random(6)
    pts = [(r.gauss(0, 1e-3), r.gauss(5, 1), 0.0) for _ in range(60)] + [(float(i % 6), float(i // 6), 1.0) for i in range(36)]
    pts += [(2.0, 2.0, 1.0)] * 30 + [(1e6, -1e6, 3.0), (1e6 + 1, -1e6, 3.0), (-1e8, 0.0, 0.0)]
    rows = [(i * 7 + 1, *p) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows + [(100_000, None, 1.0, 1.0), (100_001, float("nan"), 1.0, 1.0)], "id long, a double, b double, c double")
    got = {(q._a, q._nr): (q._b, q._dist) for q in nearest_neighbours(df, "id", ["a", "b", "c"], k, cell_rows).collect()}
    assert len(got) == len(rows) * k
    for a in rows:
        near = sorted((sum((x - y) ** 2 for x, y in zip(a[1:], b[1:])), b[0]) for b in rows if b[0] != a[0])[:k]
        assert [got[(a[0], i + 1)][0] for i in range(k)] == [b for _, b in near]
        assert [got[(a[0], i + 1)][1] for i in range(k)] == pytest.approx([d ** 0.5 for d, _ in near])
    assert nearest_neighbours(df.limit(0), "id", ["a", "b"], k).count() == 0
    assert nearest_neighbours(df.where("id = 1"), "id", ["a", "b"], k).count() == 0
