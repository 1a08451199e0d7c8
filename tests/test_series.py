"""Fills, staleness, spells, halo windows and bucket scans against plain per-series windows."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import fills, windows
from panelcast.operators.frames import SeriesFrame, bounded, scan

D0 = dt.date(2020, 1, 1)


def series(spark, values, station="S1", start=D0, step=1):
    rows = [(station, start + dt.timedelta(days=i * step), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station string, date date, v double")


def ordered(df, *cols):
    return [tuple(r) for r in df.orderBy("station", "date").select(*cols).collect()]


def test_spells_pattern(spark):
    rain = [0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    df = series(spark, rain).withColumn("rainy", F.col("v").cast("int"))
    out = ordered(fills.spells(df, "rainy"), "dry_spell", "wet_spell")
    assert [o[0] for o in out] == [1, 2, 0, 0, 1, 2, 3, 0]
    assert [o[1] for o in out] == [0, 0, 1, 2, 0, 0, 0, 1]


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_fills_cross_buckets(spark, bucket):
    vals = [None, None, 1.0, None, None, None, 4.0, None, None]
    df = series(spark, vals).unionByName(series(spark, [None, 7.0, None], station="S2"))
    fr = SeriesFrame(bucket=bucket)
    out = fills.fill_both(df.withColumn("f", F.col("v")).withColumn("b", F.col("v")), ["f"], fr, first="ffill")
    out = fills.fill_both(out, ["b"], fr, first="bfill")
    got = ordered(out, "f", "b")
    assert [g[0] for g in got] == [1, 1, 1, 1, 1, 1, 4, 4, 4, 7, 7, 7]
    assert [g[1] for g in got] == [1, 1, 1, 4, 4, 4, 4, 4, 4, 7, 7, 7]


def test_staleness_counter_and_days_since(spark):
    df = series(spark, [None, None, 2.0, None, None, 5.0, None])
    st = ordered(fills.staleness_counter(df, "v", SeriesFrame(bucket=2)), "v", "v_days_stale")
    assert [s[1] for s in st] == [1, 2, 0, 1, 2, 0, 1]
    assert [s[0] for s in st] == [None, None, 2.0, 2.0, 2.0, 5.0, 5.0]
    ds = ordered(fills.days_since(df, F.col("v").isNotNull(), "d", SeriesFrame(bucket=2)), "d")
    assert [x[0] for x in ds] == [-1, -1, 0, 1, 2, 0, 1]


def test_interpolation_time_weighted(spark):
    df = spark.createDataFrame([("S", dt.date(2020, 1, 1), None), ("S", dt.date(2020, 1, 2), 1.0),
                                ("S", dt.date(2020, 1, 5), 4.0), ("S", dt.date(2020, 1, 3), None),
                                ("S", dt.date(2020, 1, 9), None)], "station string, date date, v double")
    got = ordered(fills.interpolate_time(df, "v"), "v")
    assert [g[0] for g in got] == [1.0, 1.0, 2.0, 4.0, 4.0]


@pytest.mark.parametrize("chunk", [3, 5, 1024])
def test_halo_windows_equal_plain(spark, chunk):
    vals = [float(i * i % 7) if i % 4 else None for i in range(40)]
    df = series(spark, vals).unionByName(series(spark, vals[::-1], station="S2"))
    fr = SeriesFrame(bucket=4, chunk_rows=chunk)
    out = windows.lags(df, ["v"], [1, 3], fr)
    out = windows.rolling(out, ["v"], [3, 5], ["mean", "std"], fr, min_periods={"std": 2})
    w = Window.partitionBy("station").orderBy("date")
    ref = df.select("station", "date",
                    F.lag("v", 1).over(w).alias("v_lag_1d"), F.lag("v", 3).over(w).alias("v_lag_3d"),
                    F.avg("v").over(w.rowsBetween(-2, 0)).alias("v_rollmean_3d"),
                    F.when(F.count("v").over(w.rowsBetween(-4, 0)) >= 2,
                           F.stddev_samp("v").over(w.rowsBetween(-4, 0))).alias("v_rollstd_5d"))
    cols = ["v_lag_1d", "v_lag_3d", "v_rollmean_3d", "v_rollstd_5d"]
    a, b = ordered(out, *cols), ordered(ref, *cols)
    assert len(a) == len(b) == 80
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert (p is None and q is None) or abs(p - q) < 1e-9


def test_scan_row_index_and_cumsum(spark):
    df = series(spark, [1.0] * 10, step=3)
    got = ordered(scan(df, SeriesFrame(bucket=5), row_index="rn", cumsum={"cs": F.col("v")}), "rn", "cs")
    assert got == [(i + 1, float(i + 1)) for i in range(10)]


def test_bounded_lead(spark):
    df = series(spark, [float(i) for i in range(12)])
    out = bounded(df, SeriesFrame(chunk_rows=4), lambda w: {"nxt": F.lead("v", 2).over(w)}, before=0, after=2)
    assert [r[0] for r in ordered(out, "nxt")] == [float(i + 2) for i in range(10)] + [None, None]


def test_hot_station_spreads_over_partitions(spark):
    """One station holding every row is still processed by many tasks."""
    vals = [float(i) if i % 5 else None for i in range(3000)]
    df = series(spark, vals, station="HOT")
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = fills.ffill(df, "v", SeriesFrame(bucket=32)).withColumn("pid", F.spark_partition_id())
        parts = out.select("pid").distinct().count()
        got = ordered(out, "v")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)
    assert parts > 1
    w = Window.partitionBy("station").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ref = ordered(df.select("station", "date", F.last("v", True).over(w).alias("v")), "v")
    assert got == ref


@pytest.mark.parametrize("width", [1, 5, 64, None])
def test_day_frames_on_a_gappy_panel(spark, width):
    """Lags, sums and deviations by days against plain Python, whatever the chunk width."""
    import random

    from panelcast.operators import dayframes as df_
    r = random.Random(3)
    rows = [(s, D0 + dt.timedelta(days=i), None if r.random() < 0.1 else float(r.randint(0, 50)))
            for s in ("S1", "S2") for i in range(200) if r.random() < 0.6]
    rows.append(("S1", None, 1.0))
    x = spark.createDataFrame(rows, "station string, date date, v double")
    x = df_.lags_days(x, "v", [1, 7], width=width)
    x = df_.rolling_days(x, "v", [7], ["sum", "count", "std"], min_periods={"std": 3}, width=width)
    x = df_.growth_days(x, "v", [7], width=width)
    got = {(q.station, q.date): q for q in x.collect()}
    assert len(got) == len(rows)
    known = {(s, d): v for s, d, v in rows}
    for (s, d), q in got.items():
        if d is None:
            assert q.v == 1.0 and q.v_lag_1days is None and q.v_rollcount_7days is None
            continue
        at = lambda k: known.get((s, d - dt.timedelta(days=k)))
        assert q.v_lag_1days == at(1) and q.v_lag_7days == at(7)
        seen = [at(k) for k in range(7) if at(k) is not None]
        assert q.v_rollcount_7days == len(seen) and q.v_rollsum_7days == (sum(seen) if seen else None)
        assert (q.v_rollstd_7days is None) == (len(seen) < 3)
        assert q.v_growth_7days == (q.v / at(7) - 1 if q.v is not None and at(7) else None)


def test_day_chunks_follow_the_rows_of_a_day(spark):
    from panelcast.operators import dayframes as df_
    rows = [("S1", D0 + dt.timedelta(days=i), float(k)) for i in range(64) for k in range(10)]
    x = spark.createDataFrame(rows, "station string, date date, v double")
    assert df_.chunk_days(x, rows_per_task=45) == 4 and df_.chunk_days(x, rows_per_task=5) == 1 and df_.chunk_days(x) == 16384
    wide = df_.rolling_days(x, "v", [5], ["sum"]).groupBy("date").agg(F.max("v_rollsum_5days").alias("s")).collect()
    thin = df_.rolling_days(x, "v", [5], ["sum"], width=df_.chunk_days(x, rows_per_task=45)).groupBy("date").agg(
        F.max("v_rollsum_5days").alias("s")).collect()
    assert sorted(map(tuple, wide)) == sorted(map(tuple, thin))
