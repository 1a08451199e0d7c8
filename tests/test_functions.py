"""Edge tables for the stateless expressions (STR, DT, MTH, RUL)."""

import datetime as dt

from pyspark.sql import functions as F

from panelcast.functions import dates, maths, rules, text


def col1(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_compass_bins(spark):
    vals = [0.0, 22.5, 22.6, 67.5, 337.5, 337.6, 360.0, None, -22.5, -30.0, 700.0]
    got = [r[0] for r in col1(spark, vals, "double").select(maths.compass_8("v")).collect()]
    assert got == ["N", "N", "NE", "NE", "NW", "N", "N", None, "N", None, None]


def test_band_gaps_and_worst(spark):
    vals = [50.0, 50.5, 51.0, 150.0, 150.5, 421.0, -1.0, None]
    strict = [r[0] for r in col1(spark, vals, "double").select(rules.band_category("v", "pm_sepuluh")).collect()]
    assert strict == ["BAIK", "BERBAHAYA", "SEDANG", "SEDANG", "BERBAHAYA", "BERBAHAYA", "BERBAHAYA", None]
    cont = [r[0] for r in col1(spark, vals, "double").select(
        rules.band_category("v", "pm_sepuluh", strict_gaps=False)).collect()]
    assert cont == ["BAIK", "SEDANG", "SEDANG", "SEDANG", "TIDAK SEHAT", "BERBAHAYA", "BAIK", None]


def test_overall_category_no_pollutant_is_baik(spark):
    df = spark.createDataFrame([(None, None), (10.0, 60.0)], "pm_sepuluh double, pm_duakomalima double")
    got = [r[0] for r in df.select(rules.rule_category({"pm_sepuluh": "pm_sepuluh",
                                                        "pm_duakomalima": "pm_duakomalima"})).collect()]
    assert got == ["BAIK", "TIDAK SEHAT"]


def test_numbers_and_sentinels(spark):
    vals = ["---", "-", "", " 5 ", "1d", "abc", "1e3", None]
    got = [r[0] for r in col1(spark, vals).select(text.to_number("v")).collect()]
    assert got == [None, None, None, 5.0, None, None, 1000.0, None]
    eu = [r[0] for r in col1(spark, ["1.234,5", "-6.2", "0,002"]).select(text.european_number("v")).collect()]
    assert eu == [1234.5, -62.0, 0.002]
    cen = [r[0] for r in col1(spark, ["<0,002", "<=5", ">10", "≥ 7"]).select(text.censored_number("v")).collect()]
    assert cen == [0.002, None, 10.0, 7.0]


def test_station_codes(spark):
    got = col1(spark, ["Stasiun DKI3 X", "stasiun dki12", "O3", None]).select(
        text.station_code("v"), text.station_code_or_keep("v")).collect()
    assert [tuple(r) for r in got] == [("DKI3", "DKI3"), (None, "DKI12"), (None, "O3"), (None, None)]


def test_dates(spark):
    got = col1(spark, ["44926.625", "2018-01-05", "05/01/2018", "39000"]).select(
        dates.date_or_serial("v"), dates.parse_date("v"), dates.parse_date_any("v", ("yyyy-MM-dd", "dd/MM/yyyy"))
    ).collect()
    assert [tuple(r) for r in got] == [
        (dt.date(2022, 12, 31), None, None),
        (dt.date(2018, 1, 5), dt.date(2018, 1, 5), dt.date(2018, 1, 5)),
        (None, None, dt.date(2018, 1, 5)),
        (None, None, None)]
    parts = spark.createDataFrame([(2023, 2, 30), (2024, 2, 29)], "y int, m int, d int").select(
        dates.date_from_parts("y", "m", "d")).collect()
    assert [r[0] for r in parts] == [None, dt.date(2024, 2, 29)]


def test_clip_keeps_nulls(spark):
    df = col1(spark, [-1.0, None, 3.0], "double").select(maths.clip_lower("v"), maths.clip("v", 0.0, 2.0))
    assert [tuple(r) for r in df.collect()] == [(0.0, 0.0), (None, None), (3.0, 2.0)]


def test_log_and_ratio_null_safe(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0)], "a double, b double")
    got = df.select(maths.log_positive("a"), maths.safe_ratio("b", "a")).collect()
    assert [tuple(r) for r in got] == [(None, None), (0.0, 2.0)]
    assert df.select(F.lit(1)).count() == 2
