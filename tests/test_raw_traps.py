"""Entry 1 on hand-made raw files with the traps seen in the reference's data."""

import datetime as dt
import os

from panelcast.plans import flows
from panelcast.plans.catalog.ingest import NEW_COLS, OLD_COLS
from panelcast.sources.files import staging_path

OLD = """periode_data,tanggal,pm10,so2,co,o3,no2,max,critical,categori,lokasi_spku
202001,2020-01-01,50,10,20,30,15,50,PM10,BAIK,DKI1 (Bunderan HI)
202001,2020-01-02,---,11,21,31,16,31,O3,BAIK,DKI1 (Bunderan HI)
202001,2020-01-03,70,12,22,32,17,70,PM10,SEDANG,DKI1 (Bunderan HI)
202001,2020-01-03,90,14,24,34,19,90,PM10,SEDANG,DKI1 (Bunderan HI)
202001,2020-01-04,40,9,19,29,14,40,PM10,TIDAK ADA DATA,DKI1 (Bunderan HI)
202001,2020-01-01,60,10,20,30,15,60,60,PM10,SEDANG,O3
202001,2020-01-01,55,10,20,30,15,55,PM10,SEDANG,0
202001,2020-01-05,45,,20,30,15,45,PM10,,DKI2 (Kelapa Gading)
"""

NEW = """periode_data;tanggal;stasiun;pm_sepuluh;pm_duakomalima;sulfur_dioksida;karbon_monoksida;ozon;nitrogen_dioksida;kategori
202201;2022-01-01;DKI3 Jagakarsa;40;"20,5";5;6;7;8;BAIK
202201;05/01/2022;DKI3 Jagakarsa;41;21;5;6;7;8;BAIK
202201;2022-01-02;DKI3 Jagakarsa;-;-;5;6;7;8;SANGAT TIDAK SEHAT
"""


def write(root, sub, name, text):
    os.makedirs(os.path.join(root, sub), exist_ok=True)
    with open(os.path.join(root, sub, name), "w") as f:
        f.write(text)


def test_entry1_traps(spark):
    from panelcast.plans.catalog.ingest import FAMILY_2011_2020, read_air_yearly
    root = staging_path(spark, "traps").replace("file:", "")
    write(root, "old", "ispu_2020.csv", OLD)
    write(root, "new", "ispu_2022.csv", NEW)
    raw = read_air_yearly(spark, root, old_cols=FAMILY_2011_2020)
    assert raw.columns[:2] == ["file_year", "_ingest"] and set(raw.select("file_year").distinct().toPandas()
                                                             .file_year) == {2020, 2022}
    out = {(r.station, r.date): r for r in flows.clean_air_quality(raw).collect()}
    # shifted row (label in the station column) and station "0" have no station code -> dropped;
    # the no-data label is dropped; the dd/MM/yyyy row is lost by first-layout parsing
    assert set(out) == {("DKI1", dt.date(2020, 1, 1)), ("DKI1", dt.date(2020, 1, 2)), ("DKI1", dt.date(2020, 1, 3)),
                        ("DKI2", dt.date(2020, 1, 5)), ("DKI3", dt.date(2022, 1, 1)), ("DKI3", dt.date(2022, 1, 2))}
    assert out[("DKI1", dt.date(2020, 1, 2))].pm_sepuluh == 50.0          # '---' -> NULL -> forward filled
    assert out[("DKI1", dt.date(2020, 1, 3))].pm_sepuluh == 80.0          # duplicate key -> mean
    assert out[("DKI1", dt.date(2020, 1, 3))].ID == "2020-01-03_DKI1"
    assert out[("DKI2", dt.date(2020, 1, 5))].kategori is None            # NULL label kept
    assert out[("DKI3", dt.date(2022, 1, 1))].pm_duakomalima is None      # "20,5" is not a plain number
    assert out[("DKI3", dt.date(2022, 1, 2))].pm_sepuluh == 40.0          # '-' -> NULL -> filled
    assert out[("DKI3", dt.date(2022, 1, 2))].kategori == "TIDAK SEHAT"   # collapsed category
    assert OLD_COLS[0] == NEW_COLS[0] == "periode_data"


def _write(folder, name, text, encoding="utf-8"):
    import os
    os.makedirs(f"{folder}/{name[:4]}", exist_ok=True)
    with open(f"{folder}/{name[:4]}/{name}", "w", encoding=encoding, newline="") as f:
        f.write(text)


def test_each_file_is_read_by_its_own_header_and_dialect(spark, tmp_path):
    from panelcast.operators import layouts as ly
    from panelcast.sources import headers as hd

    root = str(tmp_path)
    _write(root, "2011-a.csv", "﻿periode_data,tanggal,pm10,critical,lokasi_spku\r\n201101,2011-01-05,7,\"PM2,5\",DKI1\r\n\r\n"
                               "201101,2011-01-06,,\"say \"\"x\"\"\",DKI1\r\n")
    _write(root, "2012-b.csv", "lokasi_spku;PM_10;tanggal\nDKI2;8;13/01/2012\nDKI2;9;04/05/2012\nlokasi_spku;PM_10;tanggal\nDKI2\n")
    _write(root, "2013-c.csv", "tanggal|stasiun|pm10|co\n1/13/2013|DKI3|1|,;\n4/5/2013|DKI3||\n")
    _write(root, "2014-d.csv", "tanggal\tstasiun\tpm10\n4/5/2014\tDKI4\t1\n")           # ambiguous alone: month first
    _write(root, "2022-e.csv", "tanggal,stasiun,pm_10\n44926.625,DKI5,1\n2022-12-30,DKI5,2\nnonsense,DKI5,3\n")
    _write(root, "2024-f.csv", "periode_data,bulan,tanggal,stasiun,pm_sepuluh\n202402,2,29,DKI1,1\n202402,2,30,DKI1,2\n")
    _write(root, "2025-g.csv", "")
    cols = ["periode_data", "bulan", "tanggal", "stasiun", "pm_sepuluh", "kritis"]
    raw = hd.read_headed(spark, root, cols, {"pm10": "pm_sepuluh", "pm_10": "pm_sepuluh", "lokasi_spku": "stasiun", "critical": "kritis"})
    x = ly.dates_by_file(raw, ["file_path"], "tanggal", period="periode_data", month_name="bulan")
    got = sorted(map(str, ((r.file_year, str(r.date), r.stasiun, r.pm_sepuluh, r.kritis) for r in x.collect())))
    assert got == sorted(map(str, [
        (2011, "2011-01-05", "DKI1", "7", "PM2,5"), (2011, "2011-01-06", "DKI1", None, 'say "x"'),
        (2012, "2012-01-13", "DKI2", "8", None), (2012, "2012-05-04", "DKI2", "9", None), (2012, "None", "DKI2", None, None),
        (2013, "2013-01-13", "DKI3", "1", None), (2013, "2013-04-05", "DKI3", None, None), (2014, "2014-04-05", "DKI4", "1", None),
        (2022, "2022-12-31", "DKI5", "1", None), (2022, "2022-12-30", "DKI5", "2", None), (2022, "None", "DKI5", "3", None),
        (2024, "2024-02-29", "DKI1", "1", None), (2024, "None", "DKI1", "2", None)]))


def test_a_file_of_mixed_slash_dates_follows_its_majority(spark):
    from panelcast.operators import layouts as ly

    rows = [("a", t) for t in ("13/01/2020", "14/01/2020", "1/31/2020", "02/03/2020")] + [("b", "02/03/2020"), ("b", None), ("b", "x")] \
        + [("c", None), (None, "05/06/2020"), (None, "25/06/2020")]
    df = spark.createDataFrame(rows, "f string, t string")
    got = {(r.f, r.t): str(r.date) for r in ly.dates_by_file(df, ["f"], "t").collect()}
    assert got[("a", "02/03/2020")] == "2020-03-02" and got[("a", "1/31/2020")] == "2020-01-31" and got[("a", "13/01/2020")] == "2020-01-13"
    assert got[("b", "02/03/2020")] == "2020-02-03" and got[("b", None)] == "None" and got[("b", "x")] == "None" and got[("c", None)] == "None"
    assert got[(None, "05/06/2020")] == "2020-06-05"
