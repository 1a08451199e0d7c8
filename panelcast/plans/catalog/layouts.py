"""Files with their own headers, dialects and date layouts (SRC1, SRC3, PRJ1, DT1, DT2, DT4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import rules as rl
from ...functions import text as tx
from ...operators import layouts as ly
from ...sources import files as fs
from ...sources import headers as hd
from ...sources import tables as tb
from . import as_double as R
from . import register

POLL = list(rl.POLLUTANTS)

# Header name -> canonical column, over all layout families.
ALIASES = {"pm10": "pm_sepuluh", "pm_10": "pm_sepuluh", "pm25": "pm_duakomalima", "so2": "sulfur_dioksida",
           "co": "karbon_monoksida", "o3": "ozon", "no2": "nitrogen_dioksida", "categori": "kategori",
           "critical": "parameter_pencemar_kritis", "lokasi_spku": "stasiun"}
COLUMNS = ["periode_data", "bulan", "tanggal", "stasiun", *POLL, "parameter_pencemar_kritis", "kategori"]

SHIFT = 20  # years added to the table's dates, so that spreadsheet serials are over their threshold


def _text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("---"))


def stage_six_layouts(spark, d) -> str:
    """panel_air as yearly files of six layout families in one folder, separators mixed."""
    a = tb.panel_air(spark, d).withColumn("date", F.add_months("date", 12 * SHIFT))
    root = fs.staging_path(spark, "air-layouts")
    y = F.year("date")
    a = a.select(F.concat(F.lit("ispu-"), y.cast("string"), F.lit("-data")).alias("file_tag"), "*", y.alias("_year"),
                 (y * 100 + F.month("date")).cast("string").alias("periode_data"),
                 F.date_format("date", "yyyy-MM-dd").alias("iso"), F.date_format("date", "M/d/yyyy").alias("mdy"),
                 F.date_format("date", "dd/MM/yyyy").alias("dmy"),
                 # the noon of every second day, as a spreadsheet counts days
                 F.concat(F.datediff("date", F.lit("1899-12-30")).cast("string"), F.lit(".5")).alias("serial"),
                 F.lit("PM2,5 \"halus\"").alias("worst"), F.concat("station", F.lit(" (Kebon Jeruk, Barat)")).alias("place"),
                 F.date_format("date", "MMMM").alias("month_name"), F.dayofmonth("date").cast("string").alias("day_number"))
    v = {p: _text(p) for p in POLL}
    pm10, pm25, so2, co, o3, no2 = (v[p] for p in ("pm_sepuluh", "pm_duakomalima", "sulfur_dioksida", "karbon_monoksida", "ozon",
                                                   "nitrogen_dioksida"))
    old = [pm10.alias("pm10"), so2.alias("so2"), co.alias("co"), o3.alias("o3"), no2.alias("no2")]
    ends = [F.col("worst").alias("critical"), F.col("kategori").alias("categori")]
    first = 1992 + SHIFT
    families = [
        (0, ",", ["periode_data", F.col("iso").alias("tanggal"), F.col("place").alias("stasiun"), *old, *ends]),
        (1, ";", ["periode_data", F.col("mdy").alias("tanggal"), *old, *ends, F.col("station").alias("lokasi_spku")]),
        (2, ",", ["periode_data", F.col("dmy").alias("tanggal"), *old, *ends, F.col("station").alias("lokasi_spku")]),
        (3, "|", ["periode_data", F.col("iso").alias("Tanggal "), F.col("place").alias("stasiun"), old[0], pm25.alias("pm25"), *old[1:], *ends]),
        (4, "\t", ["periode_data", F.when(F.dayofmonth("date") % 2 == 0, F.col("serial")).otherwise(F.col("iso")).alias("tanggal"),
                   pm10.alias("pm_10"), pm25.alias("pm_duakomalima"), *old[1:], *ends, F.col("place").alias("lokasi_spku")]),
        (5, ";", ["periode_data", F.col("month_name").alias("bulan"), F.col("day_number").alias("tanggal"), F.col("place").alias("stasiun"),
                  *[v[p].alias(p) for p in POLL], F.col("worst").alias("parameter_pencemar_kritis"), "kategori"])]
    for k, sep, cols in families:
        mine = F.col("_year") == first + k if k < 5 else F.col("_year") >= first + 5
        (a.where(mine).select("file_tag", *cols).write.mode("append").partitionBy("file_tag")
         .option("header", True).option("sep", sep).option("escape", '"').csv(root))
    return root


# In the files of the first three families there is no PM2.5 column.
@register("src1_src3_prj1_own_headers", tb.with_views("panel_air") + f"""
SELECT CAST(year(date) + {SHIFT} AS INTEGER) AS file_year, station, CAST(date + INTERVAL {SHIFT} YEAR AS DATE) AS date,
       {', '.join(f"CASE WHEN '{p}' = 'pm_duakomalima' AND year(date) < 1995 THEN NULL ELSE {R(p)} END AS {p}" for p in POLL)},
       'PM2,5 "halus"' AS parameter_pencemar_kritis, kategori FROM panel_air""")
def src1_src3_prj1_own_headers(spark, d):
    raw = hd.read_headed(spark, stage_six_layouts(spark, d), COLUMNS, ALIASES, year_regex=r"ispu-(\d{4})")
    x = ly.dates_by_file(raw, ["file_year"], "tanggal", period="periode_data", month_name="bulan")
    return x.select("file_year", tx.station_code("stasiun").alias("station"), "date", *[tx.to_number(p).alias(p) for p in POLL],
                    "parameter_pencemar_kritis", "kategori")


# Files by customer; every third is written month first, every third day first, every third day first with days to 12 only.
_FILES = """
, f AS (SELECT o_orderkey AS k, o_custkey % 60 AS file, CAST(o_orderdate AS DATE) AS od FROM orders),
t AS (SELECT k, file, od, CASE WHEN file % 3 = 0 THEN strftime(od, '%-m/%-d/%Y') ELSE strftime(od, '%d/%m/%Y') END AS txt
      FROM f WHERE file % 3 <> 2 OR day(od) <= 12),
p AS (SELECT *, CAST(try_strptime(txt, '%m/%d/%Y') AS DATE) AS m, CAST(try_strptime(txt, '%d/%m/%Y') AS DATE) AS dd FROM t),
g AS (SELECT file, count(*) FILTER (m IS NOT NULL AND dd IS NULL) AS n_month_first,
             count(*) FILTER (dd IS NOT NULL AND m IS NULL) AS n_day_first,
             count(*) FILTER (m <> dd) AS n_ambiguous, count(*) AS n_rows FROM p GROUP BY file)
"""


def _slash_files(spark, d):
    o = tb.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 60).alias("file"),
                                            F.to_date("o_orderdate").alias("od"))
    month_first = F.col("file") % 3 == 0
    txt = F.when(month_first, F.date_format("od", "M/d/yyyy")).otherwise(F.date_format("od", "dd/MM/yyyy"))
    # a file of ambiguous rows alone is one that happens to hold no later day of a month
    return o.where((F.col("file") % 3 != 2) | (F.dayofmonth("od") <= 12)).select("k", "file", txt.alias("txt"))


@register("dt1_dt2_layout_per_file", "WITH one AS (SELECT 1)" + _FILES + """
SELECT k, p.file, txt, CASE WHEN n_day_first > n_month_first THEN coalesce(dd, m) ELSE coalesce(m, dd) END AS date
FROM p JOIN g ON p.file = g.file""")
def dt1_dt2_layout_per_file(spark, d):
    x = _slash_files(spark, d)
    return ly.dates_by_file(x, ["file"], "txt").select("k", "file", "txt", "date")


@register("dt2_layout_evidence", "WITH one AS (SELECT 1)" + _FILES + """
SELECT file, n_rows, n_month_first, n_day_first, n_ambiguous,
       CASE WHEN n_day_first > n_month_first THEN 'd/M/yyyy' ELSE 'M/d/yyyy' END AS slash_layout FROM g""")
def dt2_layout_evidence(spark, d):
    return ly.file_date_layouts(_slash_files(spark, d), ["file"], "txt").select(
        "file", "n_rows", "n_month_first", "n_day_first", "n_ambiguous", "slash_layout")


@register("dt4_month_texts_per_file", """
SELECT o_orderkey AS k, o_custkey % 2 AS file, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS date FROM orders""")
def dt4_month_texts_per_file(spark, d):
    od = F.to_date("o_orderdate")
    o = tb.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 2).alias("file"), F.year(od).alias("year"),
        F.when(F.col("o_custkey") % 2 == 0, F.date_format(od, "yyyyMM")).otherwise(F.month(od).cast("string")).alias("bulan"))
    return ly.month_texts(o, ["file"], "bulan", "year").select("k", "file", "date")
