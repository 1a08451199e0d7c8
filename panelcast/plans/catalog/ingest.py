"""Raw-file sources and sinks as round trips (SRC1-SRC6, SRC10, SNK1-SNK4).

Each query writes files derived from the driver tables into a fresh folder
under the shared checkpoint folder, in the layouts the raw sources have, then
reads them back through the readers and cleans them.  The oracle computes the
expected rows straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import dates as dt
from ...functions import rules as rl
from ...functions import text as tx
from ...operators import joins as jn
from ...operators import schema as sc
from ...sources import files as fs
from ...sources import sinks as sk
from ...sources import tables as tb
from . import register
from . import as_double as R
from .schema import OLD_TO_CANONICAL

POLL = list(rl.POLLUTANTS)
OLD_COLS = ["periode_data", "tanggal", "pm10", "so2", "co", "o3", "no2", "pm25", "max", "critical", "categori",
            "lokasi_spku"]
NEW_COLS = ["periode_data", "tanggal", "stasiun", *POLL, "kategori"]

# Station code <-> administrative city.
STATION_CITY = {"DKI1": "Jakarta Pusat", "DKI2": "Jakarta Utara", "DKI3": "Jakarta Selatan",
                "DKI4": "Jakarta Timur", "DKI5": "Jakarta Barat"}


def _txt(c):
    """Number as raw-file text; missing as the '---' sentinel."""
    return F.coalesce(F.col(c).cast("string"), F.lit("---"))


def stage_air_yearly(spark, d) -> str:
    """panel_air as yearly files: 1995-1997 old layout (','), 1998+ canonical layout (';')."""
    a = tb.panel_air(spark, d)
    root = fs.staging_path(spark, "air-yearly")
    y = F.year("date")
    tag = F.concat(F.lit("ispu_"), y.cast("string"))
    period = (y * 100 + F.month("date")).cast("string")
    label = F.concat(F.col("station"), F.lit(" (Kebon Jeruk)"))
    old = a.where(y <= 1997).select(
        tag.alias("file_tag"), period.alias("periode_data"), F.date_format("date", "yyyy-MM-dd").alias("tanggal"),
        _txt("pm_sepuluh").alias("pm10"), _txt("sulfur_dioksida").alias("so2"), _txt("karbon_monoksida").alias("co"),
        _txt("ozon").alias("o3"), _txt("nitrogen_dioksida").alias("no2"), _txt("pm_duakomalima").alias("pm25"),
        F.lit("").alias("max"), F.lit("PM10").alias("critical"), F.col("kategori").alias("categori"),
        label.alias("lokasi_spku"))
    new = a.where(y > 1997).select(
        tag.alias("file_tag"), period.alias("periode_data"), F.date_format("date", "yyyy-MM-dd").alias("tanggal"),
        label.alias("stasiun"), *[_txt(p).alias(p) for p in POLL], "kategori")
    old.write.partitionBy("file_tag").option("header", True).csv(f"{root}/old")
    new.write.partitionBy("file_tag").option("header", True).option("sep", ";").csv(f"{root}/new")
    return root


# The 2011-2020 family layout (no PM2.5 column).
FAMILY_2011_2020 = ["periode_data", "tanggal", "pm10", "so2", "co", "o3", "no2", "max", "critical", "categori",
                    "lokasi_spku"]


def read_air_yearly(spark, root: str, years=None, old_cols=OLD_COLS, new_cols=NEW_COLS):
    """SRC1 + SRC2 + SRC3 + PRJ1 + PRJ3: two layout families, two dialects, one canonical frame.
    Each family is read with its own positional column list."""
    rx = r"ispu_(\d{4})"
    old = fs.scan_yearly(spark, f"{root}/old", old_cols, sep=",", year_regex=rx, years=years)
    old = sc.rename(old, {**OLD_TO_CANONICAL, "lokasi_spku": "stasiun"})
    new = fs.scan_yearly(spark, f"{root}/new", new_cols, sep=";", year_regex=rx, years=years)
    both = sc.harmonise([old, new], ["file_year", "_ingest", *NEW_COLS])
    return both.select(
        "file_year", "_ingest", tx.station_code("stasiun").alias("station"), dt.parse_date("tanggal").alias("date"),
        F.col("periode_data").cast("int").alias("periode_data"),
        *[tx.to_number(p).alias(p) for p in POLL], "kategori")


@register("src1_src2_src3_yearly_files", tb.with_views("panel_air") + "SELECT CAST(year(date) AS INTEGER) AS file_year, "
          "station, date, " + ", ".join(f"{R(p)} AS {p}" for p in POLL) + ", kategori FROM panel_air")
def src1_src2_src3_yearly_files(spark, d):
    root = stage_air_yearly(spark, d)
    x = read_air_yearly(spark, root)
    return x.drop("_ingest", "periode_data")


def stage_population(spark, d) -> str:
    """Yearly two-column tables with BOM, preamble, city rows and a province total."""
    y = tb.yearly(spark, d)
    root = fs.staging_path(spark, "population")
    city = jn.map_lookup("station", STATION_CITY)
    tag = F.concat(F.lit("penduduk_"), F.col("year").cast("string"))
    body = y.select(tag.alias("file_tag"), F.concat(city, F.lit(","), F.col("n_orders").cast("string")).alias("value"))
    total = y.groupBy("year").agg(F.sum("n_orders").alias("t")).select(
        F.concat(F.lit("penduduk_"), F.col("year").cast("string")).alias("file_tag"),
        F.concat(F.lit("DKI Jakarta,"), F.col("t").cast("string")).alias("value"))
    pre = y.select("year").distinct().select(
        F.concat(F.lit("penduduk_"), F.col("year").cast("string")).alias("file_tag"),
        F.explode(F.array(F.lit(fs.BOM + "Kab/Kota,"), F.lit(",Jumlah Penduduk (Jiwa)"),
                          F.concat(F.lit(","), F.col("year").cast("string")))).alias("value"))
    pre.unionByName(body).unionByName(total).write.partitionBy("file_tag").text(root)
    return root


@register("src4_preamble_tables", tb.with_views("yearly") + """
SELECT year AS file_year, station, n_orders AS count FROM yearly""")
def src4_preamble_tables(spark, d):
    root = stage_population(spark, d)
    t = fs.read_preamble_table(spark, root, year_regex=r"penduduk_(\d{4})")
    inv = {v: k for k, v in STATION_CITY.items()}
    t = t.withColumn("station", jn.map_lookup(tx.title_case("name"), inv)).where(F.col("station").isNotNull())
    return t.select("file_year", "station", "count")


WEATHER_COLS = ["time", "temperature_2m_mean (°C)", "precipitation_sum (mm)", "wind_speed_10m_mean (km/h)"]


@register("src5_per_station_files", tb.with_views("panel_ship") + f"""
SELECT station, date, {R('qty_avg')} AS temperature_2m_mean, {R('disc_avg * 100')} AS wind_speed_10m_mean,
       {R('tax_avg * 10')} AS precipitation_sum FROM panel_ship""")
def src5_per_station_files(spark, d):
    s = tb.panel_ship(spark, d)
    root = fs.staging_path(spark, "weather")
    tag = F.concat(F.lit("cuaca-harian-"), F.lower("station"), F.lit("-jakarta"))
    s.select(tag.alias("file_tag"), F.date_format("date", "yyyy-MM-dd").alias("time"),
             F.col("qty_avg").cast("string").alias(WEATHER_COLS[1]),
             (F.col("tax_avg") * 10).cast("string").alias(WEATHER_COLS[2]),
             (F.col("disc_avg") * 100).cast("string").alias(WEATHER_COLS[3])) \
     .write.partitionBy("file_tag").option("header", True).csv(root)
    w = fs.scan_per_station(spark, root, WEATHER_COLS)
    w = sc.strip_units(w.select("file_station", *[sc.q(c) for c in WEATHER_COLS]))
    return w.select(F.col("file_station").alias("station"), dt.parse_date("time").alias("date"),
                    tx.to_number("temperature_2m_mean").alias("temperature_2m_mean"),
                    tx.to_number("wind_speed_10m_mean").alias("wind_speed_10m_mean"),
                    tx.to_number("precipitation_sum").alias("precipitation_sum"))


PANEL_ORDERS_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("price_avg", T.DoubleType()),
    T.StructField("price_max", T.DoubleType()), T.StructField("n_orders", T.LongType()),
    T.StructField("station", T.StringType())])


@register("src6_snk1_typed_reread", tb.with_views("panel_orders") + f"""
SELECT date, {R('price_avg')} AS price_avg, {R('price_max')} AS price_max, n_orders, station FROM panel_orders""")
def src6_snk1_typed_reread(spark, d):
    root = fs.staging_path(spark, "panel")
    sk.write_panel(tb.panel_orders(spark, d), root, ["station"])
    return fs.read_typed(spark, root, PANEL_ORDERS_SCHEMA)


_CELL_COLS = ["kode", "tanggal", "nilai"]


@register("src10_report_cells", tb.with_views("panel_orders") + f"""
SELECT CAST(year(date) - 1995 AS INTEGER) AS period,
       CAST((year(date) - 1995) * 5 + CAST(substr(station, 4) AS INTEGER) - 1 AS INTEGER) AS table_no,
       CAST(row_number() OVER (PARTITION BY station, year(date) ORDER BY date) + 4 AS INTEGER) AS row_no,
       station AS kode, date, {R('price_avg')} AS price
FROM panel_orders""")
def src10_report_cells(spark, d):
    from pyspark.sql import Window
    p = tb.panel_orders(spark, d)
    tno = ((F.year("date") - 1995) * 5 + F.substring("station", 4, 1).cast("int") - 1).cast("int")
    w = Window.partitionBy("station", F.year("date")).orderBy("date")
    body = p.select(tno.alias("table_no"), (F.row_number().over(w) + 4).cast("int").alias("row_no"),
                    F.col("station").alias("c0"), F.date_format("date", "dd/MM/yyyy").alias("c1"),
                    F.format_number(F.col("price_avg"), 10).alias("_p"))
    # 12,345.6789012345 -> 12.345,6789012345 (European text)
    swapped = F.replace(F.replace(F.replace(F.col("_p"), F.lit(","), F.lit("#")), F.lit("."), F.lit(",")),
                        F.lit("#"), F.lit("."))
    body = body.select("table_no", "row_no", "c0", "c1", swapped.alias("c2"))
    heads = body.select("table_no").distinct().select(
        "table_no", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("row_no"),
        F.lit("Kode").alias("c0"), F.lit("Tanggal").alias("c1"), F.lit("Nilai").alias("c2"))
    cells = body.unionByName(heads)
    x = fs.report_cells(cells, _CELL_COLS, skip_rows=5, pages_per_period=5)
    return x.select("period", "table_no", "row_no", "kode", dt.parse_date("tanggal", "dd/MM/yyyy").alias("date"),
                    tx.european_number("nilai").alias("price"))


@register("snk2_submission_csv", tb.with_views("panel_air") + """
SELECT strftime(date, '%Y-%m-%d') || '_' || station AS id,
       CASE WHEN pm_sepuluh > 100 THEN 'TIDAK SEHAT' WHEN pm_sepuluh > 50 THEN 'SEDANG' ELSE 'BAIK' END AS category
FROM panel_air""")
def snk2_submission_csv(spark, d):
    a = tb.panel_air(spark, d)
    cat = F.when(F.col("pm_sepuluh") > 100, "TIDAK SEHAT").when(F.col("pm_sepuluh") > 50, "SEDANG").otherwise("BAIK")
    out = sk.submission(a.withColumn("category", cat))
    root = fs.staging_path(spark, "submission")
    sk.write_csv(out, root, order=["id"])
    return spark.read.option("header", True).schema("id string, category string").csv(root)


_SNK3 = ["ozon", "karbon_monoksida", "sulfur_dioksida", "nitrogen_dioksida", "pm_duakomalima"]
_SNK3_CUT = 0.1  # fixed value: the survey's threshold; PM2.5 lies far above it, the others far below


@register("snk3_feature_lists", tb.with_views("panel_air") + ", c AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs(corr({f}, pm_sepuluh)) AS m FROM panel_air" for f in _SNK3) + f""")
SELECT CASE WHEN coalesce(m, 0) >= {_SNK3_CUT} THEN 'keep' ELSE 'remove' END AS list, feature FROM c""")
def snk3_feature_lists(spark, d):
    from ...operators import profile as pf
    from ...operators.frames import checkpoint
    corr = pf.corr_matrix(tb.panel_air(spark, d), _SNK3, ["pm_sepuluh"], 0)
    sel = checkpoint(pf.select_features(corr, ["pm_sepuluh"], _SNK3_CUT))  # read by both sinks, computed once
    root = fs.staging_path(spark, "features")
    sk.write_lines(sel.where("keep"), f"{root}/keep")
    sk.write_lines(sel.where("NOT keep"), f"{root}/remove")
    keep = spark.read.text(f"{root}/keep").select(F.lit("keep").alias("list"), F.col("value").alias("feature"))
    rem = spark.read.text(f"{root}/remove").select(F.lit("remove").alias("list"), F.col("value").alias("feature"))
    return keep.unionByName(rem)


@register("snk4_metric_table_csv", tb.with_views("panel_air") + f"""
, l AS (SELECT pm_sepuluh AS y, lag(pm_sepuluh, 1) OVER (PARTITION BY station ORDER BY date) AS p FROM panel_air)
SELECT 'pm_sepuluh' AS target, {R('avg(abs(y - p))')} AS mae, {R('sqrt(avg((y - p) * (y - p)))')} AS rmse
FROM l WHERE y IS NOT NULL AND p IS NOT NULL""")
def snk4_metric_table_csv(spark, d):
    from ...operators import windows
    a = tb.panel_air(spark, d).select("station", "date", "pm_sepuluh")
    a = windows.lags(a, ["pm_sepuluh"], [1], name="p").where("pm_sepuluh IS NOT NULL AND p IS NOT NULL")
    m = a.agg(F.avg(F.abs(F.col("pm_sepuluh") - F.col("p"))).alias("mae"),
              F.sqrt(F.avg((F.col("pm_sepuluh") - F.col("p")) ** 2)).alias("rmse")) \
         .select(F.lit("pm_sepuluh").alias("target"), "mae", "rmse")
    root = fs.staging_path(spark, "metrics")
    sk.write_csv(m, root)
    return spark.read.option("header", True).schema("target string, mae double, rmse double").csv(root)
