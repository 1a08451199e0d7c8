"""Boundary dumps, geometry text and spatial joins (SRC7, SRC8, SRC9, JN12, JN13).

Boundary text is generated from the ``region`` / ``nation`` rows by a fixed
rule (region r is the strip ``x0 = -0.4 + 0.16 r`` wide 0.16, ``|y| <= 0.3``;
region 2 has a square hole, region 3 is written as a two-part multipolygon,
regions 0-1 as bare rings) and parsed back by the readers.  Points are the
first two embedding components.  The oracle builds the same edges by formula.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import spatial as sp
from ...sources import dumps as dp
from ...sources import tables as tb
from . import register
from . import as_double as R

W_ = 0.16
Y0, Y1 = -0.3, 0.3
HOLE = 0.05


def _num(c):
    return c.cast("string")


def _pt(y, x):
    return F.concat(F.lit("["), _num(y), F.lit(","), _num(x), F.lit("]"))


def _ring(x0, x1, y0, y1):
    pts = [_pt(y0, x0), _pt(y0, x1), _pt(y1, x1), _pt(y1, x0), _pt(y0, x0)]
    return F.concat(F.lit("["), F.concat_ws(",", *pts), F.lit("]"))


def boundary_lines(spark, d):
    """Dump text lines (one per region, plus noise) derived from the region table."""
    r = tb.table(spark, d, "region").select("r_regionkey", "r_name")
    k = F.col("r_regionkey")
    x0 = F.lit(-0.4) + F.lit(W_) * k
    x1 = x0 + F.lit(W_)
    y0, y1 = F.lit(Y0), F.lit(Y1)
    xm = x0 + F.lit(W_ / 2)
    ext = _ring(x0, x1, y0, y1)
    hole = _ring(xm - F.lit(HOLE), xm + F.lit(HOLE), F.lit(-HOLE), F.lit(HOLE))
    lower, upper = _ring(x0, x1, y0, F.lit(0.0)), _ring(x0, x1, F.lit(0.0), y1)
    geom = (F.when(k <= 1, ext)
             .when(k == 2, F.concat(F.lit("["), ext, F.lit(","), hole, F.lit("]")))
             .when(k == 3, F.concat(F.lit("[["), lower, F.lit("],["), upper, F.lit("]]")))
             .otherwise(F.concat(F.lit("["), ext, F.lit("]"))))
    code = F.concat(F.lit("31.7"), (k + 1).cast("string"))
    line = F.concat(F.lit("('"), code, F.lit("','Kota Administrasi "), F.col("r_name"), F.lit("',"),
                    _num(F.lit(0.0)), F.lit(", "), _num(xm), F.lit(",'"), geom, F.lit("'),"))
    noise = spark.createDataFrame(
        [("-- boundary dump",), ("/*!40101 SET NAMES utf8 */;",), ("CREATE TABLE wilayah_boundaries (",),
         (") ENGINE=InnoDB DEFAULT CHARSET=utf8;",), ("('31.01','Kepulauan Seribu',-5.6,106.5,'[[-5.6,106.5],[-5.7,106.6],[-5.6,106.6]]'),",),
         ("('31.99','Broken',0,0,'[[1,2'),",)], "value string")
    return r.select(line.alias("value")).unionByName(noise)


def boundaries(spark, d):
    return dp.parse_boundary_lines(boundary_lines(spark, d))


def edges(spark, d):
    b = boundaries(spark, d).select(F.col("kode").alias("region"), "geom")
    return dp.ring_edges(dp.geometry_rings(b, region="region"))


def points(spark, d):
    return tb.points(spark, d).select(F.col("vec_id").alias("id"), "x", "y")


_EDGES_SQL = """reg AS (SELECT r_regionkey AS k, '31.7' || CAST(r_regionkey + 1 AS VARCHAR) AS region,
                      -0.4::DOUBLE + 0.16::DOUBLE * r_regionkey AS x0 FROM region),
box AS (SELECT k, region, x0, x0 + 0.16::DOUBLE AS x1, x0 + 0.08::DOUBLE AS xm FROM reg),
rings AS (
  SELECT region, 0 AS poly, 0 AS ring, x0 AS a, x1 AS b, -0.3::DOUBLE AS c, 0.3::DOUBLE AS e FROM box WHERE k <> 3
  UNION ALL SELECT region, 0, 1, xm - 0.05::DOUBLE, xm + 0.05::DOUBLE, -0.05::DOUBLE, 0.05::DOUBLE FROM box WHERE k = 2
  UNION ALL SELECT region, 0, 0, x0, x1, -0.3::DOUBLE, 0.0::DOUBLE FROM box WHERE k = 3
  UNION ALL SELECT region, 1, 0, x0, x1, 0.0::DOUBLE, 0.3::DOUBLE FROM box WHERE k = 3),
edges AS (
  SELECT region, poly, ring, 0 AS seg, a AS x1, c AS y1, b AS x2, c AS y2 FROM rings
  UNION ALL SELECT region, poly, ring, 1, b, c, b, e FROM rings
  UNION ALL SELECT region, poly, ring, 2, b, e, a, e FROM rings
  UNION ALL SELECT region, poly, ring, 3, a, e, a, c FROM rings),
pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
inside AS (
  SELECT p.id, e.region FROM pts p, edges e
  WHERE ((e.y1 > p.y) <> (e.y2 > p.y)) AND (p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1)
  GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


E = tb.with_views(extra=_EDGES_SQL)


@register("src7_boundary_dump", E + """
SELECT b.region AS kode, 'Kota Administrasi ' || r.r_name AS nama, 0.0::DOUBLE AS lat, b.xm AS lng
FROM box b JOIN region r ON b.k = r.r_regionkey
UNION ALL SELECT '31.99', 'Broken', 0.0::DOUBLE, 0.0::DOUBLE""")
def src7_boundary_dump(spark, d):
    return boundaries(spark, d).select("kode", "nama", "lat", "lng")


def region_code_lines(spark, d):
    """INSERT lines with two (code, name) pairs each; nations 20+ get a non-31 code."""
    n = tb.table(spark, d, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    code = F.when(k < 20, F.concat(F.lit("31.7"), F.lpad((k + 1).cast("string"), 2, "0"))) \
            .otherwise(F.concat(F.lit("32.0"), F.lpad((k + 1).cast("string"), 2, "0")))
    pair = F.concat(F.lit("('"), code, F.lit("','"), F.col("n_name"), F.lit("')"))
    g = n.groupBy(F.floor(k / 2).alias("_g")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), pair.alias("p")))).alias("_ps"))
    line = F.concat(F.lit("INSERT INTO `wilayah` VALUES "), F.array_join(F.transform("_ps", lambda x: x["p"]), ","), F.lit(";"))
    return g.select(line.alias("value"))


@register("src8_region_codes", """
SELECT '31.7' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS kode, n_name AS nama
FROM nation WHERE n_nationkey < 20""")
def src8_region_codes(spark, d):
    return dp.parse_region_codes(region_code_lines(spark, d))


@register("src9_geometry_rings", E + """
SELECT region, poly, ring, count(*) AS n_edges FROM edges GROUP BY 1, 2, 3""")
def src9_geometry_rings(spark, d):
    e = edges(spark, d)
    return e.groupBy("region", "poly", "ring").agg(F.count(F.lit(1)).alias("n_edges")) \
            .select("region", F.col("poly").cast("int"), F.col("ring").cast("int"), "n_edges")


@register("jn12_point_in_polygon", E + "SELECT id, region FROM inside")
def jn12_point_in_polygon(spark, d):
    return sp.within(points(spark, d), edges(spark, d))


_NEAREST_SQL = E + f""", cnt AS (SELECT region, count(*) AS n FROM inside GROUP BY 1),
rest AS (SELECT * FROM pts WHERE id NOT IN (SELECT id FROM inside)),
dist AS (
  SELECT p.id, e.region, min(sqrt((p.x - (e.x1 + t * (e.x2 - e.x1))) * (p.x - (e.x1 + t * (e.x2 - e.x1)))
                              + (p.y - (e.y1 + t * (e.y2 - e.y1))) * (p.y - (e.y1 + t * (e.y2 - e.y1))))) AS d
  FROM rest p, (SELECT *, 0 AS dummy FROM edges) e,
       LATERAL (SELECT CASE WHEN tt < 0 THEN 0.0 WHEN tt > 1 THEN 1.0 ELSE tt END AS t FROM (
         SELECT CASE WHEN (e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1) = 0 THEN 0.0
                     ELSE ((p.x - e.x1) * (e.x2 - e.x1) + (p.y - e.y1) * (e.y2 - e.y1))
                          / ((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1)) END AS tt))
  GROUP BY 1, 2),
near AS (SELECT d.id, d.region, d.d FROM dist d LEFT JOIN cnt c ON d.region = c.region
         QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY d.d, coalesce(c.n, 0), d.region) = 1)"""


@register("jn13_nearest_region_fallback", _NEAREST_SQL + f"""
SELECT id, region, 'within' AS method FROM inside
UNION ALL SELECT id, region, 'nearest' FROM near""")
def jn13_nearest_region_fallback(spark, d):
    return sp.assign_regions(points(spark, d), edges(spark, d))


@register("jn13_nearest_distance", _NEAREST_SQL + f"""
SELECT id, region, {R('d')} AS distance FROM near""")
def jn13_nearest_distance(spark, d):
    p, e = points(spark, d), edges(spark, d)
    inside = sp.within(p, e)
    counts = inside.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    return sp.nearest(p.join(inside.select("id"), "id", "left_anti"), e, counts)
