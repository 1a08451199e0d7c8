"""SQL-dump text and geometry text readers (SRC7, SRC8, SRC9).

Dumps are read as text lines (``spark.read.text``) and parsed with regular
expressions: no SQL engine is run on them.  Geometry text (JSON arrays of
``[lat, lng]`` at nesting depth 2, 3 or 4) becomes one edge table with
``x = lng`` and ``y = lat``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ('code','name',lat,lng,'geometry') tuples, one per line
BOUNDARY_LINE = r"^\s*\('([^']*)'\s*,\s*'([^']*)'\s*,\s*([^,]*),\s*([^,]*),\s*'(.*)'\s*\)\s*[,;]?\s*$"
# ('code','name') pairs, possibly several per INSERT line
REGION_PAIR = r"\('([^']*)'\s*,\s*'([^']*)'\)"


def parse_boundary_lines(lines: DataFrame, drop_codes=("31.01",), col: str = "value") -> DataFrame:
    """Boundary rows ``kode, nama, lat, lng, geom`` from dump text lines (SRC7).

    Lines that are not value tuples (comments, DDL, engine clauses) do not
    match and are dropped; so are the listed codes (the island district).
    """
    line = F.col(col)
    m = line.rlike(BOUNDARY_LINE)
    g = [F.regexp_extract(line, BOUNDARY_LINE, i) for i in range(1, 6)]
    out = lines.where(m).select(g[0].alias("kode"), g[1].alias("nama"),
                               F.trim(g[2]).try_cast("double").alias("lat"),
                               F.trim(g[3]).try_cast("double").alias("lng"), g[4].alias("geom"))
    return out.where(~F.col("kode").isin(*drop_codes)) if drop_codes else out


def parse_region_codes(lines: DataFrame, prefix: str = "31", col: str = "value") -> DataFrame:
    """``kode, nama`` pairs from INSERT lines, kept where ``kode LIKE 'prefix%'`` (SRC8)."""
    line = F.regexp_replace(F.col(col), "`", "")
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(REGION_PAIR), 1).alias("kode"),
                         F.regexp_extract_all(line, F.lit(REGION_PAIR), 2).alias("nama"))
    x = lines.where(F.upper(F.col(col)).contains("INSERT INTO")).select(F.explode(pairs).alias("p"))
    return x.select(F.col("p.kode").alias("kode"), F.col("p.nama").alias("nama")) \
            .where(F.col("kode").like(f"{prefix}%"))


_P4 = "array<array<array<array<double>>>>"


def geometry_rings(boundaries: DataFrame, geom: str = "geom", region: str = "nama") -> DataFrame:
    """Rings as ``region, poly, ring, pts array<struct<x,y>>`` (SRC9).

    Depth is chosen by the number of leading brackets: 2 = one exterior ring,
    3 = polygon with holes, 4 = multipolygon.  Everything is lifted to depth 4,
    ``[lat, lng]`` is swapped to ``(x=lng, y=lat)``, bad text gives no rings.
    """
    g = F.regexp_replace(F.col(geom), r"\s", "")
    depth = F.length(F.regexp_extract(g, r"^(\[+)", 1))
    as4 = (F.when(depth == 2, F.from_json(F.concat(F.lit("[["), g, F.lit("]]")), _P4))
            .when(depth == 3, F.from_json(F.concat(F.lit("["), g, F.lit("]")), _P4))
            .when(depth == 4, F.from_json(g, _P4)))
    polys = boundaries.select(F.col(region).alias("region"), as4.alias("_mp")).where(F.col("_mp").isNotNull())
    p = polys.select("region", F.posexplode("_mp").alias("poly", "_rings"))
    r = p.select("region", "poly", F.posexplode("_rings").alias("ring", "_pts"))
    pts = F.transform("_pts", lambda q: F.struct(q[1].alias("x"), q[0].alias("y")))
    return r.select("region", "poly", "ring", pts.alias("pts")).where(F.size("pts") >= 3)


def ring_edges(rings: DataFrame) -> DataFrame:
    """One row per ring segment ``region, poly, ring, seg, x1, y1, x2, y2`` (rings are
    closed implicitly: the last point connects to the first)."""
    idx = F.sequence(F.lit(0), F.size("pts") - 1)
    seg = F.transform(idx, lambda i: F.struct(
        F.get(F.col("pts"), i).alias("a"),
        F.get(F.col("pts"), (i + 1) % F.size("pts")).alias("b")))
    e = rings.select("region", "poly", "ring", F.posexplode(seg).alias("seg", "_s"))
    e = e.select("region", "poly", "ring", "seg", F.col("_s.a.x").alias("x1"), F.col("_s.a.y").alias("y1"),
                 F.col("_s.b.x").alias("x2"), F.col("_s.b.y").alias("y2"))
    # a closed ring repeats its first point: drop the zero-length closing segment
    return e.where(~((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))))
