"""Point-in-polygon and nearest-region joins on an edge table (JN12, JN13).

Boundaries are a dimension (a few regions, at most thousands of edges); points
grow with the data.  Neither join pairs every point with every edge:

* ``within`` buckets edges into horizontal bands and joins points to the edges
  of their own band only (equi-join on the band, then the ray-crossing test);
  a point is inside a region when its rightward ray crosses an odd number of
  that region's edges (holes and multipolygons need no special case).
* ``nearest`` (for points inside no region) searches square rings of grid
  cells around each point, growing the ring until the best distance found is
  provably the global minimum (``d <= r * cell``).

How the edge tables are joined is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _bbox(edges: DataFrame) -> tuple[float, float, float, float]:
    r = edges.agg(F.least(F.min("x1"), F.min("x2")).alias("x0"), F.greatest(F.max("x1"), F.max("x2")).alias("x1"),
                  F.least(F.min("y1"), F.min("y2")).alias("y0"), F.greatest(F.max("y1"), F.max("y2")).alias("y1")
                  ).first()
    return r["x0"], r["x1"], r["y0"], r["y1"]


def crosses(px: Column, py: Column) -> Column:
    """Does the rightward ray from (px, py) cross the edge (x1,y1)-(x2,y2)?"""
    x1, y1, x2, y2 = F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")
    straddle = (y1 > py) != (y2 > py)
    xcross = (x2 - x1) * (py - y1) / (y2 - y1) + x1
    return straddle & (px < xcross)


def within(points: DataFrame, edges: DataFrame, pid: str = "id", x: str = "x", y: str = "y",
           bands: int = 64) -> DataFrame:
    """``(pid, region)`` for every point strictly inside a region (JN12)."""
    x0, x1, y0, y1 = _bbox(edges)
    if x0 is None:
        return points.limit(0).select(F.col(pid), F.lit("").alias("region"))
    h = (y1 - y0) / bands if y1 > y0 else 1.0
    band_of = lambda v: F.floor((v - F.lit(y0)) / F.lit(h)).cast("int")
    eb = edges.select("region", "x1", "y1", "x2", "y2",
                      F.explode(F.sequence(band_of(F.least("y1", "y2")), band_of(F.greatest("y1", "y2")))).alias("_band"))
    pts = points.select(F.col(pid).alias("_pid"), F.col(x).alias("_px"), F.col(y).alias("_py")) \
                .where((F.col("_py") >= y0) & (F.col("_py") <= y1) & (F.col("_px") <= x1)) \
                .withColumn("_band", band_of(F.col("_py")))
    j = pts.join(eb, "_band")
    hits = j.where(crosses(F.col("_px"), F.col("_py")))
    par = hits.groupBy("_pid", "region").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") % 2 == 1)
    return par.select(F.col("_pid").alias(pid), "region")


def segment_distance(px: Column, py: Column) -> Column:
    """Euclidean distance from (px, py) to the segment (x1,y1)-(x2,y2)."""
    x1, y1, x2, y2 = F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")
    dx, dy = x2 - x1, y2 - y1
    ll = dx * dx + dy * dy
    t = F.when(ll == 0, F.lit(0.0)).otherwise(((px - x1) * dx + (py - y1) * dy) / ll)
    t = F.when(t < 0, F.lit(0.0)).when(t > 1, F.lit(1.0)).otherwise(t)
    cx, cy = x1 + t * dx, y1 + t * dy
    return F.sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy))


def nearest(points: DataFrame, edges: DataFrame, counts: DataFrame | None = None, pid: str = "id",
            x: str = "x", y: str = "y", grid: int = 32) -> DataFrame:
    """``(pid, region, distance)``: the region with the nearest boundary (JN13).

    The search starts at the grid cell nearest to the point and widens ring by
    ring; every round joins only the cells of the new ring that lie inside the
    grid, so a point far outside costs no more than the grid's cells.  Whatever
    lies beyond ring r is at least ``r * cell`` away, which ends the search.
    Ties are broken by the region's initial point count (fewer first) and then
    by name; the reference updates the counts while assigning, which only
    matters on exact ties.  Without edges there is no region: no rows.
    """
    x0, x1, y0, y1 = _bbox(edges)
    if x0 is None:
        return points.limit(0).select(F.col(pid), F.lit("").alias("region"), F.lit(0.0).alias("distance"))
    cs = max(x1 - x0, y1 - y0) / grid or 1.0
    cell = lambda v, low: F.floor((v - F.lit(low)) / F.lit(cs)).cast("int")
    ec = edges.select("region", "x1", "y1", "x2", "y2",
                      F.explode(F.sequence(cell(F.least("x1", "x2"), x0), cell(F.greatest("x1", "x2"), x0))).alias("_cx"))
    ec = ec.select("*", F.explode(F.sequence(cell(F.least("y1", "y2"), y0), cell(F.greatest("y1", "y2"), y0))).alias("_cy"))
    cnt = counts if counts is not None else edges.select("region").distinct().withColumn("n", F.lit(0))
    cnt = cnt.select("region", F.col(cnt.columns[1]).cast("long").alias("_cnt"))
    ec = ec.join(cnt, "region", "left").withColumn("_cnt", F.coalesce("_cnt", F.lit(0)))
    last_x, last_y = int((x1 - x0) // cs), int((y1 - y0) // cs)
    near = lambda v, low, top: F.greatest(F.lit(0), F.least(F.lit(top), F.floor((v - F.lit(low)) / F.lit(cs)))).cast("int")

    todo = points.select(F.col(pid).alias("_pid"), F.col(x).alias("_px"), F.col(y).alias("_py")).withColumns(
        {"_qx": near(F.col("_px"), x0, last_x), "_qy": near(F.col("_py"), y0, last_y),
         "_b": F.lit(None).cast("struct<d:double,n:bigint,region:string>")})
    ensure_checkpoint_dir(points.sparkSession)
    found, r, done = None, 2, -1
    while True:
        span = lambda q, top, r=r: F.explode(F.sequence(F.greatest(F.col(q) - r, F.lit(0)), F.least(F.col(q) + r, F.lit(top))))
        ring = todo.select("_pid", "_px", "_py", "_qx", "_qy", span("_qx", last_x).alias("_cx")).select(
            "*", span("_qy", last_y).alias("_cy")).where(
            F.greatest(F.abs(F.col("_cx") - F.col("_qx")), F.abs(F.col("_cy") - F.col("_qy"))) > done)
        got = ring.join(ec, ["_cx", "_cy"]).groupBy("_pid").agg(
            F.min(F.struct(segment_distance(F.col("_px"), F.col("_py")).alias("d"), F.col("_cnt").alias("n"), "region")).alias("_new"))
        todo = todo.join(got, "_pid", "left").withColumn("_b", F.least("_b", "_new")).drop("_new").checkpoint(eager=True)
        last = r >= max(last_x, last_y) + 1
        ok = todo.where(F.col("_b").isNotNull() if last else F.col("_b.d") <= F.lit(r * cs))
        ok = ok.select("_pid", F.col("_b.region").alias("region"), F.col("_b.d").alias("distance"))
        found = ok if found is None else found.unionByName(ok)
        if last:
            break
        todo = todo.where(F.col("_b").isNull() | (F.col("_b.d") > F.lit(r * cs)))
        if todo.isEmpty():
            break
        done, r = r, r * 2
    return found.select(F.col("_pid").alias(pid), "region", "distance")


def assign_regions(points: DataFrame, edges: DataFrame, pid: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """Region of every point: inside-polygon first, nearest boundary for the rest
    (JN12 + JN13).  Returns ``pid, region, method`` (``within`` / ``nearest``)."""
    ensure_checkpoint_dir(points.sparkSession)
    edges = edges.checkpoint(eager=True)          # boundary dimension: parsed once
    inside = within(points, edges, pid, x, y).checkpoint(eager=True)
    counts = inside.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    rest = points.join(inside.select(pid), pid, "left_anti")
    near = nearest(rest, edges, counts, pid, x, y)
    return (inside.withColumn("method", F.lit("within"))
                  .unionByName(near.select(pid, "region", F.lit("nearest").alias("method"))))
