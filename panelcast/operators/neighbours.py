"""Exact nearest neighbours by bounded cells (the neighbour search of ML14).

Rows of equal position are one point (at most ``k + 1`` of its ids are needed).
A kd-tree over a bounded sample cuts space into cells of about ``cell_rows``
points.  Every point first meets the points of its own cell; its k-th distance
there bounds how far a nearer one can be, and only cells whose tight box is
closer than that are searched as well, each by the points that ask for it, in
blocks.  So no two points far apart are ever compared, and a task holds one
cell and one block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpoint

CELL_ROWS = 2_000
MOST_CELLS = 1 << 14      # boxes that are broadcast: two doubles per feature each
SAMPLE_PER_CELL = 16
BLOCK = 20_000            # asking points that meet a cell at once
STEP = 1 << 22            # distances held at once

_FOUND = "p long, d array<double>, q array<long>"


def _tree(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """(dimension, border) of every inner node, breadth first; 2 ** depth leaves."""
    out, level = [], [sample]
    while len(level) < cells:
        below = []
        for part in level:
            if len(part):
                dim = int(np.argmax(part.max(0) - part.min(0)))
                border = float(np.median(part[:, dim]))
            else:
                dim, border = 0, 0.0
            out.append((dim, border))
            left = part[:, dim] <= border if len(part) else np.zeros(0, bool)
            below += [part[left], part[~left]]
        level = below
    return out


def _cells_of(x: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    dims, borders = (np.array([t[i] for t in tree]) for i in (0, 1))
    while len(tree) and len(at) and at.max() < len(tree):
        at = 2 * at + 1 + (x[np.arange(len(x)), dims[at]] > borders[at])
    return at - len(tree)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def _placed(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("cell", pa.array(_cells_of(_matrix(b.column("x")), tree)))
    return run


def _nearest(asked_p: np.ndarray, asked: np.ndarray, own_p: np.ndarray, own: np.ndarray, k: int) -> pa.Table:
    """The k nearest (by distance, then point) of ``own`` for every asked point."""
    ps, ds, qs = [], [], []
    step = max(1, STEP // max(len(own), 1))
    for i in range(0, len(asked), step):
        part = asked[i:i + step]
        d = np.zeros((len(part), len(own)))
        for j in range(asked.shape[1]):
            d += (part[:, j, None] - own[None, :, j]) ** 2
        take = min(k, len(own))
        limit = np.partition(d, take - 1, axis=1)[:, take - 1]
        for r in range(len(part)):
            at = np.flatnonzero(d[r] <= limit[r])
            at = at[np.lexsort((own_p[at], d[r, at]))][:take]
            ps.append(asked_p[i + r])
            ds.append(d[r, at].tolist())
            qs.append(own_p[at].tolist())
    return pa.table({"p": pa.array(ps, pa.int64()), "d": pa.array(ds, pa.list_(pa.float64())), "q": pa.array(qs, pa.list_(pa.int64()))})


def nearest_neighbours(df: DataFrame, id_col: str, features: Sequence[str], k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(_a, _b, _dist, _nr)``: the ``k`` nearest other rows of every row, by Euclidean distance, ties to the smaller id.

    Rows with a null or NaN feature have no position and take no part.  ``id_col`` is a unique long.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    rows = rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    first = Window.partitionBy("x").orderBy("_id")
    points = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).groupBy("x").agg(
        F.sort_array(F.collect_list("_id")).alias("ids")).withColumn("p", F.col("ids")[0])  # a point is named by its smallest id
    points = checkpoint(points)
    n = points.count()
    cells = 1
    while cells * cell_rows < n and cells < MOST_CELLS:
        cells *= 2
    sample = points.select("x").orderBy(F.xxhash64("p")).limit(cells * SAMPLE_PER_CELL).toArrow() if cells > 1 else None
    tree = _tree(_matrix(sample.column("x")), cells) if sample is not None else []
    placed = checkpoint(points.select("p", "x").mapInArrow(_placed(tree), "p long, x array<double>, cell long"))

    def own_cell(t: pa.Table) -> pa.Table:
        p, x = t.column("p").to_numpy(), _matrix(t.column("x"))
        return _nearest(p, x, p, x, k + 1)

    found = checkpoint(placed.groupBy("cell").applyInArrow(own_cell, _FOUND))
    width = range(len(features))
    box = placed.groupBy("cell").agg(*[F.min(F.col("x")[i]).alias(f"lo{i}") for i in width], *[F.max(F.col("x")[i]).alias(f"hi{i}") for i in width]).toArrow()
    names, low, high = box.column("cell").to_numpy(), *(np.stack([box.column(f"{e}{i}").to_numpy() for i in width], 1) if box.num_rows else
                                                        np.zeros((0, len(features))) for e in ("lo", "hi"))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(p, x, cell) for every other cell that may hold a nearer point."""
        for b in batches:
            x, own, p = _matrix(b.column("x")), b.column("cell").to_numpy(), b.column("p").to_numpy()
            reach = np.array([d[k] if len(d) > k else np.inf for d in b.column("d").to_pylist()])
            step = max(1, STEP // max(len(names) * max(x.shape[1], 1), 1))
            for i in range(0, len(x), step):
                y = x[i:i + step, None, :]
                gap = (np.maximum(np.maximum(low[None] - y, y - high[None]), 0) ** 2).sum(2)
                r, c = np.nonzero((gap <= reach[i:i + step, None]) & (names[None] != own[i:i + step, None]))
                yield pa.RecordBatch.from_pydict({"p": pa.array(p[i + r]), "x": pa.array(x[i + r].tolist(), pa.list_(pa.float64())),
                                                  "cell": pa.array(names[c])})

    asks = checkpoint(placed.join(found.select("p", "d"), "p").mapInArrow(asking, "p long, x array<double>, cell long"))
    blocks = asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = asks.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int").alias("block"), "p", "x")
    held = placed.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "p", "x")

    def other_cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"p": pa.array([], pa.int64()), "d": pa.array([], pa.list_(pa.float64())), "q": pa.array([], pa.list_(pa.int64()))})
        return _nearest(a.column("p").to_numpy(), _matrix(a.column("x")), b.column("p").to_numpy(), _matrix(b.column("x")), k + 1)

    more = dealt.groupBy("cell", "block").cogroup(held.groupBy("cell", "block")).applyInArrow(other_cell, _FOUND)
    every = found.unionByName(more).select("p", F.explode(F.arrays_zip("d", "q")).alias("z")).select("p", "z.d", "z.q")
    best = every.withColumn("_r", F.row_number().over(Window.partitionBy("p").orderBy("d", "q"))).where(F.col("_r") <= k + 1)
    # back to rows: the ids of the nearest points, without the row's own
    ids = best.join(points.select(F.col("p").alias("q"), "ids"), "q").select("p", "d", F.explode("ids").alias("_b"))
    mine = rows.join(points.select("x", "p"), "x").select(F.col("_id").alias("_a"), "p")
    pairs = mine.join(ids, "p").where(F.col("_a") != F.col("_b")).select("_a", "_b", F.sqrt("d").alias("_dist"))
    ranked = pairs.withColumn("_nr", F.row_number().over(Window.partitionBy("_a").orderBy("_dist", "_b")))
    return ranked.where(F.col("_nr") <= k)
