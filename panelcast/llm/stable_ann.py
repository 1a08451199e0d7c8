"""Approximate nearest neighbours by few stable projections, a kd-tree and a chi-square stopping test.

Unit vectors are projected with ``PROJECTIONS`` Gaussian (2-stable) directions,
so a squared projected distance over the squared true distance follows a
chi-square law with that many degrees of freedom.  A kd-tree over the
projected points hands out neighbours in order of projected distance; each is
verified on its original vector, and the search ends when a point as near as
the present k-th neighbour would have come by now with probability
``CONFIDENCE``.

Scale: repeated rows are dropped, the others are dealt into blocks of about
``BLOCK`` by a hash, queries into chunks of about ``CHUNK``; a task indexes one block and searches it for one
chunk, so its memory is bounded whatever the table; the k best of every block
are then ranked per query.

Defined results: vectors null, zero, or with null or non-finite components
take no part; rows of another dimension than the query's are no candidates;
repeated rows of an id count once, at their best score; ties go to the
smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 8  # even: the chi-square law then has a closed form
CONFIDENCE = 0.95
BLOCK, CHUNK, LEAF = 16_384, 1_024, 512


def directions(dim: int, m: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


def chi_square_cdf(x: float, m: int = PROJECTIONS) -> float:
    """P(chi-square with an even number m of degrees of freedom <= x)."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= half / (i + 1)
    return 1.0 - math.exp(-half) * total


class KdTree:
    """Median splits on the widest side; every node keeps its bounding box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (box low, box high, left, right, start, end)
        stack = [(0, len(points), None)]
        while stack:
            a, b, parent = stack.pop()
            own = points[self.order[a:b]]
            low, high = own.min(0), own.max(0)
            me = len(self.nodes)
            self.nodes.append([low, high, -1, -1, a, b])
            if parent is not None:
                self.nodes[parent[0]][parent[1]] = me
            side = int(np.argmax(high - low))
            if b - a > leaf and high[side] > low[side]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, side], mid, kind="introselect")]
                stack += [(a, a + mid, (me, 2)), (a + mid, b, (me, 3))]
        self.points = points[self.order]

    def attach(self, unit: np.ndarray, ids: np.ndarray) -> "KdTree":
        """Keep the unit vectors and ids in the tree's order."""
        self.unit, self.ids = unit[self.order], ids[self.order]
        self.repeated = len(np.unique(ids)) < len(ids)
        return self

    def box_distance(self, node: int, q: np.ndarray) -> float:
        low, high = self.nodes[node][:2]
        gap = q - np.minimum(np.maximum(q, low), high)
        return float(gap @ gap)


def search(tree: KdTree, vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, q: np.ndarray, q_id: int, low: np.ndarray,
           k: int, confidence: float = CONFIDENCE) -> list[tuple[float, int]]:
    """The k best (cosine, id) of the block, best first."""
    q_norm = math.sqrt(float((q * q).sum()))
    unit_q = q / q_norm
    heap = [(tree.box_distance(0, low), 0)]
    wait_d, wait_i = np.zeros(0), np.zeros(0, np.int64)
    best: list[tuple[float, int]] = []  # (-cosine, id)

    def verify(rows: np.ndarray) -> None:
        """Screen by unit vectors in one product; what may enter the k best is scored on its original vector."""
        nonlocal best
        near = tree.unit[rows] @ unit_q
        near[tree.ids[rows] == q_id] = -2
        floor = -best[-1][0] if len(best) == k else -1.5
        each = near  # one value an id: rows of one id must not use up the k places
        if tree.repeated:
            own, at = np.unique(tree.ids[rows], return_inverse=True)
            each = np.full(len(own), -2.0)
            np.maximum.at(each, at, near)
        if len(each) > k:
            floor = max(floor, float(np.partition(each, len(each) - k)[len(each) - k]))
        at = tree.order[rows[near >= floor - 1e-12]]
        at = at[ids[at] != q_id]
        if len(at):
            cos = (vectors[at] * q).sum(1) / (norms[at] * q_norm)
            found = {i: s for s, i in best}
            for s, i in zip((-cos).tolist(), ids[at].tolist()):
                if s < found.get(i, math.inf):
                    found[i] = s
            best = sorted((s, i) for i, s in found.items())[:k]

    while heap:
        reach, node = heapq.heappop(heap)
        due = wait_d <= reach
        if due.any():
            verify(wait_i[due])
            wait_d, wait_i = wait_d[~due], wait_i[~due]
        if len(best) == k:
            kth = max(2 + 2 * best[-1][0], 1e-12)  # squared distance of unit vectors
            if chi_square_cdf(reach / kth) >= confidence:
                return [(-s, i) for s, i in best]
        _, _, left, right, a, b = tree.nodes[node]
        if left < 0:
            gap = tree.points[a:b] - low
            wait_d = np.concatenate([wait_d, (gap * gap).sum(1)])
            wait_i = np.concatenate([wait_i, np.arange(a, b)])
        else:
            for child in (left, right):
                heapq.heappush(heap, (tree.box_distance(child, low), child))
    if len(wait_i):
        verify(wait_i)
    return [(-s, i) for s, i in best]


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("v").combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(t.num_rows, -1)


def _searcher(k: int, confidence: float):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if rows.num_rows and queries.num_rows:
            x, q = _matrix(rows), _matrix(queries)
            norms, q_norms = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            r = directions(x.shape[1])
            ids, unit = np.asarray(rows.column("vec_id")), x / norms[:, None]
            tree = KdTree(unit @ r).attach(unit, ids)
            low = (q / q_norms[:, None]) @ r
            for j, q_id in enumerate(queries.column("vec_id").to_pylist()):
                for score, i in search(tree, x, norms, ids, q[j], q_id, low[j], k, confidence):
                    out[0].append(q_id)
                    out[1].append(i)
                    out[2].append(score)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    return run


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part."""
    v = F.col(f"`{vec}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn(
        "dim", F.size("v"))


def _share(n: int, each: int) -> int:
    return max(1, -(-n // each))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, confidence: float = CONFIDENCE, vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` holds."""
    rows = usable(vectors, vec).distinct()  # copies of a row hash alike: they would pile up in one block
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, chunks = _share(sizes["n"], BLOCK), _share(sizes["q"], CHUNK)
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    chunk = F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(chunks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", block).withColumn("chunk", every(chunks))
    right = rows.filter(is_query).dropDuplicates(["vec_id"]).withColumn("chunk", chunk).withColumn("block", every(blocks))
    key = ["dim", "block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _searcher(k, confidence), "query_id long, vec_id long, score double")
    # a query has at most k rows per block here
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_fiftieths(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Queries are the rows whose id is divisible by 50."""
    return nearest(vectors, F.col("vec_id") % 50 == 0, k)
