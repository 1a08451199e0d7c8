"""Pairwise-complete correlations of very wide panels in one aggregate (AGG18 at full width).

The usual forms either copy every row once per feature or carry six aggregates
per (feature, target).  Here a row is one vector: for every column its centred
value (0 where missing), whether it is there, and the square.  The Gram matrix
of these vectors holds, for every pair, the six sums a correlation over
complete pairs needs, so one pass with one partial aggregate per task gives all
of them and no row is copied.  The matrix has (3 x columns)^2 entries whatever
the number of rows, which bounds what reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of one matrix: 3 x 1,200 squared doubles are 104 MB.
MOST_COLUMNS = 1_200


def gram_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One vector per row: centred values, presence flags and squares of ``columns``, in this order.

    Values are centred by the columns' means (one row of parameters, broadcast), which keeps the sums of squares
    from cancelling; correlations do not depend on the centre.
    """
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    # infinite values count as missing: they have no correlation
    x = x.select(*[F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c) for c in x.columns])
    means = x.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m{c}") for c in x.columns])
    x = x.crossJoin(F.broadcast(means))  # a single row by construction
    names = [f"c{i}" for i in range(len(columns))]
    centred = [F.coalesce(F.col(c) - F.col(f"m{c}"), F.lit(0.0)) for c in names]
    there = [F.col(c).isNotNull().cast("double") for c in names]
    squares = [F.coalesce((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")), F.lit(0.0)) for c in names]
    return x.select(array_to_vector(F.array(*centred, *there, *squares)).alias("v"))


def corr_matrix_wide(df: DataFrame, features: Sequence[str], targets: Sequence[str], min_pairs: int = 30) -> DataFrame:
    """One row per feature, one column per target, as ``profile.corr_matrix``: NULL with at most ``min_pairs``
    complete pairs or without variance on either side."""
    columns = list(dict.fromkeys([*features, *targets]))
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"{len(columns)} columns; pass the features in blocks of at most {MOST_COLUMNS - len(targets)}")
    k = len(columns)
    schema = "feature string, " + ", ".join(f"`{t}` double" for t in targets)
    rows = gram_rows(df, columns)
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([(f, *[None] * len(targets)) for f in features], schema)
    g = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), numCols=3 * k).computeGramianMatrix().toArray()
    fi, ti = [columns.index(f) for f in features], [columns.index(t) for t in targets]
    block = lambda a, b: g[np.ix_([a * k + i for i in fi], [b * k + j for j in ti])]
    n, sx, sy, sxy, sxx, syy = block(1, 1), block(0, 1), block(1, 0), block(0, 0), block(2, 1), block(1, 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
        # below the rounding of the sums there is no variance
        flat = (vx <= 1e-12 * np.maximum(sxx, 1e-300)) | (vy <= 1e-12 * np.maximum(syy, 1e-300))
    bad = flat | (n <= min_pairs) | ~np.isfinite(r)
    out = [(f, *[None if bad[i, j] else float(min(1.0, max(-1.0, r[i, j]))) for j in range(len(targets))]) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(out, schema)
