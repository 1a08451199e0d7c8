"""Helpers shared by the operators of this subpackage: Arrow text access, row keys, checkpoints."""

from __future__ import annotations

import gc
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, release: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    Shuffle files that only the cut lineage needed go when the driver's JVM
    collects its garbage, which by itself may be long after.  With ``release``
    it is asked to do so now; pass ``df`` as an expression of which nothing
    else is kept.
    """
    ensure_checkpoint_dir(df.sparkSession)
    context = df.sparkSession.sparkContext
    out = df.checkpoint(eager=True)
    del df
    for _ in range(2 if release else 0):
        gc.collect()
        time.sleep(0.5)  # Python's references to JVM objects are dropped by another thread
        context._jvm.System.gc()
    return out


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, for loops.

    A checkpoint keeps the planner's size estimate of what it holds; an estimate for joins multiplies those of its sides,
    so in a loop over joins the number itself grows to megabytes.  A table has the size of its files.
    """
    place = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends Arrow batches of a few MB from now on, so that memory does not follow the length of texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def boxed(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def id_bucket(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (the fold rule of the labelled queries; null id -> 0)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % modulus, F.lit(0))


def row_key(*cols: str) -> Column:
    """A key of the row's content: repeated rows share it, rows with null ids keep their own."""
    return F.xxhash64(*[F.col(c) for c in cols])


def binary_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string or binary Arrow array, without copies; null rows have length 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n = len(column)
    null = np.asarray(column.is_null())
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offs, null


def slices(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes (one row at least), to bound numpy temporaries."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """Each row's bytes; None for null."""
    data, offs, null = binary_views(column)
    raw = memoryview(data)
    for i in range(len(offs) - 1):
        yield None if null[i] else bytes(raw[offs[i]:offs[i + 1]])


def segment_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values[starts:ends]`` per segment along axis 0; empty segments give 0."""
    total = np.zeros((len(values) + 1,) + values.shape[1:], np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[ends] - total[starts]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply rounds) on uint64 arrays."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def crc_of_id(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def worker_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker process, shared by the tasks of one operator.

    Another operator's tasks in the same worker start with an empty one, so a
    worker never holds the caches of two.
    """
    import sys
    import types

    name = "panelcast_worker_cache"
    cache = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("cache", {})
    if cache.get("owner") != owner:
        cache.clear()
        cache["owner"] = owner
    return cache
