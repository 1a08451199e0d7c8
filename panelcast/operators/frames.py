"""Series frames that stay parallel when one series is huge.

A panel is a set of series (``keys``) ordered by ``order``.  The obvious plan,
``Window.partitionBy(keys).orderBy(order)``, sends each whole series to one
task: with five stations the job has five tasks, and a station holding a third
of all rows puts a third of the data into one sort.  Two primitives avoid it.

``scan``
    Prefix quantities (forward fill, backward fill, running sum, global row
    index) in two levels.  Rows are cut into ``(keys, bucket)`` pieces, where a
    bucket is a fixed span of ``order`` (default 64 days).  Each piece gets a
    one-row summary (``groupBy``), the summaries are scanned per series (a
    tiny window: one row per bucket), and the carry-in is joined back and
    combined with the in-bucket window.  Every window is partitioned by
    ``(keys, bucket)``, so no task ever holds more than one bucket.

``bounded``
    Row frames of bounded width (lags, rolling statistics) by halo chunks:
    rows are numbered by ``scan``, cut into chunks of ``chunk_rows`` rows, and
    the last ``before`` rows of each chunk are copied into the next chunk
    (flagged as halo).  The window runs per ``(keys, chunk)`` and halo rows are
    dropped again, so results equal the per-series window exactly.

Both keep the keys NOT NULL contract of a panel.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNB_PRE = Window.unboundedPreceding
UNB_FOL = Window.unboundedFollowing


@dataclass(frozen=True)
class SeriesFrame:
    """How a panel splits into ordered series.

    keys        series identity (``station`` or ``station, parameter``)
    order       ordering column, unique within a series (date, timestamp or integer)
    tie         second ordering column where ``order`` repeats within a series
    bucket      width of a scan bucket in order units (64 days of dates, 64 units of
                integers; timestamps, which may hold many rows a day: one day)
    chunk_rows  rows per chunk of a bounded window (grown to the halo if smaller)
    """

    keys: tuple[str, ...] = ("station",)
    order: str = "date"
    tie: str | None = None
    bucket: int | None = None
    chunk_rows: int = 1024
    index: str | None = None

    def with_keys(self, *keys: str) -> "SeriesFrame":
        return replace(self, keys=tuple(keys))

    def with_index(self, index: str) -> "SeriesFrame":
        """The same frame, declaring that ``index`` already holds the 1-based series row
        number (see :func:`add_index`): halo windows then skip their own scan."""
        return replace(self, index=index)

    def series_window(self) -> WindowSpec:
        """Plain per-series window (one task per series): for small, bounded series only."""
        return Window.partitionBy(*self.keys).orderBy(*self.order_by)

    @property
    def order_by(self) -> list[str]:
        return [self.order] + ([self.tie] if self.tie else [])


STATION_DATE = SeriesFrame()


def order_number(df: DataFrame, order: str) -> Column:
    """The order column as a number: days for dates, days and their fraction for timestamps, itself otherwise."""
    dtype = df.schema[order].dataType
    c = F.col(order)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")) / F.lit(86_400_000_000)
    return c.cast("long")


def bucket_of(df: DataFrame, frame: SeriesFrame) -> Column:
    """The scan bucket of a row; the order inside it is that of the full columns."""
    sub_daily = isinstance(df.schema[frame.order].dataType, (T.TimestampType, T.TimestampNTZType))
    return F.floor(order_number(df, frame.order) / F.lit(frame.bucket or (1 if sub_daily else 64)))


def scan(df: DataFrame, frame: SeriesFrame = STATION_DATE, *,
         ffill: Mapping[str, Column] | None = None,
         bfill: Mapping[str, Column] | None = None,
         cumsum: Mapping[str, Column] | None = None,
         last_index: Mapping[str, Column] | None = None,
         row_index: str | None = None) -> DataFrame:
    """Add prefix / suffix columns computed per series in order, in one pass.

    ffill       out -> expr: last non-NULL value of expr at or before the row
    bfill       out -> expr: first non-NULL value of expr at or after the row
    cumsum      out -> expr: running sum (NULL counts as 0)
    last_index  out -> condition: 1-based series row number of the last row at
                or before this one where the condition holds (NULL if none)
    row_index   name of a 1-based series row-number column

    Plan: one hash exchange of the rows on (keys, bucket), read by the in-bucket
    windows and by the bucket summaries (which ask for the same columns, so
    that the exchange is made once); only the summaries (one row per bucket)
    are exchanged by series and joined back.
    Output columns overwrite same-named input columns.
    """
    specs = {"f": dict(ffill or {}), "b": dict(bfill or {}), "s": dict(cumsum or {}),
             "l": dict(last_index or {})}
    keys = list(frame.keys)
    tmp = {}
    for kind, m in specs.items():
        for i, out in enumerate(m):
            tmp[(kind, out)] = f"_pc_{kind}{i}"
    if not tmp and not row_index:
        return df
    d = df.select("*", bucket_of(df, frame).alias("_pc_b"),
                  *[specs[k][out].alias(name) for (k, out), name in tmp.items()])
    d = d.repartition(*keys, "_pc_b")
    rows = d   # what both readers of the exchange start from

    wi = Window.partitionBy(*keys, "_pc_b").orderBy(*frame.order_by)
    fwd = wi.rowsBetween(UNB_PRE, 0)
    bwd = wi.rowsBetween(0, UNB_FOL)
    d = d.withColumn("_pc_r", F.row_number().over(wi))
    part = {}
    for (k, out), name in tmp.items():
        c = F.col(name)
        if k == "f":
            part[name + "_i"] = F.last(c, True).over(fwd)
        elif k == "b":
            part[name + "_i"] = F.first(c, True).over(bwd)
        elif k == "s":
            part[name + "_i"] = F.sum(c).over(fwd)
        else:
            part[name + "_i"] = F.last(F.when(c, F.col("_pc_r")), True).over(fwd)
    d = d.withColumns(part) if part else d

    at = F.struct(*frame.order_by)
    # every column takes part in the mark, so the exchange below is the one the windows read
    hashed = [c for c, t in rows.dtypes if "map<" not in t and t != "variant"]
    aggs = [F.count(F.lit(1)).alias("_pc_n"), F.max(F.xxhash64(*[F.col(f"`{c}`") for c in hashed])).alias("_pc_mark")]
    has_last = any(k == "l" for k, _ in tmp)
    src = rows.withColumn("_pc_r", F.row_number().over(wi)) if has_last else rows
    for (k, out), name in tmp.items():
        c = F.col(name)
        if k == "f":
            aggs.append(F.max_by(c, F.when(c.isNotNull(), at)).alias(name))
        elif k == "b":
            aggs.append(F.min_by(c, F.when(c.isNotNull(), at)).alias(name))
        elif k == "s":
            aggs.append(F.sum(c).alias(name))
        else:
            aggs.append(F.max(F.when(c, F.col("_pc_r"))).alias(name))
    summ = src.groupBy(*keys, "_pc_b").agg(*aggs).where(F.col("_pc_mark").isNotNull())

    wb = Window.partitionBy(*keys).orderBy("_pc_b")
    before, after = wb.rowsBetween(UNB_PRE, -1), wb.rowsBetween(1, UNB_FOL)
    summ = summ.withColumn("_pc_off", F.coalesce(F.sum("_pc_n").over(before), F.lit(0)))
    carries = []
    for (k, out), name in tmp.items():
        c = F.col(name)
        if k == "f":
            carries.append(F.last(c, True).over(before).alias(name + "_c"))
        elif k == "b":
            carries.append(F.first(c, True).over(after).alias(name + "_c"))
        elif k == "s":
            carries.append(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name + "_c"))
        else:
            carries.append(F.last(F.col("_pc_off") + c, True).over(before).alias(name + "_c"))
    summ = summ.select(*keys, "_pc_b", "_pc_off", *carries)

    j = d.join(summ, keys + ["_pc_b"], "left")
    outs = {}
    for (k, out), name in tmp.items():
        inner, carry = F.col(name + "_i"), F.col(name + "_c")
        if k in ("f", "b"):
            outs[out] = F.coalesce(inner, carry)
        elif k == "s":
            outs[out] = carry + F.coalesce(inner, F.lit(0))
        else:
            outs[out] = F.coalesce(F.col("_pc_off") + inner, carry)
    if row_index:
        outs[row_index] = F.col("_pc_off") + F.col("_pc_r")
    keep = [c for c in df.columns if c not in outs]
    return j.select(*keep, *[v.alias(k) for k, v in outs.items()])


def bounded(df: DataFrame, frame: SeriesFrame,
            build: Callable[[WindowSpec], Mapping[str, Column]],
            before: int, after: int = 0, row_index: str | None = None) -> DataFrame:
    """Add columns from row-frame windows that reach at most ``before`` rows back
    and ``after`` rows ahead.

    ``build(w)`` gets a window spec ordered like the series and returns
    ``{name: expression over w}``; frames must be written with
    ``w.rowsBetween(..)`` inside ``[-before, after]`` (``lag``/``lead`` too).
    ``row_index`` (or ``frame.index``) names an existing 1-based series row
    number; without it one is computed with :func:`scan`.
    """
    keys = list(frame.keys)
    row_index = row_index or (frame.index if frame.index and frame.index in df.columns else None)
    rn = row_index or "_pc_rn"
    d = df if row_index else scan(df, frame, row_index=rn)
    size = max(frame.chunk_rows, before, after, 1)
    pos = (F.col(rn) - 1) % F.lit(size)
    chunk = F.floor((F.col(rn) - 1) / F.lit(size))
    own = F.array(F.struct(chunk.alias("c"), F.lit(False).alias("h")))
    nxt = F.when(pos >= F.lit(size - before), F.array(
        F.struct((chunk + 1).alias("c"), F.lit(True).alias("h"))))
    prv = F.when(pos < F.lit(after), F.array(
        F.struct((chunk - 1).alias("c"), F.lit(True).alias("h"))))
    empty = F.array().cast("array<struct<c:bigint,h:boolean>>")
    copies = F.concat(own.cast("array<struct<c:bigint,h:boolean>>"),
                      F.coalesce(nxt, empty) if before > 0 else empty,
                      F.coalesce(prv, empty) if after > 0 else empty)
    x = d.select("*", F.explode(copies).alias("_pc_x"))
    x = x.select(*d.columns, F.col("_pc_x.c").alias("_pc_chunk"),
                 F.col("_pc_x.h").alias("_pc_halo"))
    w = Window.partitionBy(*keys, "_pc_chunk").orderBy(rn)
    exprs = dict(build(w))
    keep = [c for c in d.columns if c not in exprs]
    out = x.select(*keep, "_pc_halo", *[e.alias(n) for n, e in exprs.items()])
    out = out.filter(~F.col("_pc_halo")).drop("_pc_halo")
    if not row_index:
        out = out.drop(rn)
    return out


def add_index(df: DataFrame, frame: SeriesFrame = STATION_DATE, name: str = "_rn") -> tuple[DataFrame, SeriesFrame]:
    """Add the series row number once; return the frame that reuses it in later windows."""
    return scan(df, frame, row_index=name), frame.with_index(name)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by writing to the shared checkpoint folder (never a local checkpoint)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def assert_unique(df: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Raise if ``keys`` repeat (pandas reindex / pivot fail there).  One aggregate job."""
    dup = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {dup[0].asDict()} for {list(keys)}")
    return df
