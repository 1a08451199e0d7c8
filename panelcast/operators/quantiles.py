"""Exact quantiles without gathering a group into one task (AGG16, AGG3, AGG17, AGG28).

``percentile`` keeps every value of a group in one aggregation buffer: fine for
a station's few thousand days, fatal for a group holding a third of a large
table (or for one global threshold).  ``quantiles`` keeps the result exact
(linear interpolation between the closest ranks, like pandas ``quantile`` and
Spark ``percentile``):

1. rows become ``(keys, value, count)`` by a partial aggregation, so ties are
   one row however many they are; this table is settled once (checkpoint) and
   read by all later steps;
2. while a range of values (at first: a group) has more than ``RANKED_ROWS``
   distinct ones, a mergeable sketch (``percentile_approx`` on a fixed grid)
   cuts it into ``GRID + 1`` sub-ranges, whose prefix-summed counts name the
   ones that hold a target rank; only these are kept, each a range of its own;
3. the ranges left are ranked, none of them larger than ``RANKED_ROWS``, and
   the two closest ranks are interpolated.

``method='approx'`` returns ``percentile_approx`` directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpoint

#: Range borders per refinement; one less than a power of two, for the binary search.
GRID = 255
#: Distinct values that one task ranks at most.
RANKED_ROWS = 200_000


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, _q_col, _q_v) without NULLs; unpivoted even for one column, so that the name is a key, not a constant."""
    x = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(by), list(cols), "_q_col", "_q_v")
    return x.where(F.col("_q_v").isNotNull())


def quantiles(df: DataFrame, cols: Sequence[str] | str, probs: Sequence[float], by: Sequence[str] = (),
              method: str = "exact", accuracy: int = 10_000, name: str = "{col}_q{p}") -> DataFrame:
    """One row per group of ``by`` with a column per (col, prob).

    Column names default to ``{col}_q{p}`` with ``p`` as given (e.g. ``x_q0.5``);
    pass ``name='{col}_median'`` style templates for single probabilities.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    by, probs = list(by), list(probs)
    keys = by + ["_q_col"]
    long = _long(df, cols, by)

    if method == "approx":
        res = long.groupBy(*keys).agg(F.percentile_approx("_q_v", probs, accuracy).alias("_q_a"))
        res = res.select(*keys, *[F.col("_q_a")[i].alias(f"_q_{i}") for i in range(len(probs))])
    else:
        res = _exact(long, keys, probs, accuracy)
    return _wide(res, by, cols, probs, name)


def _wide(res: DataFrame, by, cols, probs, name) -> DataFrame:
    aggs = [F.first(F.when(F.col("_q_col") == c, F.col(f"_q_{i}")), True).alias(name.format(col=c, p=p))
            for c in cols for i, p in enumerate(probs)]
    if by:
        return res.groupBy(*by).agg(*aggs)
    return res.agg(*aggs)


def _targets(probs):
    def targets(n):
        out = []
        for i, p in enumerate(probs):
            pos = F.lit(float(p)) * (n - 1)
            out.append(F.struct(F.lit(i).alias("i"), F.floor(pos).cast("long").alias("k0"),
                                F.ceil(pos).cast("long").alias("k1"), (pos - F.floor(pos)).alias("f")))
        return F.array(*out)
    return targets


def _between(v0, v1, f):
    """Linear interpolation; equal neighbours stand as they are (infinities have no difference)."""
    return F.when(v0 == v1, v0).otherwise((v1 - v0) * f + v0)


def _exact(long: DataFrame, keys, probs, accuracy) -> DataFrame:
    at = _select_ranks(long, keys, _targets(probs), accuracy)
    val = at.withColumn("_q_x", _between(F.col("_q_v0"), F.col("_q_v1"), F.col("_q_f")))
    return val.groupBy(*keys).agg(*[F.first(F.when(F.col("_q_i") == i, F.col("_q_x")), True).alias(f"_q_{i}")
                                    for i in range(len(probs))])


def winsor_limits(df: DataFrame, cols: Sequence[str], lo: float, hi: float, accuracy: int = 10_000) -> DataFrame:
    """One row: ``_lo_{col}`` and ``_hi_{col}``, the quantiles of each column, and ``_lo2_{col}`` and ``_hi2_{col}``,
    those of the column once it is clipped to the first.

    Clipping keeps the order, so the clipped column's quantiles lie between the same ranks, whose values are clipped.
    """
    at = _select_ranks(_long(df, cols, []), ["_q_col"], _targets([lo, hi]), accuracy)
    x = F.struct(_between(F.col("_q_v0"), F.col("_q_v1"), F.col("_q_f")).alias("x"), F.col("_q_v0").alias("a"), F.col("_q_v1").alias("b"),
                 F.col("_q_f").alias("f"))
    per = at.groupBy("_q_col").agg(*[F.first(F.when(F.col("_q_i") == i, x), True).alias(n) for i, n in enumerate("lh")])
    low, high = F.col("l.x"), F.col("h.x")
    clip = lambda v: F.when(v < low, low).when(v > high, high).otherwise(v)
    again = [_between(clip(F.col(f"{n}.a")), clip(F.col(f"{n}.b")), F.col(f"{n}.f")).alias(f"{n}2") for n in "lh"]
    per = per.select("_q_col", low.alias("l1"), high.alias("h1"), *again)
    names = {"l1": "lo", "h1": "hi", "l2": "lo2", "h2": "hi2"}
    return per.agg(*[F.first(F.when(F.col("_q_col") == c, F.col(k)), True).alias(f"_{n}_{c}") for c in cols for k, n in names.items()])


def kth_smallest(df: DataFrame, col: str, by: Sequence[str], k, accuracy: int = 10_000, out: str = "kth") -> DataFrame:
    """Per group of ``by``: the ``k``-th smallest value of ``col`` (1-based; ``k`` is a
    column expression that may use ``n``, the group's non-NULL count).  Same plan
    as :func:`quantiles`; the column keeps its type.  Groups in which ``k`` is out of range give no row."""
    by = list(by)
    keys = by + ["_q_col"]
    long = df.select(*by, F.col(col).alias(col)).unpivot(by, [col], "_q_col", "_q_v").where(F.col("_q_v").isNotNull())
    kk = k if not isinstance(k, int) else F.lit(k)

    def targets(_):
        rank = (kk - 1).cast("long")
        return F.array(F.struct(F.lit(0).alias("i"), rank.alias("k0"), rank.alias("k1"), F.lit(None).cast("double").alias("f")))

    val = _select_ranks(long, keys, targets, accuracy)
    return val.select(*by, F.col("_q_v0").alias(out))


def _open_ranges(counts: DataFrame, keys, need: DataFrame, accuracy) -> tuple[DataFrame, DataFrame]:
    """One refinement: the values of the sub-ranges that hold a target, and the targets' ranks within them."""
    at = [*keys, "_q_b"]
    grid = [(i + 1) / (GRID + 1) for i in range(GRID)]
    sketch = counts.groupBy(*at).agg(F.percentile_approx("_q_v", grid, accuracy).alias("_q_g"))
    x = counts.join(sketch, at).withColumn("_q_s", F.lit(0))
    step = (GRID + 1) // 2
    while step:   # binary search of the first border that is not below the value
        x = x.withColumn("_q_s", F.col("_q_s") + F.when(F.get("_q_g", F.col("_q_s") + F.lit(step - 1)) < F.col("_q_v"), step).otherwise(0))
        step //= 2
    x = checkpoint(x.drop("_q_g"))
    hist = x.groupBy(*at, "_q_s").agg(F.sum("_q_c").alias("_q_m"))
    before = Window.partitionBy(*at).orderBy("_q_s").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_q_below", F.coalesce(F.sum("_q_m").over(before), F.lit(0)))
    within = (F.col("_q_r") >= F.col("_q_below")) & (F.col("_q_r") < F.col("_q_below") + F.col("_q_m"))
    need = checkpoint(need.join(hist, at).where(within).withColumn("_q_r", F.col("_q_r") - F.col("_q_below")).drop("_q_below", "_q_m"))
    x = x.join(need.select(*at, "_q_s").distinct(), [*at, "_q_s"], "left_semi")
    narrower = (F.col("_q_b") * (GRID + 1) + F.col("_q_s")).alias("_q_b")
    rest = lambda d: d.select(*[c for c in d.columns if c not in ("_q_b", "_q_s")], narrower)
    return checkpoint(rest(x)), rest(need)


def _select_ranks(long: DataFrame, keys, targets, accuracy, most: int | None = None) -> DataFrame:
    """Values ``_q_v0``, ``_q_v1`` at the 0-based ranks ``k0``, ``k1`` of ``targets(n)``, and ``_q_f``."""
    most = most or RANKED_ROWS
    at = [*keys, "_q_b"]
    # distinct values are settled once; all that follows reads them
    x = checkpoint(long.groupBy(*keys, "_q_v").agg(F.count(F.lit(1)).alias("_q_c")).withColumn("_q_b", F.lit(0).cast("bigint")))
    totals = x.groupBy(*at).agg(F.sum("_q_c").alias("n"))
    t = F.col("_q_t")
    side = lambda s, k: F.struct(t["i"].alias("i"), F.lit(s).alias("s"), t[k].alias("r"), t["f"].alias("f"))
    need = totals.withColumn("_q_t", F.explode(targets(F.col("n")))).select(
        *at, "n", F.explode(F.array(side(0, "k0"), side(1, "k1"))).alias("_q_n")).select(
        *at, "n", F.col("_q_n.i").alias("_q_i"), F.col("_q_n.s").alias("_q_side"), F.col("_q_n.r").alias("_q_r"),
        F.col("_q_n.f").alias("_q_f")).where((F.col("_q_r") >= 0) & (F.col("_q_r") < F.col("n"))).drop("n")
    while (x.groupBy(*at).count().agg(F.max("count")).first()[0] or 0) > most:
        x, need = _open_ranges(x, keys, need, accuracy)
    upto = Window.partitionBy(*at).orderBy("_q_v").rowsBetween(Window.unboundedPreceding, 0)
    got = x.withColumn("_q_hi", F.sum("_q_c").over(upto)).join(need, at).where(
        (F.col("_q_r") < F.col("_q_hi")) & (F.col("_q_r") >= F.col("_q_hi") - F.col("_q_c")))
    low, high = (F.max(F.when(F.col("_q_side") == s, F.col("_q_v"))) for s in (0, 1))
    val = got.groupBy(*keys, "_q_i").agg(low.alias("_q_v0"), high.alias("_q_v1"), F.max("_q_f").alias("_q_f"))
    return val.select(*keys, "_q_i", "_q_v0", "_q_v1", "_q_f")
