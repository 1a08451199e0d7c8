"""Schema harmonisation and column-set operators (PRJ1-PRJ13, SET1-SET4).

Column decisions are made at plan time from ``df.schema`` (no job), and
applied as one ``select`` per step so wide plans stay small.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def q(name: str) -> Column:
    """Column by exact name (backticks: names may hold dots, spaces or units)."""
    return F.col(f"`{name}`")


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename present columns only (PRJ1: one map per layout family)."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def harmonise(frames: Sequence[DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Union by name, missing columns as NULL, canonical order (PRJ3, SET1)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if columns is None:
        return out
    have = set(out.columns)
    return out.select(*[q(c) if c in have else F.lit(None).alias(c) for c in columns])


def standardise_names(c, aliases: Mapping[str, str], keep_unknown: bool = True) -> Column:
    """Upper-cased name -> canonical name through an alias dictionary (PRJ2, long format)."""
    col = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    m = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k.upper()), F.lit(v))])
    return F.coalesce(m[col], col) if keep_unknown else m[col]


def first_present(df: DataFrame, candidates: Sequence[str], out: str, required: bool = True) -> DataFrame:
    """Use the first candidate column that exists, renamed to ``out`` (PRJ4)."""
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, out) if c != out else df
    if required:
        raise ValueError(f"none of {list(candidates)} in {df.columns}")
    return df.withColumn(out, F.lit(None).cast("string"))


def order_columns(df: DataFrame, meta: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """meta columns, then ``first`` columns, then the rest in their order (PRJ5)."""
    lead = [c for c in list(meta) + list(first) if c in df.columns]
    rest = [c for c in df.columns if c not in lead]
    return df.select(*[q(c) for c in lead + rest])


def feature_columns(df: DataFrame, meta: Sequence[str] = (), targets: Sequence[str] = (),
                    exclude: Sequence[str] = (), patterns: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are not meta / target / excluded and match no pattern (PRJ6)."""
    skip = set(meta) | set(targets) | set(exclude)
    rx = [re.compile(p) for p in patterns]
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in skip and not any(r.search(f.name) for r in rx)]


def drop_dominant(features: Sequence[str], target: str, patterns: Sequence[str] = ("_rolling_1", "_rolling_3"),
                  keep: Sequence[str] = ()) -> list[str]:
    """Drop the target's own short-window features, then re-append ``keep`` (its lags),
    de-duplicated in order (PRJ7)."""
    out = [f for f in features if not (f.startswith(target) and any(p in f for p in patterns))]
    seen: set[str] = set()
    return [f for f in out + list(keep) if not (f in seen or seen.add(f))]


def with_id(df: DataFrame, date: str = "date", station: str = "station", out: str = "ID") -> DataFrame:
    """``ID = yyyy-MM-dd_station`` (PRJ8)."""
    return df.withColumn(out, F.concat_ws("_", F.date_format(date, "yyyy-MM-dd"), F.col(station)))


UNIT_RE = re.compile(r"\s*\([^)]*\)\s*$")


def strip_units(df: DataFrame) -> DataFrame:
    """'temperature_2m_mean (°C)' -> 'temperature_2m_mean' (PRJ9)."""
    return df.select(*[q(c).alias(UNIT_RE.sub("", c)) for c in df.columns])


def column_diff(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns only in a / only in b / in both (PRJ11, SET2 on schemas)."""
    sa, sb = list(a.columns), list(b.columns)
    return {"only_a": [c for c in sa if c not in sb], "only_b": [c for c in sb if c not in sa],
            "both": [c for c in sa if c in sb]}


def assert_same_columns(a: DataFrame, b: DataFrame) -> None:
    """Raise unless both have the same column list in the same order (PRJ11)."""
    if list(a.columns) != list(b.columns):
        raise ValueError(f"schemas differ: {column_diff(a, b)}")


def derived_from(features: Sequence[str], parents: Sequence[str], extra: Sequence[str] = ()) -> list[str]:
    """Features generated from the selected parents (base, lags, rolling, change) plus ``extra``
    (PRJ12)."""
    out = [f for f in features if any(f == p or f.startswith(p + "_") for p in parents)]
    return out + [f for f in extra if f in features and f not in out]


def families(columns: DataFrame, patterns: Mapping[str, str], name_col: str = "column") -> DataFrame:
    """Count columns per family by first matching pattern (PRJ13); ``columns`` is a
    DataFrame of names."""
    fam = None
    for fam_name, pat in patterns.items():
        cond = F.col(name_col).rlike(pat)
        fam = F.when(cond, F.lit(fam_name)) if fam is None else fam.when(cond, F.lit(fam_name))
    fam = fam.otherwise(F.lit("other"))
    return columns.groupBy(fam.alias("family")).agg(F.count(F.lit(1)).alias("n_features"))


def key_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a and b, a minus b, b minus a) on key tuples (SET2)."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    return ka.intersect(kb), ka.exceptAll(kb), kb.exceptAll(ka)


def ordered_top(must: Sequence[str], ranked: DataFrame, n: int, name: str = "feature",
                score: str = "score") -> DataFrame:
    """Must-have names first, then the best-scored ones, without duplicates, cut to n (SET3)."""
    spark = ranked.sparkSession
    m = spark.createDataFrame([(x, i) for i, x in enumerate(must)], f"{name} string, _rank int")
    w = Window.orderBy(F.col(score).desc_nulls_last(), q(name))
    r = ranked.select(q(name).alias(name), (F.row_number().over(w) - 1 + len(must)).alias("_rank"))
    u = m.unionByName(r).groupBy(name).agg(F.min("_rank").alias("_rank"))
    return u.orderBy("_rank").limit(n).select(name, (F.col("_rank") + 1).alias("position"))


def prefer_sources(df: DataFrame, keys: Sequence[str], priority: str) -> DataFrame:
    """One row per key from the source with the lowest priority number (SET4).

    ``min_by`` of the whole row is a partial aggregate, so overlapping sources
    are resolved map-side.
    """
    others = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*[q(c) for c in others]), F.col(priority)).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in others])
