"""Category encodings (ENC1-ENC4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Air-quality categories, best to worst, and their encodings.
CATEGORIES = ("BAIK", "SEDANG", "TIDAK SEHAT", "SANGAT TIDAK SEHAT", "BERBAHAYA")
ORDINAL_1_5 = {"BAIK": 1, "SEDANG": 2, "TIDAK SEHAT": 3, "SANGAT TIDAK SEHAT": 4, "BERBAHAYA": 5}
ORDINAL_0_4 = {"BAIK": 0, "SEDANG": 1, "TIDAK SEHAT": 2, "SANGAT TIDAK SEHAT": 3, "BERBAHAYA": 4}
SIMPLE_0_2 = {"BAIK": 0, "SEDANG": 1, "TIDAK SEHAT": 2}
SEVERE = ("SANGAT TIDAK SEHAT", "BERBAHAYA")
UNHEALTHY = ("TIDAK SEHAT", "SANGAT TIDAK SEHAT", "BERBAHAYA")
NO_DATA_LABEL = "TIDAK ADA DATA"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c, mapping: Mapping) -> Column:
    """Dictionary lookup; unknown / NULL -> NULL (ENC1).  A literal map, so no join."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(c)]


def ordinal(c, mapping: Mapping[str, int] = ORDINAL_1_5) -> Column:
    return lookup(c, mapping)


def decode(c, mapping: Mapping[str, int] = SIMPLE_0_2) -> Column:
    """Inverse of :func:`ordinal`."""
    return lookup(c, {v: k for k, v in mapping.items()})


def collapse_category(c) -> Column:
    """SANGAT TIDAK SEHAT and BERBAHAYA -> TIDAK SEHAT (ENC4); others unchanged."""
    c = _c(c)
    return F.when(c.isin(*SEVERE), F.lit("TIDAK SEHAT")).otherwise(c)


def is_unhealthy_label(c) -> Column:
    """Category in the three unhealthy ones as 0/1 (FLT4)."""
    return F.coalesce(_c(c).isin(*UNHEALTHY), F.lit(False)).cast("int")


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """0-based code by sorted distinct value (ENC2).

    The code table is ``distinct`` + ``dense_rank`` over the distinct values
    only (one row per value), joined back.  NULL stays NULL.
    """
    out = out or f"{col}_encoded"
    codes = (df.select(col).where(F.col(col).isNotNull()).distinct()
               .withColumn(out, (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int")))
    return df.join(codes, col, "left")


def one_hot(c, values: Sequence[str], prefix: str) -> dict[str, Column]:
    """0/1 column per listed value (ENC3); values are listed, so no job is needed to find them."""
    c = _c(c)
    return {f"{prefix}_{v}": F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)) for v in values}
