"""Threshold rules for air-quality categories (RUL1-RUL3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .encode import CATEGORIES, ORDINAL_1_5

INF = float("inf")

# Closed category bands per pollutant, best to worst.  Bands have
# integer gaps (50 < x < 51 belongs to none).
BANDS = {
    "pm_sepuluh": [(0, 50), (51, 150), (151, 350), (351, 420), (421, INF)],
    "pm_duakomalima": [(0, 15.5), (15.6, 55.4), (55.5, 150.4), (150.5, 250.4), (250.5, INF)],
    "sulfur_dioksida": [(0, 52), (53, 180), (181, 400), (401, 800), (801, INF)],
    "karbon_monoksida": [(0, 4000), (4001, 8000), (8001, 15000), (15001, 30000), (30001, INF)],
    "ozon": [(0, 120), (121, 235), (236, 400), (401, 800), (801, INF)],
    "nitrogen_dioksida": [(0, 80), (81, 200), (201, 400), (401, 1200), (1201, INF)],
}
POLLUTANTS = tuple(BANDS)

# Fixed values: "unhealthy" thresholds of the any-pollutant flag (strictly above).
UNHEALTHY_ABOVE = {
    "pm_sepuluh": 150, "pm_duakomalima": 55.4, "sulfur_dioksida": 180,
    "karbon_monoksida": 8000, "ozon": 235, "nitrogen_dioksida": 200,
}


def band_category(value, pollutant: str, strict_gaps: bool = True,
                  bands: Mapping[str, Sequence[tuple[float, float]]] = BANDS) -> Column:
    """Category of one pollutant value (RUL1).

    ``strict_gaps=True`` reproduces the reference: closed bands, and a value in
    no band (a gap such as 50.5, or a negative value) falls through to the
    worst category.  ``strict_gaps=False`` uses the upper bounds only
    (``x <= 50`` BAIK, ``x <= 150`` SEDANG, ...), so gaps join the lower band.
    NULL stays NULL.
    """
    v = F.col(value) if isinstance(value, str) else value
    expr = None
    for cat, (lo, hi) in zip(CATEGORIES, bands[pollutant]):
        if strict_gaps:
            cond = (v >= F.lit(lo)) if hi == INF else v.between(F.lit(lo), F.lit(hi))
        else:
            cond = F.lit(True) if hi == INF else (v <= F.lit(hi))
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(CATEGORIES[-1])))


def overall_category(cats: Sequence[Column]) -> Column:
    """Worst category over pollutants; no pollutant -> BAIK (RUL2).

    ``greatest`` over the ordinals skips NULLs, which is what is wanted here.
    """
    m = F.create_map(*[x for k, v in ORDINAL_1_5.items() for x in (F.lit(k), F.lit(v))])
    inv = F.create_map(*[x for k, v in ORDINAL_1_5.items() for x in (F.lit(v), F.lit(k))])
    ords = [m[c] for c in cats]
    worst = F.greatest(*ords) if len(ords) > 1 else ords[0]
    return inv[F.coalesce(worst, F.lit(1))]


def rule_category(pollutant_cols: Mapping[str, str] | None = None, strict_gaps: bool = True) -> Column:
    """RUL1 + RUL2 over the listed pollutant columns (pollutant name -> column)."""
    cols = pollutant_cols or {p: p for p in POLLUTANTS}
    return overall_category([band_category(c, p, strict_gaps) for p, c in cols.items()])


def any_unhealthy(pollutant_cols: Mapping[str, str] | None = None,
                  thresholds: Mapping[str, float] = UNHEALTHY_ABOVE) -> Column:
    """1 if any pollutant is above its unhealthy threshold, NULL comparisons false (RUL3)."""
    cols = pollutant_cols or {p: p for p in thresholds}
    out = None
    for p, c in cols.items():
        term = F.coalesce(F.col(c) > F.lit(thresholds[p]), F.lit(False))
        out = term if out is None else (out | term)
    return out.cast("int")
