"""End-to-end flows as queries (Entry 1 with an oracle; Entries 2 and 3 rows-only)."""

from __future__ import annotations

from ...functions import rules as rl
from ...sources import tables as tb
from .. import flows
from . import register
from . import as_double as R
from .ingest import read_air_yearly, stage_air_yearly
from .joins import calendar

POLL = list(rl.POLLUTANTS)
W = "PARTITION BY station ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@register("flow1_clean_air_quality", tb.with_views("panel_air") + """
, k AS (SELECT * FROM panel_air WHERE kategori IS DISTINCT FROM 'TIDAK ADA DATA')
SELECT strftime(date, '%Y-%m-%d') || '_' || station AS ID, date, station, """ + ", ".join(
    f"{R(f'last_value({p} IGNORE NULLS) OVER ({W})')} AS {p}" for p in POLL) + """,
  CASE WHEN kategori IN ('SANGAT TIDAK SEHAT', 'BERBAHAYA') THEN 'TIDAK SEHAT' ELSE kategori END AS kategori
FROM k""")
def flow1_clean_air_quality(spark, d):
    root = stage_air_yearly(spark, d)
    raw = read_air_yearly(spark, root)
    out = flows.clean_air_quality(raw)
    return out.select("ID", "date", "station", *POLL, "kategori")


@register("flow2_air_quality_features", None, note="wide feature frame; families are checked one by one")
def flow2_air_quality_features(spark, d):
    a = tb.panel_air(spark, d)
    return flows.air_quality_features(a)


@register("flow3_forecast_submission", None, note="fitted boosted trees: rows-only")
def flow3_forecast_submission(spark, d):
    a = tb.panel_air(spark, d).drop("n_lines")
    s = tb.panel_ship(spark, d).select("station", "date", "qty_avg", "disc_avg", "tax_avg")
    cal = calendar(spark, d).select("date", "is_holiday_nasional")
    _, sub = flows.forecast_and_classify(a, [s], cal, "2001-08-31", 30,
                                         gbt_params={"maxIter": 5, "maxDepth": 3})
    return sub
