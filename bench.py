"""Headline-query benchmark.

Runs a fixed set of registered queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is built and its whole result written to Spark's ``noop`` sink (so
no computed column is pruned) after one warm-up run of the flagship query (JVM
start-up excluded); jobs that run while a query is built are inside its time.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "win12_days_since_update",        # flagship: densify + ffill + staleness + rolling
    "jn10_asof_reindex",
    "win6_rolling_mean",
    "win7_rolling_std",
    "win15_dry_wet_spells",
    "jn1_multiway_left_join",
    "agg3_median_and_mean",
    "agg16_exact_quantiles",
    "agg17_series_statistics",
    "agg18_corr_matrix",
    "mth5_spike_flags",
    "rul2_overall_category",
    "imp5_winsorise_train_forecast",
    "imp9_forecast_bounds",
    "jn13_nearest_region_fallback",
    "ml5_stratified_split_counts",
    "ml12_ar1_fallback_forecast",
    "src1_src2_src3_yearly_files",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from panelcast.plans.catalog import load_all
    from panelcast.session import local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    reg = load_all()
    reg["win12_days_since_update"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
