"""Physical-plan facts for the headline queries -> PLANS.md.

usage: python tests/plan_report.py [sf_dir]
For each query: shuffle exchanges, broadcast exchanges, single-partition
exchanges, window / sort operators, and per Parquet scan the columns read and
the filters pushed.  Uses the plan Spark would run without adaptive
re-planning (AQE can only remove exchanges from it).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402


def facts(df) -> dict:
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)
    scans = []
    for m in re.finditer(r"FileScan parquet [^\[]*\[([^\]]*)\][^\n]*?PushedFilters: \[([^\]]*)\]", plan):
        cols = re.sub(r"#\d+L?", "", m.group(1))
        scans.append((cols, re.sub(r"#\d+L?", "", m.group(2))))
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning)", plan)),
        "reused": len(re.findall(r"ReusedExchange", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "scans": scans,
    }


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from panelcast.plans.catalog import load_all
    from panelcast.session import local_session
    spark = local_session(8, 8)
    reg = load_all()
    out = ["# PLANS - physical plan facts of the headline queries", "",
           f"Generated by `python tests/plan_report.py {sf}` (non-adaptive executed plan).", "",
           "| query | shuffles | reused | broadcasts | single-partition | windows |",
           "| --- | --- | --- | --- | --- | --- |"]
    detail = []
    for name in HEADLINE:
        f = facts(reg[name].build(spark, sf))
        out.append(f"| `{name}` | {f['shuffles']} | {f['reused']} | {f['broadcasts']} | {f['single_partition']} | "
                   f"{f['windows']} |")
        detail.append(f"\n### `{name}`\n")
        seen = set()
        for cols, pf in f["scans"]:
            if (cols, pf) in seen:
                continue
            seen.add((cols, pf))
            detail.append(f"* reads `{cols}`; pushed `{pf or '-'}`")
    print("\n".join(out + ["", "## Parquet scans (columns read, filters pushed)"] + detail))


if __name__ == "__main__":
    main(sys.argv)
