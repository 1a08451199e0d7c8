"""Run registered queries against their DuckDB oracles, like the driver's check.

usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
Prints one line per query: OK / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from panelcast.sources.tables import TABLE_NAMES  # noqa: E402

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
                 "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT",
                 "tinyint": "TINYINT"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def same(x, y, rel: float = 1e-7, near_zero: float = 1e-9) -> bool:
    """Equal, or doubles that differ by the order of a sum at most."""
    if isinstance(x, tuple) and isinstance(y, tuple):
        return len(x) == len(y) and all(same(a, b, rel, near_zero) for a, b in zip(x, y))
    if isinstance(x, float) and isinstance(y, float):
        return x == y or math.isclose(x, y, rel_tol=rel, abs_tol=near_zero)
    return x == y


def _rows(cols, rows):
    """Rows with columns in name order, sorted by the exact columns first, then by coarse doubles."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]

    def key(t):
        exact = tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in t if not isinstance(x, float))
        return exact, tuple((x is None, float(f"{x:.6g}") if isinstance(x, float) else 0.0) for x in t if x is None or isinstance(x, float))

    return sorted(out, key=key)


def compare(spark, con, name, q, sf_dir):
    t0 = time.time()
    sdf = q.build(spark, sf_dir)
    s_cols = sdf.columns
    s_types = [SPARK_TO_DUCK.get(t, t) for _, t in sdf.dtypes]
    s_rows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t0
    if not q.sql:
        return "ROWS", f"{len(s_rows)} rows (no oracle) {ts:.1f}s"
    rel = con.sql(q.sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"cols spark={s_cols} duck={d_cols}")
    else:
        st = dict(zip(s_cols, s_types))
        dt = dict(zip(d_cols, d_types))
        bad = {c: (st[c], dt[c]) for c in s_cols if st[c] != dt[c]}
        if bad:
            problems.append(f"types {bad}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    elif not problems:
        a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
        diff = [(x, y) for x, y in zip(a, b) if not same(x, y)]
        if diff:
            problems.append(f"{len(diff)} value diffs, e.g. spark={diff[0][0]} duck={diff[0][1]}")
    status = "OK" if not problems else "MISMATCH"
    return status, f"{len(s_rows)} rows {ts:.1f}s " + "; ".join(problems)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from panelcast.session import local_session
    from panelcast.plans.catalog import load_all
    spark = local_session(8, 8)
    con = duck(sf_dir)
    reg = load_all()
    counts = {}
    for name, q in sorted(reg.items()):
        if pats and not any(p in name for p in pats):
            continue
        try:
            status, msg = compare(spark, con, name, q, sf_dir)
        except Exception as e:  # report and go on
            status, msg = "ERROR", f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        counts[status] = counts.get(status, 0) + 1
        print(f"{status:8s} {name:45s} {msg}", flush=True)
    print("SUMMARY", counts, flush=True)


if __name__ == "__main__":
    main(sys.argv)
