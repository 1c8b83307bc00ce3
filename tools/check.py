"""Run registered queries and compare with their SQL in DuckDB.

usage: python tools/check.py SF_DIR [name-prefix ...]
"""

import glob
import importlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from voxelmeter.plans import registry  # noqa: E402
from voxelmeter.session import build_session  # noqa: E402


def canon(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in v.items()) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return repr(float(v))
    return str(v)


def main():
    sf, names = sys.argv[1], sys.argv[2:]
    mods = [a[2:] for a in names if a.startswith("m:")]
    names = [a for a in names if not a.startswith("m:")]
    if mods:
        for m in mods:
            importlib.import_module(f"voxelmeter.plans.{m}")
    else:
        registry.load()
    spark = build_session(cores=8, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    bad = 0
    for name, fn in registry.QUERIES.items():
        if names and not any(name == n or name.startswith(n + "_") or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            continue
        dt = time.time() - t
        plan = df._jdf.queryExecution().executedPlan().toString()
        odd = {k: plan.count(k) for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in plan}
        if odd:
            print(f"plan  {name}: {odd}", flush=True)
        if name not in registry.ORACLES:
            print(f"rows  {name}: {len(rows)} rows {dt:.1f}s", flush=True)
            continue
        t = time.time()
        try:
            cur = con.execute(registry.ORACLES[name])
            cols = [c[0] for c in cur.description]
            other = cur.fetchall()
        except Exception as e:
            bad += 1
            print(f"SQLERR {name}: {str(e)[:900]}", flush=True)
            continue
        dd = time.time() - t
        if sorted(cols) != sorted(df.columns):
            bad += 1
            print(f"COLS  {name}: spark {sorted(df.columns)} sql {sorted(cols)}", flush=True)
            continue
        order = sorted(cols)
        a = sorted(tuple(canon(r[df.columns.index(c)]) for c in order) for r in rows)
        b = sorted(tuple(canon(r[cols.index(c)]) for c in order) for r in other)
        if a == b:
            print(f"ok    {name}: {len(a)} rows {dt:.1f}s (sql {dd:.1f}s)", flush=True)
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"DIFF  {name}: spark {len(a)} sql {len(b)} {dt:.1f}s\n   cols {order}\n   spark-only {list(sa - sb)[:3]}\n   sql-only {list(sb - sa)[:3]}  n={len(sa-sb)},{len(sb-sa)}", flush=True)
    print("bad:", bad)


main()
