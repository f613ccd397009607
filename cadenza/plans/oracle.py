"""Side-by-side check of a registered query against its DuckDB oracle.

Row multisets are compared after sorting columns by name and rounding
floats to 6 decimals (the same normalisation the driver applies).
"""
from __future__ import annotations

import math
import time

import duckdb

from cadenza.sources.tables import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def con_for(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, q):
    t0 = time.time()
    df = q.fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    plan = df._jdf.queryExecution().executedPlan().toString()
    unsafe = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if k in plan]
    if not q.sql:
        return dict(name=q.name, ok=None, rows=len(srows), spark_s=round(t1 - t0, 2), unsafe=unsafe)
    rel = con.execute(q.sql)
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    res = dict(name=q.name, rows=len(srows), oracle_rows=len(orows), spark_s=round(t1 - t0, 2), unsafe=unsafe)
    if sorted(scols) != sorted(ocols):
        res.update(ok=False, why=f"cols {sorted(scols)} vs {sorted(ocols)}")
        return res
    a, b = _rows(scols, srows), _rows(ocols, orows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res.update(ok=False, why=f"values differ, e.g. {diff}")
        return res
    res.update(ok=True)
    return res
