"""Spark-vs-DuckDB comparison in the driver's manner: columns sorted by
name, row count, and an order-insensitive multiset of rounded rows."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# HARNESS_EXACT=1 compares doubles bit for bit (both sides already round to 6 places).
EXACT = os.environ.get("HARNESS_EXACT") == "1"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 5)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):  # Decimal
        return round(float(v), 5)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm_value(r[i]) for i in order) for r in rows], sorted(cols)


def compare(spark, name: str, sf_dir: str, con=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries

    con = con or duck(sf_dir)
    sdf = queries()[name](spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_vals, s_cols = rows_of(sdf.columns, s_rows)
    sql = oracle_sql().get(name)
    if sql is None:
        return {"name": name, "rows": len(s_rows), "sql": False}
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_vals, d_cols = rows_of(d_cols, res.fetchall())
    out = {"name": name, "rows": len(s_rows), "duck_rows": len(d_vals), "cols_ok": s_cols == d_cols}
    cs, cd = Counter(s_vals), Counter(d_vals)
    out["values_ok"] = cs == cd
    if verbose and not (out["values_ok"] and out["cols_ok"]):
        out["spark_cols"], out["duck_cols"] = s_cols, d_cols
        out["only_spark"] = list((cs - cd).elements())[:3]
        out["only_duck"] = list((cd - cs).elements())[:3]
    return out


if __name__ == "__main__":
    import json
    import time

    from sparkvox.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    from __spark_entry__ import queries

    names = sys.argv[1:] or list(queries())
    con = duck(sf)
    for n in names:
        t = time.time()
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # report and go on
            r = {"name": n, "error": repr(e)[:800]}
        r["sec"] = round(time.time() - t, 2)
        print(json.dumps(r, ensure_ascii=False, default=str), flush=True)
