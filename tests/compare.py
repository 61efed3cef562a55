"""Spark results against DuckDB results of the same query, without regard to order."""

import glob
import math
import os

import duckdb


def views(con, d):
    for p in sorted(glob.glob(f"{d}/*.parquet")):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from read_parquet('{src}')")


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return f"{v:.9g}" if v else "0"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ").removesuffix(" 00:00:00")
    return str(v)


def rows(df_rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in df_rows)


def compare(spark, d, f, sql):
    """None if both agree, else what differs."""
    df = f(spark, d)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    views(con, d)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows(cur.fetchall(), cols)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} and {len(want)} rows; only Spark {len(a)}: {sorted(a)[:4]}; only SQL {len(b)}: {sorted(b)[:4]}"
    return None
