"""Runs the registered queries and their SQL on the same tables and compares the results.

usage: python tests/oracle_check.py [folder] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from laborlens.plans.views import BASE_TABLES  # noqa: E402
from laborlens.session import local_session  # noqa: E402


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, int)) or type(v).__name__ == "Decimal":
        v = float(v)
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), None, ""
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    if sorted(cols) != sorted(df.columns):
        return len(got), False, f"columns {sorted(df.columns)} / {sorted(cols)}"
    want = rows_of(cols, res.fetchall())
    if got == want:
        return len(got), True, ""
    a, b = set(got), set(want)
    only = sorted(a - b)[:2], sorted(b - a)[:2]
    return len(got), False, f"{sorted(cols)}\n   rows {len(got)} / {len(want)} differ {len(a - b)}\n   spark {only[0]}\n   sql   {only[1]}"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in entry.queries():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        t = time.time()
        try:
            n, ok, why = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            n, ok, why = -1, False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += ok is False
        mark = {True: "ok", False: "FAIL", None: "rows"}[ok]
        print(f"{mark:5}{name:28}{n:8} rows {time.time() - t:6.1f}s {why[:1800]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
