"""Run registered queries beside their SQL and compare rows.

    python tests/oracle.py [folder] [name-substring ...]
"""
from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda t: [(x is None, str(type(x)), x if x is not None else 0) for x in t])


def compare(spark, con, folder, fn, sql):
    """Message on a difference, else an empty string."""
    df = fn(spark, folder)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = rows_of([c[0] for c in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} vs {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} vs {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, first {bad[:2]}"
    kinds = [(sc[i], type(x), type(y)) for i, (x, y) in enumerate(zip(sr[0], dr[0])) if type(x) is not type(y) and x is not None and y is not None] if sr else []
    return f"types {kinds}" if kinds else ""


if __name__ == "__main__":
    from screenloom.plans.catalog import ORACLES, QUERIES
    from screenloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    fails = 0
    for name, fn in QUERIES.items():
        if want and not any(w in name for w in want):
            continue
        t = time.time()
        try:
            if name in ORACLES:
                msg = compare(spark, con, folder, fn, ORACLES[name])
                n = ""
            else:
                n = f"rows-only n={fn(spark, folder).count()}"
                msg = ""
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:1200]}"
        fails += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t:.1f}s {n if not msg else msg}", flush=True)
    print("failures", fails)
