"""Spark-vs-DuckDB comparison of registered queries (mirrors the driver's gate).

    python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime,)):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bytes):
        return v.hex()
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    msg = []
    if sorted(scols) != sorted(dcols):
        msg.append(f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}")
        return False, "; ".join(msg), t1 - t0, t2 - t1
    if len(srows) != len(drows):
        msg.append(f"row count spark={len(srows)} duck={len(drows)}")
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a != b:
        cols = sorted(scols)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        for x, y in diff:
            d = {cols[i]: (x[i], y[i]) for i in range(len(cols)) if x[i] != y[i]}
            msg.append(f"first diff: {d}")
        if not diff:
            msg.append("value multiset differs")
    msg_rows = f"rows={len(srows)}"
    return not msg, msg_rows + " " + "; ".join(msg), t1 - t0, t2 - t1


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from revlens.session import get_spark

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            print(f"ROWS-ONLY {name}: {df.count()} rows")
            continue
        try:
            ok, msg, ts, td = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg, ts, td = False, f"ERROR {type(e).__name__}: {str(e)[:600]}", 0, 0
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name} spark={ts:.1f}s duck={td:.1f}s {msg[:1500]}")
    print(f"{len(names or qs) - bad} ok, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
