"""Compare named queries with their DuckDB statements.

usage: python tests/check.py [sf] [name-or-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def norm(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == int(v) else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "\0" if v is None else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, name, fn, sql, sf):
    """(message, seconds); the message is empty when both sides agree."""
    t = time.time()
    df = fn(spark, sf)
    got = rows(df.columns, df.collect())
    secs = time.time() - t
    if sql is None:
        return f"", len(got[1]), secs
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1]), secs
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return (
            f"rows {len(got[1])} != {len(want[1])}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}",
            len(got[1]), secs,
        )
    return "", len(got[1]), secs


if __name__ == "__main__":
    import __spark_entry__ as E
    from variscope.session import session

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    wanted = sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    sqls = E.oracle_sql()
    bad = 0
    for name, fn in E.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            msg, n, secs = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:  # noqa: BLE001
            msg, n, secs = f"{type(e).__name__}: {str(e)[:600]}", -1, 0
        bad += bool(msg)
        print(f"{'BAD ' if msg else 'ok  '} {name} rows={n} {secs:.1f}s {'' if name in sqls else '(rows only)'} {msg}", flush=True)
    print("bad:", bad)
