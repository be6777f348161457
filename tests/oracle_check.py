"""Run registered queries in Spark and their oracle SQL in DuckDB and compare
row count, column names and an order-insensitive value hash (as the driver
does).  Usage: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    normed = sorted((repr(tuple(_norm(r[i]) for i in order)) for r in rows))
    h = hashlib.sha256("\n".join(normed).encode()).hexdigest()[:16]
    return [cols[i] for i in order], len(rows), h, normed


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    con.execute("SET TimeZone='UTC'")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    from tablewright.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            s_cols, s_n, s_h, s_rows = digest(df.columns, rows)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows-only {name}: {s_n} rows ({ts:.1f}s)")
            continue
        try:
            res = con.execute(sqls[name])
            d_cols = [d[0] for d in res.description]
            d_rows = res.fetchall()
            o_cols, o_n, o_h, o_rows = digest(d_cols, d_rows)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok = (s_cols == o_cols) and s_n == o_n and s_h == o_h
        if ok:
            print(f"ok   {name}: {s_n} rows ({ts:.1f}s)")
        else:
            bad += 1
            print(f"FAIL {name}: cols {s_cols == o_cols} {s_cols} vs {o_cols}; rows {s_n} vs {o_n}")
            sd = set(s_rows) - set(o_rows)
            od = set(o_rows) - set(s_rows)
            print("   spark-only:", sorted(sd)[:3])
            print("   duck-only: ", sorted(od)[:3])
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
