"""Spark-vs-DuckDB comparison used by the tests and runnable as a script.

    python tests/oracle_compare.py [sf_dir] [name ...]

Rows are compared order-insensitively after normalising values: doubles are
rounded (6 places), dates become ISO strings, NaN and NULL both become None.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

VIEWS = ("region nation customer supplier part orders lineitem events documents "
         "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in VIEWS:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v, places=6):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        r = round(v, places)
        return 0.0 if r == 0 else r
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):          # numpy scalar
        return _norm(v.item(), places)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, places) for x in v)
    return v


def normalise(columns, rows, places=6):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i], places) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir, places=6):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    sc, sr = normalise(s_cols, s_rows, places)
    dc, dr = normalise(d_cols, d_rows, places)
    problems = []
    if sc != dc:
        problems.append(f"columns spark={sc} duckdb={dc}")
    if len(sr) != len(dr):
        problems.append(f"rows spark={len(sr)} duckdb={len(dr)}")
    elif sr != dr:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b]
        problems.append(f"{len(bad)} differing rows, first: spark={bad[0][0]} duckdb={bad[0][1]}")
    return {"name": name, "ok": not problems, "rows": len(s_rows), "problems": problems,
            "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}


def main(argv):
    from coverlake.session import get_spark
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = get_spark("oracle-compare")
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(qs):
        if name not in sqls:
            print(f"{name:38s} (no oracle)")
            continue
        try:
            r = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as exc:  # report and go on
            r = {"name": name, "ok": False, "problems": [f"{type(exc).__name__}: {str(exc)[:400]}"],
                 "rows": -1, "spark_s": 0, "duck_s": 0}
        failed += not r["ok"]
        print(f"{name:38s} {'OK ' if r['ok'] else 'BAD'} rows={r['rows']:>7} "
              f"spark={r['spark_s']}s duck={r['duck_s']}s {' | '.join(r['problems'])}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
