"""Run queries beside their SQL on the same parquet tables and compare whole results.

Usage: python tests/oracle_check.py [sf_dir] [key-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v, digits):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("f", f"{v:.{digits}g}" if digits else repr(v))
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return ("t", str(v))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(canon(x, digits) for x in v))
    if v is None:
        return ("n", "")
    return ("s", str(v))


def compare(spark_cols, spark_rows, duck_cols, duck_rows, digits=0):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} vs {sorted(duck_cols)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}"
    order = sorted(spark_cols)
    si, di = [spark_cols.index(c) for c in order], [duck_cols.index(c) for c in order]
    a = sorted((tuple(canon(r[i], digits) for i in si) for r in spark_rows), key=repr)
    b = sorted((tuple(canon(r[i], digits) for i in di) for r in duck_rows), key=repr)
    for x, y in zip(a, b):
        if x != y:
            return f"value\n     {order}\n     spark {x}\n     duck  {y}"
    return ""


def check(spark, con, sf, key, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return ("rows-only", len(rows), t1 - t0, 0.0, "")
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    t2 = time.time()
    why = compare(df.columns, rows, dcols, drows)
    status = "ok"
    if why:
        soft = compare(df.columns, rows, dcols, drows, 9)
        status = "FLOAT" if not soft else "FAIL"
    return (status, len(rows), t1 - t0, t2 - t1, why)


def main(argv):
    from groundtally.session import build_session

    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:]
    spark = build_session("check", f"local[{os.environ.get('CHECK_CPUS', '8')}]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    oracle = entry.oracle_sql()
    bad = 0
    for key, fn in entry.queries().items():
        if keys and not any(key == k or key.startswith(k + "_") or (k.endswith("*") and key.startswith(k[:-1]))
                            for k in keys):
            continue
        try:
            status, n, ts, td, why = check(spark, con, sf, key, fn, oracle.get(key))
        except Exception as exc:  # report and go on
            status, n, ts, td, why = "ERROR", -1, 0, 0, str(exc)[:1500]
        bad += status not in ("ok", "rows-only")
        print(f"{status:9s} {key:34s} rows={n:<7d} spark={ts:6.2f}s duck={td:6.2f}s {why}", flush=True)
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
