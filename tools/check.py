"""Compare registered queries with their SQL on one scale: python tools/check.py SF_DIR [name-part ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from standpoint.plans import catalog  # noqa: E402
from standpoint.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if v.__class__.__name__ == "Decimal":
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    sf, parts = sys.argv[1], sys.argv[2:]
    modules = [p[1:] for p in parts if p.startswith("@")]
    parts = [p for p in parts if not p.startswith("@")]
    if modules:
        catalog.MODULES[:] = modules
    qs, sql = catalog.queries(), catalog.oracle_sql()
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, fn in qs.items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            got = [tuple(r) for r in df.collect()]
            a = rows_of(df.columns, got)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark: {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if name not in sql:
            print(f"rows {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sql[name])
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: sql: {str(e)[:1500]}", flush=True)
            continue
        b = rows_of(cols, want)
        ok = sorted(cols) == sorted(df.columns) and a == b
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(got)} / {len(want)} rows {t1 - t0:.1f}s sql {time.time() - t1:.1f}s",
              flush=True)
        if not ok:
            bad += 1
            print("   columns", sorted(df.columns), sorted(cols))
            print("   spark only", list((a - b).items())[:3])
            print("   sql only  ", list((b - a).items())[:3], flush=True)
    print("bad:", bad)
    spark.stop()


main()
