"""Compare registered Spark queries with their DuckDB oracle (as the driver does).

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from churnscope.session import get_spark  # noqa: E402
from sql_oracle import TABLE_NAMES  # noqa: E402


SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                   "boolean": "BOOLEAN"}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if len(v.isoformat()) >= 10 else v.isoformat()
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, keys=None):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    results = {}
    for k in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[k] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            continue
        t1 = time.time()
        if k not in sqls:
            results[k] = f"rows-only {len(srows)} ({t1 - t0:.1f}s)"
            continue
        try:
            cur = con.execute(sqls[k])
            drows = cur.fetchall()
            dcols = [d[0] for d in cur.description]
        except Exception as e:  # noqa: BLE001
            results[k] = f"SQL ERROR {type(e).__name__}: {str(e)[:300]}"
            continue
        if sorted(scols) != sorted(dcols):
            results[k] = f"COLUMNS differ: spark-only {set(scols) - set(dcols)} sql-only {set(dcols) - set(scols)}"
            continue
        stypes = {c: SPARK_TO_DUCKDB.get(t, t) for c, t in df.dtypes}
        dtypes = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sqls[k]}").fetchall()}
        if stypes != dtypes:
            results[k] = f"TYPES differ: {[(c, stypes[c], dtypes.get(c)) for c in stypes if stypes[c] != dtypes.get(c)]}"
            continue
        a, b = canon(srows, scols), canon(drows, dcols)
        if len(a) != len(b):
            results[k] = f"ROWCOUNT spark {len(a)} sql {len(b)}"
        elif a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            results[k] = f"VALUES differ ({len(a)} rows): {diff}"
        else:
            results[k] = f"OK {len(a)} rows ({t1 - t0:.1f}s)"
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = get_spark()
    for k, v in compare(spark, sf, keys).items():
        print(f"{k:32s} {v}")
