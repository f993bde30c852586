"""Compares every query with its SQL twin: columns by name, rows as a bag.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return int(f) if f.is_integer() and not math.isinf(f) else f
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def mismatch(df, con, sql):
    """None if equal, else a short description."""
    got, got_cols = bag(df.columns, df.collect())
    res = con.execute(sql)
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in res.description}
    want, want_cols = bag([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if types != dict(df.dtypes):
        return f"types {sorted(set(dict(df.dtypes).items()) ^ set(types.items()))}"
    if got != want:
        return (f"{sum(got.values())} rows vs {sum(want.values())}; "
                f"only ours {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}")
    return None


if __name__ == "__main__":
    import __spark_entry__ as e
    from flowkeel.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(e.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    for name in names:
        t0 = time.time()
        try:
            sql = e.oracle_sql().get(name)
            df = e.queries()[name](spark, sf)
            if sql is None:
                print(f"{name}: rows only, {df.count()} rows", f"{time.time() - t0:.2f}s", flush=True)
                continue
            bad = mismatch(df, con, sql)
            print(f"{name}: {'OK' if bad is None else 'MISMATCH ' + bad}", f"{time.time() - t0:.2f}s", flush=True)
        except Exception as ex:  # noqa: BLE001
            print(f"{name}: ERROR {type(ex).__name__} {str(ex)[:700]}", flush=True)
