"""Compare a registered Spark query with its DuckDB oracle (driver-style)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "\x00NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records), [cols[i] for i in order]


def compare(spark, name: str, sf_dir: str, verbose: bool = True) -> bool:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    t = time.time()
    sdf = E.queries()[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t
    sql = E.oracle_sql().get(name)
    if sql is None:
        print(f"{name}: no oracle; spark rows={len(s_rows)}")
        return True
    con = duck(sf_dir)
    t = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    td = time.time() - t
    a, ac = rows_of(s_cols, s_rows)
    b, bc = rows_of(d_cols, d_rows)
    ok = ac == bc and a == b
    if verbose:
        print(f"{name}: spark {len(a)} rows {ts:.1f}s, duck {len(b)} rows {td:.1f}s -> "
              f"{'OK' if ok else 'MISMATCH'}")
        if ac != bc:
            print("  columns", ac, bc)
        elif not ok:
            sa, sb = set(a), set(b)
            for r in sorted(sa - sb)[:5]:
                print("  spark only", r)
            for r in sorted(sb - sa)[:5]:
                print("  duck  only", r)
    return ok


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from qsieve.session import local_session
    sf = "/root/testdata/sf0.01"
    names = sys.argv[1:]
    spark = local_session(8)
    import __spark_entry__ as E
    bad = [n for n in (names or list(E.queries())) if not compare(spark, n, sf)]
    print("FAILED:", bad if bad else "none")
