"""Run registered queries next to their SQL check and compare rows, columns and values.

Usage: python check.py [sf_dir] [part of a name, or a query module such as geometry ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v if isinstance(v, (int, bool)) else str(v)


def _rows(pdf_rows, cols, order):
    return sorted((tuple(_plain(r[i]) for i in order) for r in pdf_rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise a short description of the first difference."""
    got_cols = spark_df.columns
    got = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    g = _rows(got, got_cols, [got_cols.index(c) for c in sorted(got_cols)])
    w = _rows(want, want_cols, [want_cols.index(c) for c in sorted(want_cols)])
    if len(g) != len(w):
        return f"rows {len(g)} != {len(w)}"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return f"{len(bad)}/{len(g)} rows differ, columns {sorted(got_cols)}: spark {bad[0][0]} sql {bad[0][1]}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in spark_df.dtypes:
        if kinds.get(kind, want_types[name]) != want_types[name]:
            return f"type of {name}: {kind} != {want_types[name]}"
    return None


def main() -> int:
    from fieldlens.plans import load_all
    from fieldlens.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    registry = load_all()
    wanted = lambda n: any(a in n or registry[n].build.__module__.endswith(f".{a}_queries") for a in args)
    names = [n for n in registry if not args or wanted(n)]
    spark = local_session()
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        q = registry[name]
        try:
            df = q(spark, sf_dir)
            if q.sql is None:
                note = f"rows only ({len(df.collect())})"
            else:
                diff = compare(df, con, q.sql)
                note = "ok" if diff is None else f"DIFF {diff[:600]}"
                failed += diff is not None
        except Exception as e:  # report and go on with the other queries
            note = f"ERROR {type(e).__name__}: {str(e)[:900]}"
            failed += 1
        if note != "ok" or os.environ.get("VERBOSE"):
            print(f"{name:45s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
