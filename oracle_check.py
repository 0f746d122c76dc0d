"""Run registered queries next to their SQL twins and compare the results.

    python oracle_check.py [--sf /root/testdata/sf0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from assayer.session import TABLES, build_session


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [columns[i] for i in order]
    body = [tuple(plain(r[i]) for i in order) for r in rows]
    return named, sorted(body, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def compare(spark, con, sf_dir, fn, sql):
    """(verdict, seconds, rows) of one query; verdict is 'ok' or a reason."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    if sql is None:
        return "rows-only", seconds, len(got)
    cursor = con.execute(sql)
    want_cols = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    g_cols, g_rows = sorted_rows(df.columns, [tuple(r) for r in got])
    w_cols, w_rows = sorted_rows(want_cols, want)
    if g_cols != w_cols:
        return f"columns {g_cols} vs {w_cols}", seconds, len(got)
    if len(g_rows) != len(w_rows):
        return f"row count {len(g_rows)} vs {len(w_rows)}", seconds, len(got)
    bad = [(g, w) for g, w in zip(g_rows, w_rows) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}", seconds, len(got)
    wrong = [type(a).__name__ + "/" + type(b).__name__ for a, b in zip(g_rows[0], w_rows[0]) if type(a) is not type(b)] if g_rows else []
    return ("ok" if not wrong else f"types {wrong}"), seconds, len(got)


def main() -> int:
    from assayer import checks

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    queries, oracles = checks.queries(), checks.oracle_sql()
    picked = [q for q in queries if not opts.names or any(q.startswith(n) for n in opts.names)]
    spark, con = build_session(cores="8"), connect(opts.sf)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in picked:
        try:
            verdict, seconds, rows = compare(spark, con, opts.sf, queries[name], oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            verdict, seconds, rows = f"{type(exc).__name__}: {str(exc)[:600]}", 0.0, 0
        good = verdict in ("ok", "rows-only")
        failed += not good
        print(f"{'PASS' if good else 'FAIL'} {name:34s} {seconds:6.2f}s {rows:8d} {verdict}", flush=True)
    print(f"{len(picked) - failed}/{len(picked)} passed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
