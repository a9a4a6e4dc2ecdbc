"""Side-by-side run of the registered queries and their SQL. ``python -m tests.oracle [prefix…]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _kind(series: pd.Series) -> str:
    d = series.dtype
    if isinstance(d, pd.api.extensions.ExtensionDtype):
        d = getattr(d, "numpy_dtype", d)
    if d == object:
        first = next((v for v in series if v is not None and not (isinstance(v, float) and math.isnan(v))), None)
        return "null" if first is None else type(first).__name__
    return d.kind + (str(d.itemsize) if d.kind in "if" else "")


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return f"b{bool(v)}"
    if isinstance(v, (int, np.integer)):
        return f"n{float(v)!r}"
    if isinstance(v, (float, np.floating)):
        return f"n{float(v) + 0.0!r}"
    if isinstance(v, (pd.Timestamp, np.datetime64)):
        return str(pd.Timestamp(v).tz_localize(None))
    return str(v)


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when equal (order of rows aside), else what differs."""
    a, b = sorted(left.columns), sorted(right.columns)
    if a != b:
        return f"columns {a} != {b}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    kinds = [(c, _kind(left[c]), _kind(right[c])) for c in a]
    loose = [k for k in kinds if k[1] != k[2] and "null" not in k[1:]]
    rows_l = sorted(zip(*[[_cell(v) for v in left[c]] for c in a]))
    rows_r = sorted(zip(*[[_cell(v) for v in right[c]] for c in a]))
    for x, y in zip(rows_l, rows_r):
        if x != y:
            bad = [(c, p, q) for c, p, q in zip(a, x, y) if p != q]
            return f"values {bad[:3]}"
    hard = [k for k in loose if (k[1][0], k[2][0]) not in {("i", "f"), ("f", "i")} or len(left)]
    return f"types {hard}" if hard else None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from mailwatch.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "oracle", f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            got = run(spark, sf).toPandas()
            took = time.time() - start
            if name in sql:
                want = con.execute(sql[name]).fetchdf()
                problem = compare(got, want)
                status = "ok" if problem is None else f"MISMATCH {problem}"
            else:
                status = f"rows {len(got)}"
        except Exception as e:
            took, status = time.time() - start, f"ERROR {str(e)[:1500]}"
        failed += status.startswith(("MISMATCH", "ERROR"))
        print(f"{name:40s} {took:6.2f}s {status}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
