"""Run registered queries beside their SQL and compare the rows.

    python -m tests.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import signal
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value, digits: int | None = None):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.{digits}g}" if digits else repr(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, data, digits=None):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(canonical(r[k], digits) for k in order) for r in data)


def compare(spark, con, fn, sql, sf_dir):
    """(state, message) with state one of same, close, differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return "differs", f"columns {sorted(df.columns)} / {sorted(want_columns)}"
    if len(got) != len(want):
        return "differs", f"{len(got)} rows / {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(want_columns, want)
    if a == b:
        return "same", f"{len(got)} rows"
    a, b = rows_of(df.columns, got, 9), rows_of(want_columns, want, 9)
    if a == b:
        return "close", f"{len(got)} rows"
    odd = [(x, y) for x, y in zip(a, b) if x != y]
    return "differs", f"{len(odd)} of {len(got)} rows: {sorted(df.columns)} {odd[0]}"


def _too_long(*_):
    raise TimeoutError("query over its time limit")


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(ROOT))
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        k = argv.index("--sf")
        sf_dir = argv[k + 1]
        argv = argv[:k] + argv[k + 2 :]
    from gridloom.session import session

    import __spark_entry__ as entry

    spark = session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    limit = int(os.environ.get("COMPARE_LIMIT", "60"))
    signal.signal(signal.SIGALRM, _too_long)
    for name in names:
        start = time.time()
        signal.alarm(limit)
        try:
            if name in oracles:
                state, message = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                state, message = "rows", f"{len(queries[name](spark, sf_dir).collect())} rows"
        except Exception as exc:  # noqa: BLE001
            state, message = "error", f"{type(exc).__name__}: {str(exc)[:600]}"
        signal.alarm(0)
        bad += state in ("differs", "error")
        if state not in ("same",) or "0 rows" == message or argv:
            print(f"{state:8s} {name:40s} {time.time() - start:6.2f}s {message}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
