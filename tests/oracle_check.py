"""Run registered queries and their SQL equivalents side by side.

    python tests/oracle_check.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, sf: str, name: str, build, sql: str | None) -> tuple[bool, str]:
    df = build(spark, sf)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return True, f"rows only: {len(got)}"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} / {sorted(columns)}"
    want = rows_of(columns, cursor.fetchall())
    if got == want:
        return True, f"equal: {len(got)} rows"
    have, wanted = set(got), set(want)
    missing = [r for r in want if r not in have][:2]
    extra = [r for r in got if r not in wanted][:2]
    return False, f"{len(got)} rows / {len(want)} wanted; {sorted(columns)}\n   only here {extra}\n   only sql  {missing}"


def main() -> int:
    import __spark_entry__ as entry
    from worklens.session import build_session, remove_run_folder

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session(
        "oracle-check", os.environ.get("MASTER", "local[8]"), **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sqls, bad = entry.queries(), entry.oracle_sql(), []
    for name, build in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            ok, note = compare(spark, con, sf, name, build, sqls.get(name))
        except Exception as failure:
            ok, note = False, f"{type(failure).__name__}: {str(failure)[:600]}"
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {note}", flush=True)
    remove_run_folder(spark)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
