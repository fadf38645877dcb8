"""Runs catalogue queries against their SQL: ``python tests/check.py [sf folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def canonical(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, query, folder: str, df=None) -> tuple[bool, str]:
    df = query(spark, folder) if df is None else df
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return len(got[1]) > 0, f"{len(got[1])} rows, no SQL"
    result = con.execute(query.sql)
    want = canonical([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} against {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, f"{len(got[1])} against {len(want[1])} rows\n   only spark {sorted(a - b)[:3]}\n   only sql   {sorted(b - a)[:3]}"
    return len(got[1]) > 0, f"{len(got[1])} rows"


def main() -> int:
    from fleetscope.plans.catalog import CATALOGUE
    from fleetscope.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), []
    for name in args or CATALOGUE:
        start = time.time()
        try:
            ok, note = compare(spark, con, CATALOGUE[name], folder)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:24} {time.time() - start:6.2f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failures {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
