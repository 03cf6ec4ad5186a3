"""Compare registered queries with their oracle SQL in DuckDB.

``python tests/compare.py [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"{value:.9g}"
    if value is None:
        return "~"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows), sorted(columns)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def differences(spark, sf_dir: str, name: str, fn, sql: str | None) -> tuple[int, list[str]]:
    got, got_columns = spark_rows(fn(spark, sf_dir))
    if sql is None:
        return len(got), []
    want, want_columns = oracle_rows(sf_dir, sql)
    problems = []
    if got_columns != want_columns:
        problems.append(f"columns {got_columns} != {want_columns}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
        problems.append(f"values differ: {bad}"[:1500])
    return len(got), problems


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = make_session()
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            n, problems = differences(spark, sf_dir, name, fn, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            n, problems = -1, [f"{type(error).__name__}: {str(error)[:1200]}"]
        kind = "oracle" if name in oracles else "rows"
        state = "ok " if not problems else "BAD"
        print(f"{state} {name:28s} {kind:6s} {n:7d} rows {time.time() - start:6.2f}s", flush=True)
        for problem in problems:
            print("    ", problem, flush=True)


if __name__ == "__main__":
    main()
