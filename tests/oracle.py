"""Compares registered queries with their SQL: ``python -m tests.oracle [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from gleanery.plans.catalog import all_queries
from gleanery.session import build_session
from gleanery.sources.tables import TABLES

LOCAL = {
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value: object) -> tuple:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("0",)
    return (type(value).__name__, repr(value))


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return rows_of(df.columns, df.collect())


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return rows_of(columns, found.fetchall())


def difference(got: tuple, expected: tuple) -> str | None:
    if got[0] != expected[0]:
        return f"columns {got[0]} / {expected[0]}"
    if got[1] != expected[1]:
        extra = [r for r in got[1] if r not in set(expected[1])][:2]
        missing = [r for r in expected[1] if r not in set(got[1])][:2]
        return f"rows {len(got[1])} / {len(expected[1])}; only Spark {extra}; only SQL {missing}"
    return None


def main() -> None:
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", **LOCAL)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, query in all_queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            got = spark_rows(query(spark, folder))
            problem = difference(got, sql_rows(con, query.sql)) if query.sql else None
            count = len(got[1])
        except Exception as err:
            problem, count = f"{type(err).__name__}: {str(err)[:1500]}", -1
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={count} {time.time() - start:.1f}s", problem or "", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
