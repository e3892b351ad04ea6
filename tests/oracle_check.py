"""Compare named queries with their SQL in DuckDB: names, kinds of types, and every value.

Run as a script: ``python tests/oracle_check.py sf0.01 [query …]``.
"""

from __future__ import annotations

import datetime
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lendscope.catalog import QUERIES  # noqa: E402
from lendscope.oracle import ORACLE  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _kind(dtype: str) -> str:
    dtype = str(dtype).lower()
    for kind in ("timestamp", "date", "double", "string", "bool", "int32", "int64"):
        if dtype.startswith(kind):
            return kind
    return dtype


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(table) -> list[tuple]:
    columns = sorted(table.column_names)
    data = [[_plain(x) for x in table.column(c).to_pylist()] for c in columns]
    return sorted(zip(*data, strict=True), key=repr)


def difference(spark_table, duck_table) -> str:
    """Empty when equal, else a short account of the first difference."""
    left = {n: _kind(t) for n, t in zip(spark_table.column_names, spark_table.schema.types, strict=True)}
    right = {n: _kind(t) for n, t in zip(duck_table.column_names, duck_table.schema.types, strict=True)}
    if left != right:
        return f"schema: {set(left.items()) ^ set(right.items())}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows: {spark_table.num_rows} and {duck_table.num_rows}"
    pairs = [(a, b) for a, b in zip(_rows(spark_table), _rows(duck_table), strict=True) if a != b]
    if not pairs:
        return ""
    names = sorted(left)
    cells = [(n, x, y) for n, x, y in zip(names, *pairs[0], strict=True) if x != y]
    return f"{len(pairs)} rows differ, first: {cells[:5]} in {pairs[0][:6]}"


def check(spark, con, name: str, folder: str) -> str:
    spark_table = QUERIES[name](spark, folder).toArrow()
    return difference(spark_table, con.sql(ORACLE[name]).to_arrow_table())


if __name__ == "__main__":
    from lendscope.session import build_session

    folder = f"/root/testdata/{sys.argv[1]}"
    session = build_session("oracle-check", "local[8]", spark__sql__shuffle__partitions="8")
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for query_name in sys.argv[2:] or list(ORACLE):
        started = time.time()
        try:
            found = check(session, connection, query_name, folder)
        except Exception as error:  # report and go on to the next query
            found = f"{type(error).__name__}: {str(error)[:500]}"
        bad += bool(found)
        print(f"{query_name:32s} {time.time() - started:6.2f}s {found or 'equal'}", flush=True)
    print("different:", bad, "without SQL:", sorted(QUERIES.keys() - ORACLE.keys()))
