"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows.

``python -m tests.compare SF_DIR [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows(columns: list[str], data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, float]:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    ours = rows(df.columns, df.collect())
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"no oracle, {len(ours)} rows", took
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    theirs = rows(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}", took
    if ours == theirs:
        return f"ok {len(ours)} rows", took
    extra = [r for r in ours if r not in set(theirs)][:3]
    missing = [r for r in theirs if r not in set(ours)][:3]
    return f"DIFF {len(ours)} vs {len(theirs)}: {sorted(df.columns)} extra {extra} missing {missing}", took


if __name__ == "__main__":
    from tiepoints.session import local_session

    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    database = connect(folder)
    for query in sys.argv[2:] or entry.queries():
        try:
            result, seconds = compare(session, database, folder, query)
        except Exception as error:  # report and go on with the next query
            result, seconds = f"ERROR {type(error).__name__}: {str(error)[:1500]}", 0.0
        print(f"{query:26s} {seconds:6.2f}s {result}", flush=True)
