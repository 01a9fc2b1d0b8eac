"""Compare every registered query with its SQL in DuckDB.

``python -m tests.oracle_check [sf_dir] [name ...]``
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when rows, column names and value types agree, else what differs."""
    names = sorted(df.columns)
    got = [tuple(row) for row in df.select(*names).collect()]
    expected = con.execute(sql)
    order = sorted(range(len(expected.description)), key=lambda i: expected.description[i][0])
    if names != [expected.description[i][0] for i in order]:
        return f"columns {names} / {[expected.description[i][0] for i in order]}"
    want = [tuple(row[i] for i in order) for row in expected.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)} expected"
    typed = [Counter(tuple((type(v), v) for v in row) for row in rows) for rows in (got, want)]
    if typed[0] != typed[1]:
        extra, missing = typed[0] - typed[1], typed[1] - typed[0]
        return f"{len(extra)} rows differ: {names} {next(iter(extra))} / {next(iter(missing))}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark: SparkSession = local_session()
    con = connect(sf_dir)
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.perf_counter()
        try:
            df = query(spark, sf_dir)
            sql = oracle_sql().get(name)
            verdict = compare(df, con, sql) if sql else f"{df.count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:1200]}"
        print(f"{name:26} {time.perf_counter() - start:6.2f}s  {verdict or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
