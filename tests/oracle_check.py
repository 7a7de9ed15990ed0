"""Compare registered queries with their SQL counterparts in DuckDB.

Usage: python -m tests.oracle_check [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _text(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, pd.Timestamp):
        return value.date().isoformat()
    return str(value)


def normal_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


KINDS = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "int": "INTEGER",
}


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when rows, column names and types agree, else what differs."""
    rel = con.sql(sql)
    types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    ours = {n: KINDS.get(t, t) for n, t in df.dtypes}
    if ours != types:
        return f"schema: {ours} against {types}"
    got = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    want = normal_rows(rel.columns, rel.fetchall())
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"rows: {len(got)} against {len(want)}; {odd}"
    return None


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    failed = []
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            verdict = difference(df, con, sqls[name]) if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as exc:  # report and go on with the next query
            verdict = f"{type(exc).__name__}: {str(exc)[:600]}"
        if verdict and not verdict.startswith("no SQL"):
            failed.append(name)
        print(f"{name:45s} {time.time() - start:6.2f}s {verdict or 'ok'}", flush=True)
    missing = set(sqls) - set(entry.queries())
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}; SQL without query: {sorted(missing)}")


if __name__ == "__main__":
    main()
