"""Compare query results with the SQL: `python -m checks.compare [sf_dir] [query ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.registry import queries


def _plain(value):
    if value is None or value is pd.NA or value != value:
        return "NULL"
    return value.item() if hasattr(value, "item") else value


def _normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.reindex(columns=sorted(frame.columns)).astype(object).map(_plain)
    return frame.sort_values(list(frame.columns), key=lambda c: c.map(repr)).reset_index(drop=True)


def difference(result: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """None if both hold the same rows, else what differs first."""
    if sorted(result.columns) != sorted(expected.columns):
        return f"columns {sorted(set(result.columns) ^ set(expected.columns))}"
    if len(result) != len(expected):
        return f"rows {len(result)} != {len(expected)}"
    left, right = _normal(result), _normal(expected)
    for name in left.columns:
        for row, (a, b) in enumerate(zip(left[name], right[name], strict=True)):
            if a != b or isinstance(a, bool) != isinstance(b, bool):
                return f"{name}[{row}]: {a!r} != {b!r}"
    return None


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sql = oracle_sql()
    failed = 0
    for name in names:
        started = time.time()
        try:
            result = queries()[name](spark, sf_dir).toPandas()
            seconds = time.time() - started
            if name not in sql:
                verdict = f"rows only ({len(result)})"
            else:
                expected = connect(sf_dir).sql(sql[name]).df()
                found = difference(result, expected)
                verdict = f"ok ({len(result)})" if found is None else f"DIFFERS {found}"
        except Exception as error:  # noqa: BLE001
            seconds, verdict = time.time() - started, f"ERROR {' '.join(str(error).split())[:200]}"
        failed += verdict.startswith(("DIFFERS", "ERROR"))
        print(f"{name:24s} {seconds:6.2f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
