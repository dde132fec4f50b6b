"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results.

Usage: python tests/compare.py FOLDER [QUERY ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        return value.date()
    return value


def as_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5)
    return type(a) is type(b) and a == b


def differences(spark_df, cursor, strict: bool = False) -> str | None:
    """None when both results agree in names, types of values, and rows."""
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    left = as_rows(spark_df.columns, spark_df.collect())
    right = as_rows(names, cursor.fetchall())
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}; {left[:2]} vs {right[:2]}"
    if left == right:
        return None
    # Rounding may differ in the last digit, which can also reorder rows.
    for a, b in zip(left, right):
        if not all(close(x, y) for x, y in zip(a, b)):
            return f"first difference {a} vs {b}"
    if strict:
        unequal = [(a, b) for a, b in zip(left, right) if a != b]
        return f"last digit differs in {len(unequal)} of {len(left)} rows, such as {unequal[0]}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from shelfcast.session import build_session, scratch

    spark = build_session(
        "compare", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.checkpoint.dir": "/tmp/shelfcast-compare", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, statements, failed = connect(folder), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            with scratch(spark):
                started = time.time()
                df = build(spark, folder)
                if name in statements:
                    n, problem = "", None
                    rows = df.persist()
                    rows.count()
                    spark_seconds = time.time() - started
                    started = time.time()
                    cursor = connection.execute(statements[name])
                    problem = differences(rows, cursor, strict=True)
                    print(f"{name:32s} {'ok' if problem is None else 'DIFF ' + problem[:600]}  {spark_seconds:.1f}s / {time.time() - started:.1f}s", flush=True)
                    rows.unpersist()
                    failed += problem is not None
                else:
                    print(f"{name:32s} {df.count()} rows, no SQL  {time.time() - started:.1f}s", flush=True)
        except Exception as error:
            failed += 1
            print(f"{name:32s} FAIL {str(error)[:700]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
