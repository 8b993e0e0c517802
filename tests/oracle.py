"""Compare registered queries with their SQL in DuckDB: ``python -m tests.oracle [sf_dir] [query ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    if isinstance(value, (list, tuple)):
        return tuple(_normal(v) for v in value)
    return value


def rows_by_name(columns, rows):
    """Sorted column names, and the rows with their cells in that order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_normal(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(df):
    return rows_by_name(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(connection, sql):
    cursor = connection.execute(sql)
    return rows_by_name([d[0] for d in cursor.description], cursor.fetchall())


def main():
    from tableprobe.plans.catalog import ORACLES, QUERIES
    from tests.session import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = make_session()
    connection = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        columns, rows = spark_rows(df)
        took = f"{time.perf_counter() - start:6.2f}s"
        if name not in ORACLES:
            print(f"rows  {name:26} {len(rows):7} rows {took}", flush=True)
            continue
        expected_columns, expected = sql_rows(connection, ORACLES[name])
        same = columns == expected_columns and rows == expected
        bad += not same
        print(f"{'ok   ' if same else 'DIFF '} {name:26} {len(rows):7} rows {took}", flush=True)
        if not same:
            print("  columns", columns, expected_columns)
            print("  rows", len(rows), len(expected))
            wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
            for a, b in wrong[:3]:
                print("   ", a, "\n   ", b)
    sys.stdout.flush()
    os._exit(1 if bad else 0)


if __name__ == "__main__":
    main()
