"""Run a query's SQL counterpart in DuckDB and compare it with a Spark result."""

import math
from collections import Counter
from pathlib import Path

import duckdb

SPARK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "date": "DATE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _key(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def compare(df, connection, sql):
    """Returns a list of differences; empty when names, types and rows agree."""
    result = connection.execute(sql)
    expected_types = {d[0]: str(d[1]) for d in result.description}
    names = sorted(expected_types)
    actual_types = {name: SPARK_TYPES.get(kind, kind) for name, kind in df.dtypes}
    if actual_types != expected_types:
        wrong = {n: (actual_types.get(n), expected_types.get(n)) for n in actual_types.keys() | expected_types.keys()}
        return [f"types {n}: spark {a}, sql {b}" for n, (a, b) in wrong.items() if a != b]
    order = [d[0] for d in result.description]
    expected = Counter(tuple(_key(row[order.index(n)]) for n in names) for row in result.fetchall())
    actual = Counter(tuple(_key(row[n]) for n in names) for row in df.collect())
    problems = []
    for row, count in list((actual - expected).items())[:5]:
        problems.append(f"only in spark x{count}: {row}")
    for row, count in list((expected - actual).items())[:5]:
        problems.append(f"only in sql x{count}: {row}")
    return problems
