"""Compare a Spark result with DuckDB's, as multisets of typed rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, connection, sql) -> str | None:
    """None if equal, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    known = {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "INTEGER": "int"}
    for name, kind in df.dtypes:
        if known.get(kinds[name]) != kind:
            return f"type of {name}: {kind} != {kinds[name]}"
    actual = _rows(df.columns, [tuple(row) for row in df.collect()])
    if actual != expected:
        missing, extra = expected - actual, actual - expected
        return (
            f"{sum(actual.values())} rows != {sum(expected.values())}; missing {sum(missing.values())} "
            f"{list(missing)[:2]}; extra {sum(extra.values())} {list(extra)[:2]}"
        )
    return None
