"""Run a query and its SQL on the same tables and compare columns, types and rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(tables: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


FAMILIES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def differences(df, sql: str, con) -> list[str]:
    """What differs between a frame and the SQL result; empty when they agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = dict(zip(names, [str(d[1]) for d in cursor.description]))
    expected = cursor.fetchall()
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    for name, kind in df.dtypes:
        if FAMILIES.get(kind, kind) != types[name]:
            found.append(f"type of {name}: {kind} and {types[name]}")
    order = [names.index(c) for c in df.columns]
    left = Counter(tuple(_cell(v) for v in row) for row in df.collect())
    right = Counter(tuple(_cell(row[i]) for i in order) for row in expected)
    if left != right:
        found.append(f"rows: {sum(left.values())} and {sum(right.values())}")
        found += [f"  only Spark: {r!r}"[:400] for r in list((left - right))[:2]]
        found += [f"  only SQL:   {r!r}"[:400] for r in list((right - left))[:2]]
    return found
