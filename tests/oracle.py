"""Compare a registered query with its DuckDB counterpart."""

from __future__ import annotations

import math

import duckdb

from redactlake.plans.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str, show: int = 3) -> str:
    want = con.execute(sql)
    cols = [d[0] for d in want.description]
    expected = rows_of(cols, want.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(cols) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} vs {sorted(cols)}"
    if actual == expected:
        return ""
    missing = [r for r in expected if r not in set(actual)][:show]
    extra = [r for r in actual if r not in set(expected)][:show]
    return f"{len(actual)} vs {len(expected)} rows\n spark only: {extra}\n duckdb only: {missing}"
