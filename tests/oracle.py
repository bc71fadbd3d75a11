"""Compare a Spark result with DuckDB on the same Parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql) -> str | None:
    """None when equal, otherwise what differs."""
    result = con.execute(sql)
    wanted_columns = [d[0] for d in result.description]
    wanted = result.fetchall()
    if sorted(df.columns) != sorted(wanted_columns):
        return f"columns {sorted(df.columns)} != {sorted(wanted_columns)}"
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(wanted_columns, wanted)
    if len(have) != len(want):
        return f"rows {len(have)} != {len(want)}"
    for a, b in zip(have, want):
        if a != b:
            return f"first difference {a} != {b}"
    return None
