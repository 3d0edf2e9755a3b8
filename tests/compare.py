"""Order-insensitive comparison of a Spark result with its DuckDB check."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

from ledgerline.sources.bindings import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value: object) -> str:
    if value is None:
        return "~"
    if isinstance(value, Decimal):
        return f"{value:f}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def table_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when equal, else a short account of what differs."""
    mine = table_of(df.columns, df.collect())
    done = con.execute(sql)
    theirs = table_of([c[0] for c in done.description], done.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} / {len(theirs[1])}; e.g. {mine[1][:2]} / {theirs[1][:2]}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"{mine[0]}\n{a}\n{b}"
    return "" if mine[1] else "both empty"
