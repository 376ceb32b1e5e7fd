"""Runs a query and its SQL and compares rows regardless of order."""

from __future__ import annotations

import os

import duckdb


def rows_of(rows: list[tuple]) -> list[tuple]:
    rounded = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]
    return sorted(rounded, key=lambda r: tuple((x is None, str(x)) for x in r))


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return con


def both(df, con, sql: str) -> tuple[list, list]:
    columns = sorted(df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return rows_of([tuple(r[c] for c in columns) for r in df.collect()]), rows_of([tuple(r[i] for i in at) for r in result.fetchall()])
