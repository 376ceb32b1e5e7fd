"""Queries by name, each with its SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple], names: str) -> str:
    """The same literal rows for SQL: a sub-select."""

    def shown(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") AS v({names}))"


def picked(spark: SparkSession, sf_dir: str, name: str, key: str, rows: list[tuple], schema: str) -> DataFrame:
    """The rows of a table, each with the one of some fixed rows that key, a whole number, falls on."""
    fixed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pick int, {schema}")
    return table(spark, sf_dir, name).withColumn("pick", F.expr(f"cast(pmod({key}, {len(rows)}) AS int)")).join(F.broadcast(fixed), "pick").drop("pick")


def picked_sql(name: str, key: str, rows: list[tuple], names: str) -> str:
    """The same for SQL, as a sub-select."""
    return f"(SELECT t.*, v.* EXCLUDE (pick) FROM {name} t JOIN {values([(i, *r) for i, r in enumerate(rows)], f'pick, {names}')} v ON v.pick = ({key}) % {len(rows)})"
