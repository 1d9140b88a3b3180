"""Named queries and, where plain SQL can state them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.plans.frames import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def columns_of(prefix: str, columns: dict[str, str], fn, sql_for: Callable[[str], str]) -> None:
    """Register one query per column of a wider result; Catalyst prunes the rest."""
    for name, column in columns.items():
        query(f"{prefix}{name}", sql_for(column))(lambda t, c=column: fn(t, c))
