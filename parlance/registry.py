"""Queries by name, each with the SQL that checks it where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.adapters import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(tables: str = "", sql: str | None = None, name: str | None = None, ctes: str = ""):
    """Registers a function of Tables; ``sql`` is the oracle over the named adapters and ``ctes`` made from them."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_tables(tables, sql, ctes) if tables else sql
        return f

    return add
