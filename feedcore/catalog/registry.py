"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if there is one."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def any_of(column: str, words) -> str:
    """SQL for "contains one of the words"."""
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def case(whens: list[tuple[str, str]], otherwise: str) -> str:
    body = " ".join(f"WHEN {test} THEN {value}" for test, value in whens)
    return f"(CASE {body} ELSE {otherwise} END)"
