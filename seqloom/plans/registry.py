"""Where queries and their SQL counterparts are collected, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(ids: Column | str) -> Column:
    """An id array as one string, so that results compare by value in any engine."""
    col = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(col.cast("array<string>"), " ")


def r6(value: Column) -> Column:
    """Six decimals; adding zero turns a negative zero into zero."""
    return F.round(value, 6) + F.lit(0.0)


def sql_r6(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0)"


def weight_grid(rows: int, cols: int, salt: int = 0) -> list[list[float]]:
    """Fixed small weights: the library takes weights as inputs and learns none."""
    return [[((i * 7 + j * 3 + salt * 5) % 11 - 5) / 10 for j in range(cols)] for i in range(rows)]


def sql_list(values) -> str:
    """Nested lists of numbers as a SQL list literal."""
    if isinstance(values, (list, tuple)):
        return "[" + ", ".join(sql_list(v) for v in values) + "]"
    return f"{float(values)!r}::DOUBLE"
