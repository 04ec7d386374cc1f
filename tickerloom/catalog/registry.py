"""Query registration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Registers a builder with the SQL that gives the same rows; doubles are compared at six decimals."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = Query(lambda spark, folder: six_decimals(build(spark, folder)), sql)
        return build

    return register


def six_decimals(df: DataFrame) -> DataFrame:
    """Rounds doubles and turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(F.col(f.name), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


def r(*names: str) -> str:
    """The same rounding as SQL select items; an item is a column, or 'expression AS name'."""
    items = []
    for n in names:
        expression, _, alias = n.rpartition(" AS ")
        items.append(f"round(CAST({expression or n} AS DOUBLE), 6) + 0.0 AS {alias or n}")
    return ", ".join(items)
