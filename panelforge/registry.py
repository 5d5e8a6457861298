"""Where queries register themselves, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Rounded for comparison, off ties that the order of a sum decides; never minus zero."""
    return F.bround((F.col(x) if isinstance(x, str) else x) + F.lit(1e-9), 6) + F.lit(0.0)


def q6(x: str) -> str:
    """The SQL twin of ``r6``."""
    return f"(CAST(round_even({x} + CAST(1e-9 AS DOUBLE), 6) AS DOUBLE) + 0.0)"
