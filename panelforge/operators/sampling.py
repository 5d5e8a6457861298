"""Deterministic samples: order by a hash of ids, so a retried task takes the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators.windows import numbered


def hash_key(*ids: str, seed: int = 0) -> Column:
    return F.xxhash64(*[F.col(c) for c in ids], F.lit(seed))


def capped(df: DataFrame, by: Sequence[str], order: Column, tie: str, cap: int, overall: int | None = None) -> DataFrame:
    """At most ``cap`` rows per key, in the given pseudo-random order; of these the first ``overall`` of all, in the same order (by ranges)."""
    w = Window.partitionBy(*by).orderBy(order, tie)
    x = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    return x if overall is None else numbered(x, [order, tie], name="_r").where(F.col("_r") <= overall).drop("_r")


def exactly(df: DataFrame, by: Sequence[str], order: Column, tie: str, budget: int) -> DataFrame:
    """Exactly ``budget`` rows per key: without replacement where there are enough, else by turns through all rows."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(order, tie)) - 1)
    x = x.where(F.col("_r") < budget)
    last = F.floor((F.lit(budget - 1) - F.col("_r")) / F.col("_n"))
    return x.withColumn("draw", F.explode(F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: (i * F.col("_n") + F.col("_r")).cast("int")))).drop("_n", "_r")


def top_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of the ``n`` largest groups (ties by smallest group)."""
    top = df.groupBy(group).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), group).limit(n).select(group)
    return df.join(F.broadcast(top), group, "left_semi")


def strongest(df: DataFrame, by: Sequence[str], value: str, tie: str, n: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs(F.col(value))), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def families(df: DataFrame, family: str, effect: str) -> DataFrame:
    """Families by mean |effect|, strongest first: a table of few rows."""
    g = df.groupBy(family).agg(F.avg(F.abs(F.col(effect))).alias("strength"))
    return numbered(g, [-F.col("strength"), family], name="rank").withColumn("rank", F.col("rank").cast("int"))


def greedy_keep(columns: Sequence[str], redundant: Callable[[list[str], str], bool]) -> list[str]:
    """Keep a column unless it is redundant beside those kept; a list of names, on the driver."""
    kept: list[str] = []
    for c in columns:
        if not redundant(kept, c):
            kept.append(c)
    return kept
