"""Stand-in inputs: the driver's tables under the library's names, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.registry import table


def visits(spark: SparkSession, d: str) -> DataFrame:
    """Long visit table: entity, visit (0 to 3), measure, t (days), value (null below 1, a sentinel)."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("entity"), F.least(F.floor(day / 8), F.lit(3)).cast("int").alias("visit"), F.col("event_type").alias("measure"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(8.64e10)).alias("t"),
        F.when(F.col("value") >= 1, F.col("value")).alias("value"), day.alias("day"),
    )


VISITS = """visits AS (SELECT event_id, user_id AS entity, CAST(least(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 8, 3) AS INTEGER) AS visit,
 event_type AS measure, (epoch_us(ts) - 1704067200000000) / 8.64e10 AS t, CASE WHEN value >= 1 THEN value END AS value,
 CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day FROM events)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """One row per (entity, visit, measure): mean value and time."""
    return visits(spark, d).groupBy("entity", "visit", "measure").agg(F.avg("value").alias("value"), F.avg("t").alias("t"))


CELLS = VISITS + """, cells AS (SELECT entity, visit, measure, avg(value) AS value, avg(t) AS t FROM visits GROUP BY ALL)"""

MEASURES = ["click", "error", "purchase", "signup", "view"]


def wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per (entity, visit): a column per measure, and the mean time."""
    from panelforge.operators.panel import pivot_cells

    w = pivot_cells(cells(spark, d), ["entity", "visit"], "measure", MEASURES, "value")
    return w.join(visits(spark, d).groupBy("entity", "visit").agg(F.avg("t").alias("t")), ["entity", "visit"])


WIDE = CELLS + ", wide AS (SELECT entity, visit, " + ", ".join(f"max(value) FILTER (measure = '{m}') AS {m}" for m in MEASURES) + ", max(tt) AS t FROM cells JOIN (SELECT entity, visit, avg(t) AS tt FROM visits GROUP BY ALL) USING (entity, visit) GROUP BY entity, visit)"


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frame vectors: frame, entity, stratum, emb, x1..x3 (first components), y (a target with signal)."""
    e = table(spark, d, "embeddings")
    v = F.col("embedding")
    x = [v[i].cast("double") for i in range(3)]
    return e.select(
        F.col("vec_id").alias("frame"), (F.col("vec_id") % 97).alias("entity"), F.col("label").alias("stratum"), v.alias("emb"),
        x[0].alias("x1"), x[1].alias("x2"), x[2].alias("x3"), (20.0 + 10 * x[0] - 6 * x[1] + F.col("label") * 0.5 + (F.col("vec_id") * 7919 % 101) / 50.0).alias("y"),
    )


FRAMES = """frames AS (SELECT vec_id AS frame, vec_id % 97 AS entity, label AS stratum, embedding AS emb, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2,
 CAST(embedding[3] AS DOUBLE) AS x3, CAST(20.0 AS DOUBLE) + 10 * CAST(embedding[1] AS DOUBLE) - 6 * CAST(embedding[2] AS DOUBLE) + label * CAST(0.5 AS DOUBLE) + (vec_id * 7919 % 101) / CAST(50.0 AS DOUBLE) AS y FROM embeddings)"""


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Code map: frame, patch, code (0 to 15), stratum, entity."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("patch"), (F.col("l_suppkey") % 16).cast("int").alias("code"), F.col("l_returnflag").alias("stratum"), (F.col("l_orderkey") % 211).alias("entity"), F.col("l_partkey").alias("part"))


CODES = "codes AS (SELECT l_orderkey AS frame, l_linenumber AS patch, CAST(l_suppkey % 16 AS INTEGER) AS code, l_returnflag AS stratum, l_orderkey % 211 AS entity, l_partkey AS part FROM lineitem)"


def shots(spark: SparkSession, d: str) -> DataFrame:
    """Frames with source tags: entity (customer), source (nation), dataset, dates, lag."""
    li, o, s = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "supplier")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    return x.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.col("o_custkey").alias("entity"), F.col("s_nationkey").alias("source"), F.col("l_linestatus").alias("dataset"), F.col("l_returnflag").alias("stratum"),
        F.to_date("l_shipdate").alias("study"), F.to_date("o_orderdate").alias("anchor"), (F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) / 7.0).alias("weeks"), (F.col("l_quantity") - 25).alias("lag"),
    )


SHOTS = """shots AS (SELECT l_orderkey, l_linenumber, l_partkey AS part, o_custkey AS entity, s_nationkey AS source, l_linestatus AS dataset, l_returnflag AS stratum, CAST(l_shipdate AS DATE) AS study, CAST(o_orderdate AS DATE) AS anchor,
 date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 7.0 AS weeks, l_quantity - 25 AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes per entity: percentile (0 to 100, by balance; bounded rows: one per customer segment bucket), group."""
    from panelforge.functions.clean import outcome_group

    c = table(spark, d, "customer")
    p = (F.col("c_custkey") * 7919 % 1009) / 1009.0 * 100
    return c.select(F.col("c_custkey").alias("entity"), p.alias("percentile"), outcome_group(p).alias("grp"), F.col("c_acctbal").alias("size"))


OUTCOMES = """outcomes AS (SELECT c_custkey AS entity, (c_custkey * 7919 % 1009) / CAST(1009.0 AS DOUBLE) * 100 AS percentile, CASE WHEN (c_custkey * 7919 % 1009) / CAST(1009.0 AS DOUBLE) * 100 < 10 THEN 'SGA' WHEN (c_custkey * 7919 % 1009) / CAST(1009.0 AS DOUBLE) * 100 > 90 THEN 'LGA' ELSE 'AGA' END AS grp, c_acctbal AS size FROM customer)"""


def entity_lag(spark: SparkSession, d: str) -> DataFrame:
    """Per entity: mean lag, frames, percentile, group, size."""
    return shots(spark, d).groupBy("entity").agg(F.avg("lag").alias("lag"), F.count("*").alias("n"), F.avg("weeks").alias("weeks")).join(outcomes(spark, d), "entity")


ENTITY_LAG = SHOTS + ", " + OUTCOMES + ", entity_lag AS (SELECT * FROM (SELECT entity, avg(lag) AS lag, count(*) AS n, avg(weeks) AS weeks FROM shots GROUP BY entity) JOIN outcomes USING (entity))"
