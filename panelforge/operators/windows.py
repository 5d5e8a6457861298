"""Window computations within entities, sources and result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators.lineage import cut


def average_rank(by: Sequence[str], order: str | Column) -> Column:
    """Rank with ties averaged; within ``by``."""
    w = Window.partitionBy(*by)
    o = F.col(order) if isinstance(order, str) else order
    return F.rank().over(w.orderBy(o)) + (F.count("*").over(w.partitionBy(*by, o)) - 1) / 2.0


#: Rows up to which an order is made in one task (a checked count); beyond, it is made by ranges.
ONE_TASK = 200_000


def _ordered(df: DataFrame, keys: Sequence[str | Column]) -> tuple[DataFrame, bool]:
    """``df`` computed once: few rows as they are, and True; more of them range-partitioned by ``keys``, with the partition in ``_part``.

    By ranges, what is before a row is in its partition or in a lower one.
    """
    x = cut(df)
    if x.count() <= ONE_TASK:
        return x, True
    return cut(x.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())), False


def _same(by: Sequence[str], a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]


def numbered(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "number") -> DataFrame:
    """Row numbers from 1 within ``by`` in a total ``order``, by ranges: neither the rows nor a group have to fit one task."""
    names = [f"_o{i}" for i in range(len(order))]
    asc = [F.col(o) if isinstance(o, str) else o for o in order]
    x, few = _ordered(df.withColumns(dict(zip(names, asc))), [*by, *names])
    if few:
        return x.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*names)).cast("long")).drop(*names)
    sizes = x.groupBy("_part", *by).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", *by, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*names))
    one = reduce(and_, _same(by, "x", "s"), F.col("x._part") == F.col("s._part"))
    out = x.withColumn("_i", inner).alias("x").join(sizes.alias("s"), one)
    return out.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("_i") + F.col("_before")).cast("long").alias(name))


def running(df: DataFrame, value: str, sums: Sequence[str] = (), lows: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """For rows with distinct ``value`` (within ``by``): ``<c>_upto``, sums over the rows up to and with each, and ``<c>_from``, minima from each on."""
    x, few = _ordered(df, [*by, value])
    w = Window.partitionBy(*([] if few else ["_part"]), *by).orderBy(value)
    x = x.withColumns({f"{c}_upto": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in sums} | {f"{c}_from": F.min(c).over(w.rowsBetween(0, Window.unboundedFollowing)) for c in lows})
    if few:
        return x
    totals = x.groupBy("_part", *by).agg(*[F.sum(c).alias(f"{c}_t") for c in sums], *[F.min(c).alias(f"{c}_l") for c in lows])
    whole = Window.partitionBy(*by).orderBy("_part")
    below, above = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(1, Window.unboundedFollowing)
    totals = totals.select("_part", *by, *[F.coalesce(F.sum(f"{c}_t").over(below), F.lit(0)).alias(f"{c}_t") for c in sums], *[F.min(f"{c}_l").over(above).alias(f"{c}_l") for c in lows])
    x = x.alias("x").join(totals.alias("s"), reduce(and_, _same(by, "x", "s"), F.col("x._part") == F.col("s._part")))
    return x.select(*[F.col(f"x.{c}") for c in df.columns], *[(F.col(f"{c}_upto") + F.col(f"{c}_t")).alias(f"{c}_upto") for c in sums], *[F.least(f"{c}_from", f"{c}_l").alias(f"{c}_from") for c in lows])


def ranked(df: DataFrame, value: str, name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Average ranks (within ``by``; null for a null value): rows are reduced to counts by value, those summed up by ranges, and joined back by value.

    The rows are computed once: a sum of doubles that came out differently a second time would find no rank.
    """
    df = cut(df)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranks = running(counts, value, ["_c"], by=by).select(*by, value, (F.col("_c_upto") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(name))
    one = reduce(and_, _same(by, "x", "s"), F.col(f"x.{value}") == F.col(f"s.{value}"))
    return df.alias("x").join(ranks.alias("s"), one, "left").select("x.*", f"s.{name}")


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles ``q0``, ``q1``, ... (linear between neighbours), one row, or one per group of ``by``.

    Values are counted, and the counts summed up by ranges, so neither the rows nor a group's distinct values have to fit one
    task. A group without a value has no row (nulls without ``by``).
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    x = running(counts, "_v", ["_c"], by=by)
    if not by:
        x = cut(x)
    n = x.groupBy(*by).agg(F.sum("_c").alias("_all"))
    x = x.crossJoin(F.broadcast(n)) if not by else x.alias("x").join(n.alias("s"), reduce(and_, _same(by, "x", "s"))).select("x.*", "s._all")
    picks = []
    for i, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("_all") - 1)
        k = F.floor(at + 1e-9)
        above = lambda m: F.min(F.when(F.col("_c_upto") > m, F.col("_v")))
        picks += [above(k).alias(f"_l{i}"), above(k + 1).alias(f"_h{i}"), F.max(F.greatest(at - k, F.lit(0.0))).alias(f"_s{i}")]
    q = x.groupBy(*by).agg(*picks)
    return q.select(*by, *[(F.col(f"_l{i}") + (F.coalesce(f"_h{i}", f"_l{i}") - F.col(f"_l{i}")) * F.col(f"_s{i}")).alias(f"q{i}") for i in range(len(shares))])


def clr(df: DataFrame, key: str, value: str, floor: float = 1e-6) -> DataFrame:
    """Centred log-ratio of the shares of ``value`` within ``key``."""
    w = Window.partitionBy(key)
    x = df.withColumn("_p", F.col(value) / F.sum(value).over(w))
    logs = F.ln(F.greatest(F.col("_p"), F.lit(floor)))
    return x.withColumn("clr", logs - F.avg(logs).over(w)).drop("_p")


def velocity(df: DataFrame, key: str, order: str, time: str, value: str) -> DataFrame:
    """Change per time unit to the nominal next visit, if both are observed and time goes on."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.withColumns({"_o": F.lead(order).over(w), "_t": F.lead(time).over(w), "_v": F.lead(value).over(w)})
    ok = (F.col("_o") == F.col(order) + 1) & (F.col("_t") > F.col(time)) & F.col("_v").isNotNull() & F.col(value).isNotNull()
    return x.where(ok).select(key, order, ((F.col(time) + F.col("_t")) / 2).alias("mid_time"), ((F.col("_v") - F.col(value)) / (F.col("_t") - F.col(time))).alias("velocity"))


def left_out_deviation(df: DataFrame, key: str, time: str, value: str, least: int = 3) -> DataFrame:
    """Each point minus the line through its entity's other points; only between them, from ``least`` points."""
    w = Window.partitionBy(key)
    t, y = F.col(time), F.col(value)
    x = df.where(y.isNotNull() & t.isNotNull())
    x = x.withColumns({"_n": F.count("*").over(w), "_t": F.sum(t).over(w), "_y": F.sum(y).over(w), "_tt": F.sum(t * t).over(w), "_ty": F.sum(t * y).over(w), "_r": F.row_number().over(w.orderBy(t)), "_s": F.row_number().over(w.orderBy(t.desc()))})
    n, st, sy = F.col("_n") - 1, F.col("_t") - t, F.col("_y") - y
    stt, sty = F.col("_tt") - t * t, F.col("_ty") - t * y
    det = n * stt - st * st
    slope = F.when(F.abs(det) > 1e-9, (n * sty - st * sy) / F.nullif(det, F.lit(0.0)))
    line = (sy - slope * st) / n + slope * t
    return x.where((F.col("_n") >= least) & (F.col("_r") > 1) & (F.col("_s") > 1)).withColumn("deviation", y - line).drop("_n", "_t", "_y", "_tt", "_ty", "_r", "_s")


def centred(df: DataFrame, group: str, value: str, name: str = "centred") -> DataFrame:
    """Value minus its group's mean, by an aggregate joined back (groups may be few and large)."""
    return df.join(df.groupBy(group).agg(F.avg(value).alias("_m")), group, "left").withColumn(name, F.col(value) - F.col("_m")).drop("_m")


def stratum_z(df: DataFrame, group: str, value: str, least: int = 10, eps: float = 1e-8, ddof: int = 0, name: str = "z") -> DataFrame:
    """z within strata of at least ``least`` rows; smaller strata are null."""
    sd = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    s = df.groupBy(group).agg(F.avg(value).alias("_m"), sd.alias("_s"), F.count(value).alias("_n"))
    return df.join(s, group, "left").withColumn(name, F.when(F.col("_n") >= least, (F.col(value) - F.col("_m")) / (F.col("_s") + eps))).drop("_m", "_s", "_n")


def with_row(df: DataFrame, *aggs: Column) -> DataFrame:
    """Put one row of global aggregates beside every row."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def percentile_cut(df: DataFrame, value: str, shares: Sequence[float], name: str = "cut") -> DataFrame:
    """Right-closed classes at exact percentiles: 0 to len(shares)."""
    x = df.crossJoin(F.broadcast(quantiles(df, value, shares)))
    return x.withColumn(name, sum((F.col(value) > F.col(f"q{i}")).cast("int") for i in range(len(shares)))).drop(*[f"q{i}" for i in range(len(shares))])


def collapse_rare(df: DataFrame, group: str, least: int, other: str = "pooled") -> DataFrame:
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    return df.join(n, group, "left").withColumn(group, F.when(F.col("_n") < least, other).otherwise(F.col(group))).drop("_n")


def to_grid(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each entity's path at whole times, by linear interpolation between its points; no extrapolation."""
    w = Window.partitionBy(key).orderBy(time)
    x = df.where(F.col(value).isNotNull()).withColumns({"_t": F.lead(time).over(w), "_v": F.lead(value).over(w)})
    x = x.where(F.col("_t").isNotNull() & (F.col("_t") > F.col(time)))
    x = x.withColumn("_final", F.lead("_t").over(w).isNull())
    low, high = F.ceil(F.col(time)), F.when(F.col("_final"), F.floor("_t")).otherwise(F.ceil("_t") - 1)
    x = x.where(low <= high).withColumn("at", F.explode(F.sequence(low, high)))
    return x.select(key, "at", (F.col(value) + (F.col("_v") - F.col(value)) * (F.col("at") - F.col(time)) / (F.col("_t") - F.col(time))).alias(value))


def harmonic(n: str) -> Column:
    """1 + 1/2 + ... + 1/n: added up while n is small, by its expansion beyond."""
    x = F.col(n)
    few = F.aggregate(F.sequence(F.lit(1), F.least(x, F.lit(1000)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return F.when(x <= 1000, few).otherwise(F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x))


def adjust_p(df: DataFrame, p: str = "p", by: Sequence[str] = (), method: str = "bh") -> DataFrame:
    """Benjamini-Hochberg or -Yekutieli adjusted p over a result table (family = ``by``): ranks and minima by ranges."""
    c = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_c"))
    m = c.groupBy(*by).agg(F.sum("_c").alias("_m"))
    m = m.withColumn("_h", harmonic("_m") if method == "by" else F.lit(1.0))
    x = running(c, p, ["_c"], by=by)
    x = x.join(m, list(by)) if by else x.crossJoin(F.broadcast(m))
    x = running(x.select(*by, p, (F.col(p) * F.col("_m") / F.col("_c_upto") * F.col("_h")).alias("_q")), p, lows=["_q"], by=by)
    return df.join(x.select(*by, p, F.least("_q_from", F.lit(1.0)).alias("q")), [*by, p])


def balance_weights(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Inverse count of the value's bin (equal bins, clipped), scaled to mean 1."""
    x = df.withColumn("_b", F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)))
    x = x.join(x.groupBy("_b").agg(F.count("*").alias("_n")), "_b")
    return with_row(x.withColumn("_w", 1.0 / F.col("_n")), F.avg("_w").alias("_m")).withColumn("weight", F.col("_w") / F.col("_m")).drop("_b", "_n", "_w", "_m")


def debiased(df: DataFrame, y: str, x: str, name: str = "debiased") -> DataFrame:
    """y minus its straight-line regression on x; the rows are computed once."""
    df = cut(df)
    return with_row(df, F.regr_slope(y, x).alias("_k"), F.regr_intercept(y, x).alias("_c")).withColumn(name, F.col(y) - F.col("_k") * F.col(x) - F.col("_c")).drop("_k", "_c")


def robust_z(df: DataFrame, value: str, name: str = "robust_z", least: int = 0) -> DataFrame:
    """(value - median) / (1.4826 MAD); null from fewer than ``least`` rows or without spread. The rows are computed once."""
    df = cut(df)
    n = df.agg(F.count(value).alias("_n"))
    x = df.crossJoin(F.broadcast(quantiles(df, value, [0.5]).withColumnRenamed("q0", "_m")))
    x = x.withColumn("_a", F.abs(F.col(value) - F.col("_m")))
    x = x.crossJoin(F.broadcast(quantiles(x, "_a", [0.5]).withColumnRenamed("q0", "_mad"))).crossJoin(F.broadcast(n))
    z = F.when((F.col("_n") >= least) & (F.col("_mad") > 0), (F.col(value) - F.col("_m")) / (1.4826 * F.nullif(F.col("_mad"), F.lit(0.0))))
    return x.withColumn(name, z).drop("_m", "_a", "_mad", "_n")


def outlier_score(long: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Per entity the largest |x - median| / std over its observed columns."""
    s = long.groupBy(column).agg(F.stddev_pop(value).alias("_s")).join(quantiles(long, value, [0.5], [column]).withColumnRenamed("q0", "_m"), column)
    return long.join(s, column).groupBy(key).agg(F.max(F.abs(F.col(value) - F.col("_m")) / F.col("_s")).alias("score"))
