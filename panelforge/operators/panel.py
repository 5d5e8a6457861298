"""Joins, panels and sequences over long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def align(spine: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join wide tables to the spine's keys; what doesn't match is null. Spark picks broadcast by size."""
    out = spine.select(key).distinct()
    for t in tables:
        out = out.join(t, key, "left")
    return out


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in ``order`` (which must be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return df.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def pivot_cells(long: DataFrame, by: Sequence[str], column: str, values: Sequence, value: str, prefix: str = "") -> DataFrame:
    """Wide cells with stated columns: one aggregation, no pass to find the values."""
    return long.groupBy(*by).agg(*[F.max(F.when(F.col(column) == v, F.col(value))).alias(f"{prefix}{v}") for v in values])


def near_time_join(slots: DataFrame, bins: DataFrame, key: str, slot_time: str, bin_time: str, value: str, offsets: Sequence[int] = (0, -1, 1)) -> DataFrame:
    """The value of the bin at the slot's time, else at the next offset in turn.

    The candidates are exploded into equal keys, so the join is an equi-join; the best one wins in an aggregate.
    """
    ranked = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), (F.col(slot_time) + o).alias("at")) for i, o in enumerate(offsets)]))
    tried = slots.withColumn("_c", ranked).select(*slots.columns, "_c.*")
    found = tried.join(bins.select(key, F.col(bin_time).alias("at"), F.col(value).alias("_v")), [key, "at"], "left")
    return found.groupBy(*slots.columns).agg(F.min_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.col("rank"))).alias(value))


def last_before(df: DataFrame, key: str, time: str, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """As-of last: time and value of each key's last real measurement (in [low, high) if given)."""
    ok = F.col(value).isNotNull()
    ok = ok & (F.col(time) >= low) if low is not None else ok
    ok = ok & (F.col(time) < high) if high is not None else ok
    last = F.max(F.when(ok, F.struct(F.col(time).alias("t"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(last.alias("x")).select(key, F.col("x.t").alias("last_time"), F.col("x.v").alias("last_value"))


def at_cutoffs(df: DataFrame, cutoffs: Sequence[float], key: str, time: str, value: str, before: int = 2, after: int = 1) -> DataFrame:
    """For each cutoff, what a key shows up to it; keys need enough slots before and after.

    The few cutoffs are exploded in place, so there is no theta join.
    """
    x = df.where(F.col(value).isNotNull()).withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])))
    past = F.col(time) <= F.col("cutoff")
    g = x.groupBy(key, "cutoff").agg(
        F.count_if(past).alias("n_before"), F.count_if(~past).alias("n_after"),
        F.max_by(value, F.when(past, F.col(time))).alias("current"), F.regr_slope(F.when(past, F.col(value)), F.when(past, F.col(time))).alias("slope"),
        F.max_by(value, time).alias("final"),
    )
    return g.where((F.col("n_before") >= before) & (F.col("n_after") >= after))


def coverage(wide: DataFrame, sets: dict[str, Sequence[str]]) -> DataFrame:
    """Per feature set: rows, features, observed share, complete rows; one pass."""
    aggs = []
    for name, cols in sets.items():
        seen = [F.col(c).isNotNull() for c in cols]
        every = seen[0]
        for s in seen[1:]:
            every = every & s
        aggs += [F.avg(sum(s.cast("double") for s in seen) / len(cols)).alias(f"{name}_o"), F.count_if(every).alias(f"{name}_c")]
    one = wide.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("feature_set"), F.col("n"), F.lit(len(v)).alias("features"), F.col(f"{k}_o").alias("observed"), F.col(f"{k}_c").alias("complete")) for k, v in sets.items()])
    return one.select(F.inline(rows))


def dense_columns(wide: DataFrame, columns: Sequence[str], least: float = 0.9) -> list[str]:
    """Columns observed in more than ``least`` of the rows."""
    r = wide.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if (r[c] or 0) > least]


def sequence_of(df: DataFrame, key: str, time: str, fields: Sequence[str], most: int | None = None) -> DataFrame:
    """Per key an array of (time, fields) sorted by time, and its length."""
    a = F.sort_array(F.collect_list(F.struct(F.col(time), *fields)))
    return df.groupBy(key).agg((F.slice(a, 1, most) if most else a).alias("seq")).withColumn("length", F.size("seq"))


def thin_evenly(df: DataFrame, key: str, time: str, most: int = 12) -> DataFrame:
    """At most ``most`` rows per key, evenly spaced: row floor(j * (n - 1) / (most - 1))."""
    w = Window.partitionBy(key)
    x = df.withColumn("_i", F.row_number().over(w.orderBy(time)) - 1).withColumn("_n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / (most - 1)))
    return x.where((F.col("_n") <= most) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def profile(long: DataFrame, column: str, value: str) -> DataFrame:
    """Coverage, levels and constancy of each column of a long table."""
    return long.groupBy(column).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"), F.count_distinct(value).alias("levels"), (F.count_distinct(value) <= 1).alias("constant"))


def held_out_only(df: DataFrame, mask: DataFrame | None, key: str) -> DataFrame:
    """Rows of entities that a trained representation never saw; without a mask there is nothing to score, and that raises."""
    if mask is None or key not in mask.columns or mask.isEmpty():
        raise ValueError(f"no held-out mask with column {key!r}: scores on seen entities would count")
    return df.join(mask.select(key), key, "left_semi")


def tolerant_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, value: str) -> DataFrame:
    """Left rows with the smallest ``value`` of the right rows that have the same normalised key: ``matched``, ``found``."""
    b = right.groupBy(right_key.alias("_k")).agg(F.min(value).alias("matched"))
    return left.withColumn("_k", left_key).join(b, "_k", "left").drop("_k").withColumn("found", F.col("matched").isNotNull())


def match_rate(joined: DataFrame) -> DataFrame:
    """Rows, matches and their share."""
    return joined.agg(F.count("*").alias("rows"), F.count_if("found").alias("matches"), F.avg(F.col("found").cast("double")).alias("rate"))


def largest_weeks(df: DataFrame, key: str, week: str, count: str, most: int = 8) -> DataFrame:
    """Per key the ``most`` weeks with most frames (ties: the earlier week)."""
    w = Window.partitionBy(key).orderBy(F.desc(count), week)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def consecutive(df: DataFrame, key: str, order: str, time: str, value: str) -> DataFrame:
    """Pairs of a visit and the nominal next one, both with a value, in time order: ``v0``, ``v1``, ``gap``."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.select(key, order, F.col(value).alias("v0"), F.col(time).alias("_t"), F.lead(order).over(w).alias("_o"), F.lead(value).over(w).alias("v1"), F.lead(time).over(w).alias("_u"))
    x = x.where((F.col("_o") == F.col(order) + 1) & F.col("v0").isNotNull() & F.col("v1").isNotNull() & (F.col("_u") > F.col("_t")))
    return x.select(key, order, "v0", "v1", (F.col("_u") - F.col("_t")).alias("gap"))
