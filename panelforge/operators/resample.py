"""Permutation nulls, bootstraps and gates, on entity-level tables.

A permutation is a keyed bijection of row numbers (``bijection``): rows are numbered once, whatever the
replicates, and only the target's numbers move. Bootstraps draw by hashes of (replicate, id). A retried task
draws the same replicate. Replicates are a column; statistics that are sums of products need no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.bijection import with_partner
from panelforge.operators.lineage import cut
from panelforge.operators.windows import numbered, ranked

Order = Callable[[str, str], Column]


def hash_order(seed: int = 0) -> Order:
    """Pseudo-random order of ids within a replicate."""
    return lambda replicate, key: F.xxhash64(F.col(replicate), F.col(key), F.lit(seed))


def arithmetic_order(a: int = 7919, b: int = 104729, m: int = 10007) -> Order:
    """An order that SQL can state too."""
    return lambda replicate, key: (F.col(key) * a + F.col(replicate) * b + F.col(key) * F.col(replicate) * 31) % m


def replicated(df: DataFrame, n: int, name: str = "replicate") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def _numbered(df: DataFrame, key: str, target: str, strata: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with its number within ``strata`` (``_i``) and their sizes (``_n``), and the targets by number (``_j``)."""
    x = cut(numbered(df, [key], strata, "_i"))
    if strata:
        sizes = x.groupBy(*strata).agg(F.count("*").alias("_n"))
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"s.{c}")) for c in strata]
        x = x.alias("x").join(sizes.alias("s"), reduce(and_, same)).select("x.*", "s._n")
    else:
        x = x.withColumn("_n", F.lit(x.count()))
    return x, x.select(*[F.col(c).alias(f"_{c}") for c in strata], F.col("_i").alias("_j"), F.col(target).alias(f"{target}_perm"))


def permuted(df: DataFrame, key: str, target: str, n: int, strata: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Per replicate (1 to ``n``) the target permuted among rows (within ``strata``): column ``<target>_perm``.

    Rows are numbered once by key, by ranges; a replicate's partner is computed, and the targets are
    joined by number. A replicate doesn't have to fit one task, and no replicate is sorted. Rows ride along with each replicate: for wide
    rows use ``with_permutations``.
    """
    x, y = _numbered(df, key, target, strata)
    x = with_partner(replicated(x, n), "_i", "_n", "replicate", "_p", seed)
    same = [F.col("_p") == F.col("_j"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in strata]]
    return x.join(y, reduce(and_, same)).drop("_i", "_j", "_n", "_p", *[f"_{c}" for c in strata])


def with_permutations(df: DataFrame, key: str, target: str, n: int, name: str = "perms", seed: int = 0) -> DataFrame:
    """``df`` with an array of ``n`` targets: element r - 1 is what replicate r puts in the row's place. Only numbers and targets move, not the rows' vectors."""
    x, y = _numbered(df, key, target, ())
    moved = with_partner(replicated(x.select("_i", "_n"), n), "_i", "_n", "replicate", "_p", seed)
    both = F.sort_array(F.collect_list(F.struct("replicate", f"{target}_perm")))
    lists = moved.join(y, F.col("_p") == F.col("_j")).groupBy("_i").agg(F.transform(both, lambda s: s[f"{target}_perm"]).alias(name))
    return x.join(lists, "_i").drop("_i", "_n")


def permutation_test(df: DataFrame, key: str, target: str, statistic: Callable[[str], Column], n: int, strata: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Observed |statistic|, its p = (1 + #)/(1 + n) (equal up to 1e-9 counts), and the null's mean and 95th percentile."""
    df = cut(df)
    observed = df.agg(F.abs(statistic(target)).alias("observed"))
    null = permuted(df, key, target, n, strata, seed).groupBy("replicate").agg(F.abs(statistic(f"{target}_perm")).alias("null"))
    x = null.crossJoin(F.broadcast(observed))
    return x.groupBy("observed").agg(((1 + F.count_if(F.col("null") >= F.col("observed") - 1e-9)) / (1.0 + n)).alias("p"), F.avg("null").alias("null_mean"), F.percentile("null", F.lit(0.95)).alias("null_p95"))


def whole_groups(df: DataFrame, group: str, target: str, n: int, seed: int = 0) -> DataFrame:
    """Permute the target among groups (one target per group), then give it to their rows."""
    groups = df.groupBy(group).agg(F.min(target).alias(target))
    p = permuted(groups, group, target, n, seed=seed).select(group, "replicate", f"{target}_perm")
    return df.join(p, group)


def shuffled_times(df: DataFrame, entity: str, key: str, time: str, n: int, seed: int = 0) -> DataFrame:
    """Times permuted within each entity."""
    return permuted(df, key, time, n, [entity], seed)


def poisson_weights(df: DataFrame, key: str, n: int, order: Order | None = None, modulus: int = 10007) -> DataFrame:
    """Bootstrap weights per (replicate, entity): Poisson(1) from a hash. Same limit as the multinomial."""
    u = (F.pmod((order or hash_order())("replicate", key), F.lit(modulus)) + 0.5) / modulus
    w = F.lit(0)
    for edge in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183):
        w = w + (u > edge).cast("int")
    return replicated(df, n).withColumn("weight", w)


#: Rows that share a leaf of the multinomial's tree.
LEAF = 1024


def _leaf_counts(n: int, block: int, leaf: int, replicate: int, seed: int, known: dict[tuple[int, int], int]) -> np.ndarray:
    """How often a replicate of n draws takes each row of a leaf of ``block`` rows: counts are split down a tree of row ranges by binomials, each seeded by its place."""
    draw = lambda *place: np.random.Generator(np.random.Philox(key=[seed, replicate], counter=[0, 0, *place]))
    low, high, count = 0, -(-n // block), n
    while high - low > 1:
        middle = (low + high) // 2
        rows = lambda a, b: min(b * block, n) - a * block
        left = known.get((low, high))
        if left is None:
            left = known[low, high] = int(draw(low, high).binomial(count, rows(low, middle) / rows(low, high)))
        if leaf < middle:
            high, count = middle, left
        else:
            low, count = middle, count - left
    size = min((leaf + 1) * block, n) - leaf * block
    return draw(leaf, (1 << 62) + leaf).multinomial(count, np.full(size, 1 / size))


def multinomial_weights(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Bootstrap weights per (replicate, row): exactly multinomial, so a replicate's weights sum to the rows.

    Rows are numbered once; a weight follows from the number alone, so it is the same for any partitioning and nothing is shuffled for it.
    """
    x = cut(numbered(df, [key], name="_i"))
    rows, block, names, kinds = x.count(), LEAF, df.columns, ", ".join(f"{c} {t}" for c, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
        for batch in batches:
            at = batch["_i"].to_numpy() - 1
            leaves = at // block
            for r in range(n):
                weight = np.zeros(len(at), np.int64)
                for leaf in np.unique(leaves).tolist():
                    own = leaves == leaf
                    weight[own] = _leaf_counts(rows, block, leaf, r + 1, seed, known[r])[at[own] % block]
                if len(known[r]) > 1 << 12:
                    known[r].clear()
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(np.full(len(at), r + 1, np.int32)), pa.array(weight)], [*names, "replicate", "weight"])

    return x.mapInArrow(run, f"{kinds}, replicate int, weight long")


def weighted_correlation(a: str, b: str, w: str = "weight") -> Column:
    n, x, y, wt = F.sum(w), F.col(a), F.col(b), F.col(w)
    sx, sy, sxy, sxx, syy = (F.sum(wt * v) for v in (x, y, x * y, x * x, y * y))
    return (n * sxy - sx * sy) / F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))


def bootstrap_interval(df: DataFrame, key: str, statistic: Column, n: int, order: Order | None = None, level: float = 0.95, exact: bool = False) -> DataFrame:
    """Percentile interval of a weighted statistic over entity bootstraps (``exact``: multinomial weights); degenerate replicates are left out."""
    s = (multinomial_weights(df, key, n) if exact else poisson_weights(df, key, n, order)).groupBy("replicate").agg(statistic.alias("s")).where(F.col("s").isNotNull() & ~F.isnan("s"))
    low = (1 - level) / 2
    return s.agg(F.percentile("s", F.lit(low)).alias("low"), F.percentile("s", F.lit(0.5)).alias("middle"), F.percentile("s", F.lit(1 - low)).alias("high"), F.count("*").alias("replicates"))


def paired_difference(df: DataFrame, key: str, first: Column, second: Column, n: int, order: Order | None = None) -> DataFrame:
    """Interval of first - second over the same bootstraps, and the share above 0."""
    s = poisson_weights(df, key, n, order).groupBy("replicate").agg((first - second).alias("s")).where(F.col("s").isNotNull() & ~F.isnan("s"))
    return s.agg(F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"), F.avg((F.col("s") > 0).cast("double")).alias("above"), F.count("*").alias("replicates"))


def subsample_curve(df: DataFrame, key: str, statistic: Column, shares: Sequence[float], n: int, order: Order | None = None, modulus: int = 10007) -> DataFrame:
    """A statistic on hash-chosen shares of the entities."""
    x = replicated(df, n).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    u = F.pmod((order or hash_order())("replicate", key), F.lit(modulus))
    return x.where(u < F.col("share") * modulus).groupBy("share", "replicate").agg(statistic.alias("s")).groupBy("share").agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"), F.count("*").alias("n"))


def gate(results: DataFrame, control: str, metric: str, value: str, least: float) -> DataFrame:
    """Report nulls only if the positive control passes: adds ``valid`` to each result."""
    ok = results.agg((F.max(F.when(F.col(metric) == control, F.col(value))) >= least).alias("valid"))
    return results.where(F.col(metric) != control).crossJoin(F.broadcast(ok)).withColumn("valid", F.coalesce("valid", F.lit(False)))


def per_replicate(df: DataFrame, statistic: Callable[[pd.DataFrame], float], n: int, order: Order | None = None, key: str = "entity") -> DataFrame:
    """Plug point for statistics with no sum form: an entity-level replicate at a time, with its weights."""
    def run(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"replicate": [key_[0]], "s": [float(statistic(rows))]})

    return poisson_weights(df, key, n, order).groupBy("replicate").applyInPandas(run, "replicate int, s double")


def anchored(df: DataFrame, key: str, axes: Sequence[str], anchors: dict[str, str], n: int = 200, seed: int = 0) -> DataFrame:
    """``(axis, anchor, metric, value, p, n)``: what each axis has to do with each anchor, with a two-sided permutation p.

    ``anchors`` says how a column is held against the axes: ``r`` (Pearson) or ``auc`` (a flag of 0 and 1; ties count
    half, and what is tested is the distance from a half). An anchor's rows are those with a value whose axes are all there; its
    values are permuted among them, ``n`` times, the same permutation for all axes. Both measures are sums over rows of a fixed
    score (the axis, or its rank) and the permuted value, so a replicate is an aggregate and ranks are made once.
    ``value`` and ``p`` are null where an axis or an anchor is constant; anchors without rows give none.
    """
    wrong = sorted(set(anchors.values()) - {"r", "auc"})
    if wrong:
        raise ValueError(f"an anchor is held against axes by r or auc, not by {', '.join(wrong)}")
    whole = reduce(and_, [F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) for a in axes])
    sides = [F.struct(F.lit(name).alias("anchor"), F.lit(kind).alias("metric"), F.col(name).cast("double").alias("y")) for name, kind in anchors.items()]
    x = df.where(whole).select(F.col(key).alias("_key"), *[F.col(a).cast("double").alias(f"_a{i}") for i, a in enumerate(axes)], F.explode(F.array(*sides)).alias("_s"))
    x = x.select("_key", *[f"_a{i}" for i in range(len(axes))], "_s.*").where("y is not null and not isnan(y)")
    x = cut(x)
    for i in range(len(axes)):
        x = ranked(x, f"_a{i}", f"_k{i}", by=["anchor"])
    score = [F.when(F.col("metric") == "auc", F.col(f"_k{i}")).otherwise(F.col(f"_a{i}")).alias(f"_z{i}") for i in range(len(axes))]
    x = cut(x.select("_key", "anchor", "metric", "y", *score))
    moved = permuted(x, "_key", "y", n, ["anchor"], seed).drop("y").withColumnRenamed("y_perm", "y")
    rows = x.withColumn("replicate", F.lit(0)).unionByName(moved)

    def measured(z: str) -> Column:
        ones, zeros = F.sum("y"), F.sum(1 - F.col("y"))
        auc = (F.sum(F.col(z) * F.col("y")) - ones * (ones + 1) / 2) / F.nullif(ones * zeros, F.lit(0.0))
        r = F.covar_pop(z, "y") / F.nullif(F.stddev_pop(z) * F.stddev_pop("y"), F.lit(0.0))
        return F.when(F.col("metric") == "auc", F.when(F.min(z) < F.max(z), auc)).otherwise(r)

    every = F.array(*[F.struct(F.lit(a).alias("axis"), measured(f"_z{i}").alias("value")) for i, a in enumerate(axes)])
    found = cut(rows.groupBy("anchor", "metric", "replicate").agg(F.count("*").alias("n"), every.alias("_v")).select("anchor", "metric", "replicate", "n", F.inline("_v")))
    far = F.abs(F.col("value") - F.when(F.col("metric") == "auc", 0.5).otherwise(0.0))
    real = found.where("replicate = 0").select("axis", "anchor", "metric", "value", "n", far.alias("_far"))
    null = found.where("replicate > 0").select("axis", "anchor", far.alias("_null"))
    p = (1 + F.count_if(F.col("_null") >= F.col("_far") - 1e-9)) / F.lit(n + 1.0)
    out = real.join(null, ["axis", "anchor"]).groupBy("axis", "anchor", "metric", "value", "n").agg(p.alias("p"))
    return out.select("axis", "anchor", "metric", "value", F.when(F.col("value").isNotNull(), F.col("p")).alias("p"), "n")
