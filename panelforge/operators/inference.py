"""Nested cross-validation, increments over seeds, parallel analysis and other inference from Gram matrices.

Every candidate system is a block or a sum of Gram matrices that one pass over the rows makes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import linear, resample, windows
from panelforge.operators.lineage import cut
from panelforge.operators.vectors import matrix
from panelforge.operators.windows import numbered


def keyed(x: DataFrame, by: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Gram matrices by few combined keys, on the driver."""
    return {tuple(r[c] for c in by): linear._square(r["gram"]) for r in linear.gram_table(x, by).toLocalIterator()}


def fold_r2(grams: Sequence[np.ndarray], features: Sequence[int], alpha: float) -> float:
    """Out-of-fold R2 of some features (places in x) from one Gram matrix per fold; the target is last."""
    total = sum(grams)
    rows = [0, *[1 + i for i in features], total.shape[0] - 1]
    at = np.ix_(rows, rows)
    rss = 0.0
    for own in grams:
        v = np.append(-linear.ridge((total - own)[at], len(features), alpha)[:, 0], 1.0)
        rss += v @ own[at] @ v
    return float(1 - rss / (linear.moments_of(total, 0)[2][-1, -1] * total[0, 0]))


def increments(df: DataFrame, small: Sequence[str], more: Sequence[str], target: str, entity: str, seeds: int, folds: int = 5, alpha: float = 1.0, fold: Callable[[str], Column] | None = None) -> DataFrame:
    """``(seed, small, joint, increment)``: out-of-fold R2 with and without more features, over independent fold seeds."""
    fold = fold or (lambda seed: F.pmod(F.xxhash64(F.col(entity), F.col(seed)), F.lit(folds)).cast("int"))
    x = resample.replicated(df, seeds, "seed").withColumn("fold", fold("seed"))
    x = linear.design(x, [*small, *more], [target], keep=["seed", "fold"])
    n_small, n_all = len(small), len(small) + len(more)

    def solved(table: pa.Table) -> pa.Table:
        g = [linear._square(v) for v in table["gram"].to_pylist()]
        a, b = fold_r2(g, range(n_small), alpha), fold_r2(g, range(n_all), alpha)
        return pa.table({"seed": table["seed"][:1], "small": [a], "joint": [b], "increment": [b - a]})

    return linear.gram_table(x, ["seed", "fold"]).groupBy("seed").applyInArrow(solved, "seed int, small double, joint double, increment double")


def spread(df: DataFrame, value: str) -> DataFrame:
    """Mean, 95 % interval over seeds, and the share that is not above 0."""
    v = F.col(value)
    return df.agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.025)).alias("low"), F.percentile(v, F.lit(0.975)).alias("high"), F.avg((v <= 0).cast("double")).alias("not_above"), F.count("*").alias("seeds"))


def calibrated(df: DataFrame, features: str | Sequence[str], target: str, low: float, high: float, bins: int, fold: str = "fold", alpha: float = 1.0) -> linear.Ridge:
    """Balance-weighted ridge, each fold held out in turn, its predictions calibrated on out-of-fold predictions of the others.

    A row's weight is the inverse count of its target's bin among the training rows, with mean 1, so Gram
    matrices by (fold, bin) hold every system. For an outer fold, each other fold is predicted without
    both; target on prediction, over those, gives the calibration line.
    """
    t = F.col(target)
    place = F.least(F.greatest(F.floor((t - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    x = linear.design(df.withColumn("_bin", place), features, [target], keep=[fold, "_bin"])
    g = keyed(x, [fold, "_bin"])
    if not g:
        return linear.Ridge({}, features)
    folds = sorted({f for f, _ in g})
    size = next(iter(g.values())).shape[0]
    p = size - 2

    def weighted(out: set) -> np.ndarray:
        by_bin: dict[int, np.ndarray] = {}
        for (f, b), m in g.items():
            if f not in out:
                by_bin[b] = by_bin.get(b, 0) + m
        rows, used = sum(m[0, 0] for m in by_bin.values()), sum(m[0, 0] > 0 for m in by_bin.values())
        return sum((m * (rows / (used * m[0, 0])) for m in by_bin.values() if m[0, 0] > 0), np.zeros((size, size)))

    plain = {f: sum(m for (k, _), m in g.items() if k == f) for f in folds}
    out = {}
    for f in folds:
        n = sp = sy = spp = spy = 0.0
        for inner in folds:
            if inner == f:
                continue
            w, own = linear.ridge(weighted({f, inner}), p, alpha)[:, 0], plain[inner]
            n, sy = n + own[0, 0], sy + own[0, -1]
            sp, spp, spy = sp + w @ own[:-1, 0], spp + w @ own[:-1, :-1] @ w, spy + w @ own[:-1, -1]
        slope = (n * spy - sp * sy) / (n * spp - sp * sp)
        final = slope * linear.ridge(weighted({f}), p, alpha)
        final[0] += (sy - slope * sp) / n
        out[f] = final
    return linear.Ridge(out, features)


def clocks(df: DataFrame, by: Sequence[str], features: str | Sequence[str], target: str, fold: str = "fold", alpha: float = 50.0, least: int = 500) -> DataFrame:
    """``(by, n, r2)``: an out-of-fold ridge per group (stratum, layer), from groups of at least ``least`` rows; solved on executors."""
    x = linear.design(df, features, [target], keep=[*by, fold])
    names = list(by)

    def solved(table: pa.Table) -> pa.Table:
        g = [linear._square(v) for v in table["gram"].to_pylist()]
        n = int(round(sum(m[0, 0] for m in g)))
        rows = 1 if n >= least and len(g) > 1 else 0
        r2 = [fold_r2(g, range(g[0].shape[0] - 2), alpha)] if rows else []
        return pa.table({**{c: table[c][:rows] for c in names}, "n": pa.array([n][:rows], pa.int64()), "r2": pa.array(r2, pa.float64())})

    kinds = ", ".join(f"{c} {dict(x.dtypes)[c]}" for c in names)
    return linear.gram_table(x, [*names, fold]).groupBy(*names).applyInArrow(solved, f"{kinds}, n long, r2 double")


# -- spectra ----------------------------------------------------------------------------------------


def correlation(g: np.ndarray) -> np.ndarray:
    cov = linear.moments_of(g)[2]
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    return cov / np.outer(sd, sd)


def _coprimes(n: int, replicates: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per replicate and column a multiplier prime to n, and a shift: i -> (a i + b) mod n permutes 0..n-1."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, max(n, 2), (replicates, dims))
    for i in np.ndindex(a.shape):
        while gcd(int(a[i]), n) != 1:
            a[i] = a[i] % n + 1
    return a, rng.integers(0, n, (replicates, dims))


def null_spectra(df: DataFrame, row: str, vector: str, replicates: int = 200, axes: int = 5, seed: int = 0, block: int = 4096) -> DataFrame:
    """``(replicate, axis, value)``: eigenvalues of the correlations after every column was permuted by itself.

    Rows are numbered by hash; a column's cells move to (a i + b) mod n, each column and replicate with
    numbers of its own. Cells travel packed by target block, are put side by side there, and each block
    sends on one Gram matrix.
    """
    x = cut(numbered(df.where(F.col(vector).isNotNull()).select(row, vector), [F.xxhash64(F.col(row), F.lit(seed)), row]))
    n = x.count()
    if n < 3:
        return df.sparkSession.createDataFrame([], "replicate int, axis int, value double")
    dims = x.select(F.size(vector).alias("d")).first().d
    a, b = _coprimes(n, replicates, dims, seed)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, i = matrix(batch[vector]), batch["number"].to_numpy() - 1
            for r in range(replicates):
                to = (i[:, None] * a[r] + b[r]) % n
                flat, order = to.ravel(), np.argsort(to.ravel() // block, kind="stable")
                part = flat[order] // block
                names, cuts = np.unique(part, return_index=True)
                ends = np.append(cuts[1:], len(part))
                dim = np.tile(np.arange(dims, dtype=np.int32), len(i))
                yield pa.RecordBatch.from_pydict({
                    "replicate": pa.array(np.full(len(names), r, np.int32)), "block": pa.array(names.astype(np.int64)),
                    "at": pa.array([(flat[order[s:e]] % block).astype("<i4").tobytes() for s, e in zip(cuts, ends)], pa.binary()),
                    "dim": pa.array([dim[order[s:e]].tobytes() for s, e in zip(cuts, ends)], pa.binary()),
                    "v": pa.array([v.ravel()[order[s:e]].tobytes() for s, e in zip(cuts, ends)], pa.binary()),
                })

    def beside(table: pa.Table) -> pa.Table:
        at, dim, v = (np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in (("at", "<i4"), ("dim", "<i4"), ("v", "<f8")))
        out = np.ones((int(at.max()) + 1, dims + 1))
        out[at, dim + 1] = v
        return pa.table({"replicate": table["replicate"][:1], "gram": pa.array([(out.T @ out).tobytes()], pa.binary())})

    def spectrum(table: pa.Table) -> pa.Table:
        values = np.linalg.eigvalsh(correlation(linear._square(linear._added(table["gram"]).tobytes())))[::-1][:axes]
        return pa.table({"replicate": pa.array([table["replicate"][0].as_py()] * len(values), pa.int32()), "axis": pa.array(range(len(values)), pa.int32()), "value": pa.array(values)})

    cells = x.repartition(max(1, min(n // 256, 512))).mapInArrow(moved, "replicate int, block long, at binary, dim binary, v binary")
    sums = cells.groupBy("replicate", "block").applyInArrow(beside, "replicate int, gram binary")
    return sums.groupBy("replicate").applyInArrow(spectrum, "replicate int, axis int, value double")


def bootstrap_spectra(df: DataFrame, entity: str, vector: str, replicates: int, axes: int = 5) -> DataFrame:
    """``(replicate, axis, value)``: eigenvalues of the correlations under entity bootstraps."""
    x = linear.design(resample.poisson_weights(df, entity, replicates), vector, weight=F.col("weight"), keep=["replicate"])

    def spectrum(table: pa.Table) -> pa.Table:
        values = np.linalg.eigvalsh(correlation(linear._square(table["gram"][0].as_py())))[::-1][:axes]
        return pa.table({"replicate": pa.array([table["replicate"][0].as_py()] * len(values), pa.int32()), "axis": pa.array(range(len(values)), pa.int32()), "value": pa.array(values)})

    return linear.gram_table(x, ["replicate"]).groupBy("replicate").applyInArrow(spectrum, "replicate int, axis int, value double")


def half_angles(df: DataFrame, entity: str, vector: str, replicates: int, axes: int = 2) -> DataFrame:
    """``(replicate, angle)``: the smallest principal angle between the leading axes of two random halves of the entities."""
    half = F.pmod(F.xxhash64(F.col(entity), F.col("replicate")), F.lit(2)).cast("int")
    x = linear.design(resample.replicated(df, replicates).withColumn("half", half), vector, keep=["replicate", "half"])

    def angle(table: pa.Table) -> pa.Table:
        both = [linear.principal(linear.moments_of(linear._square(g))[2], axes)[1] for g in table["gram"].to_pylist()]
        return pa.table({"replicate": table["replicate"][: len(both) - 1], "angle": pa.array([float(linear.principal_angles(*both)[0])] if len(both) == 2 else [], pa.float64())})

    return linear.gram_table(x, ["replicate", "half"]).groupBy("replicate").applyInArrow(angle, "replicate int, angle double")


def pca_by(df: DataFrame, by: str, vector: str, axes: int) -> DataFrame:
    """``(by, axis, variance, retained)``: principal components of each group's complete rows; solved on executors."""
    x = linear.design(df, vector, keep=[by])

    def solved(table: pa.Table) -> pa.Table:
        cov = linear.moments_of(linear._square(table["gram"][0].as_py()))[2]
        values = linear.principal(cov, axes)[0]
        return pa.table({by: pa.array([table[by][0].as_py()] * len(values), table[by].type), "axis": pa.array(range(len(values)), pa.int32()), "variance": pa.array(values), "retained": pa.array(values.cumsum() / np.trace(cov))})

    return linear.gram_table(x, [by]).groupBy(by).applyInArrow(solved, f"{by} {dict(x.dtypes)[by]}, axis int, variance double, retained double")


def scores(df: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray, name: str = "scores") -> DataFrame:
    """Each row's coordinates on the axes (null for a null vector)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch[vector])
            z = (x - mean) @ axes if x.size else np.full((len(x), axes.shape[1]), np.nan)
            ok = batch[vector].is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v if k else None for k, v in zip(ok, z)], pa.list_(pa.float64()))], [*batch.schema.names, name])

    return df.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in df.dtypes), f"{name} array<double>"]))


def generalised_variance(df: DataFrame, by: str, columns: Sequence[str], time: str, least: int = 5) -> DataFrame:
    """``(by, n, trace, det, time)``: spread of the complete rows of each group of at least ``least``, with the median time."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    rows = df.where(ok)
    x = linear.design(rows, list(columns), keep=[by])

    def solved(table: pa.Table) -> pa.Table:
        g = linear._square(table["gram"][0].as_py())
        n = int(round(g[0, 0]))
        keep = 1 if n >= max(least, 2) else 0
        cov = linear.moments_of(g)[2] if keep else np.eye(1)
        return pa.table({by: table[by][:keep], "n": pa.array([n][:keep], pa.int64()), "trace": pa.array([float(np.trace(cov))][:keep], pa.float64()), "det": pa.array([float(np.linalg.det(cov))][:keep], pa.float64())})

    g = linear.gram_table(x, [by]).groupBy(by).applyInArrow(solved, f"{by} {dict(x.dtypes)[by]}, n long, trace double, det double")
    return g.join(windows.quantiles(rows, time, [0.5], [by]).withColumnRenamed("q0", time), by)


def pairwise_covariance(df: DataFrame, columns: Sequence[str], least: int = 3) -> DataFrame:
    """``(a, b, n, cov)``: mean product of standardised columns over the rows that have both; null under ``least`` rows.

    One pass: with missing cells as 0 beside a mask, the Gram matrix of (cells, masks) holds all sums.
    """
    one = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    x = df.select(*columns).crossJoin(F.broadcast(one))
    z = [F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns]
    mask = [F.col(c).isNotNull().cast("double") for c in columns]
    g = linear.total_gram(linear.design(x.select(F.array(*z, *mask).alias("v")), "v"))
    k = len(columns)
    rows = []
    for i in range(k):
        for j in range(i, k):
            n = int(round(g[1 + k + i, 1 + k + j])) if g.shape[0] > 1 else 0
            rows.append((columns[i], columns[j], n, float(g[1 + i, 1 + j] / n) if n >= least else None))
    return df.sparkSession.createDataFrame(rows, "a string, b string, n long, cov double")


def duplicate_columns(pairs: DataFrame, columns: Sequence[str], limit: float = 0.999) -> dict[str, str]:
    """Of the columns, those that repeat an earlier kept one (|r| above ``limit``), and which; from a pair table (a bounded list of names)."""
    strong = {(r.a, r.b): abs(r.cov) for r in pairs.where(F.abs("cov") > limit).collect()}
    out: dict[str, str] = {}
    for i, c in enumerate(columns):
        for k in columns[:i]:
            if k not in out and max(strong.get((k, c), 0), strong.get((c, k), 0)) > limit:
                out[c] = k
                break
    return out


def split_halves(df: DataFrame, entity: str, row: str, value: str, replicates: int, least: Sequence[int] = (2, 4, 6), order: resample.Order | None = None) -> DataFrame:
    """``(least, r, reliability, entities)``: mean correlation of the halves' means over random halves, and Spearman-Brown, by the rows an entity must have."""
    from pyspark.sql.window import Window

    x = resample.replicated(df.where(F.col(value).isNotNull()).select(entity, row, value), replicates)
    w = Window.partitionBy("replicate", entity)
    x = x.withColumn("_i", F.row_number().over(w.orderBy((order or resample.hash_order())("replicate", row), row)) % 2)
    h = x.groupBy("replicate", entity).agg(F.avg(F.when(F.col("_i") == 0, F.col(value))).alias("a"), F.avg(F.when(F.col("_i") == 1, F.col(value))).alias("b"), F.count("*").alias("n"))
    h = h.withColumn("least", F.explode(F.array(*map(F.lit, least)))).where(F.col("n") >= F.col("least"))
    r = h.groupBy("least", "replicate").agg(F.corr("a", "b").alias("r"), F.count("*").alias("entities"))
    return r.groupBy("least").agg(F.avg("r").alias("r"), F.avg(2 * F.col("r") / (1 + F.col("r"))).alias("reliability"), F.max("entities").alias("entities"))


def nested_selection(df: DataFrame, features: str, target: str, row: str, fold: str = "fold", most: int = 3, alpha: float = 1.0, shuffles: int = 20) -> tuple[list[tuple[int, int]], float, list[float]]:
    """Forward selection inside each outer fold's other folds: (feature, outer folds that chose it), outer R2, and the outer R2 of shuffled targets."""
    def outer(g: dict[object, np.ndarray]) -> tuple[list[int], float]:
        total, rss, chosen = sum(g.values()), 0.0, []
        p = total.shape[0] - 2
        for f, own in g.items():
            picked, _ = linear.forward_selection({k: m for k, m in g.items() if k != f}, p, most, alpha)
            rows = [0, *[1 + i for i in picked], p + 1]
            v = np.append(-linear.ridge((total - own)[np.ix_(rows, rows)], len(picked), alpha)[:, 0], 1.0)
            rss += v @ own[np.ix_(rows, rows)] @ v
            chosen += picked
        return chosen, float(1 - rss / (linear.moments_of(total, 0)[2][-1, -1] * total[0, 0]))

    found = linear.grams(linear.design(df, features, [target], keep=[fold]), fold)
    if not found:
        return [], float("nan"), []
    chosen, r2 = outer(found)
    null = []
    if shuffles:
        # complete rows are shuffled; their vectors are read once: all replicates' targets stand beside them in one Gram matrix a fold
        whole = df.where(F.col(target).isNotNull() & F.col(features).isNotNull() & ~F.exists(features, lambda v: v.isNull() | F.isnan(v)))
        moved = resample.with_permutations(whole.select(row, fold, features, F.col(target).cast("double").alias(target)), row, target, shuffles)
        wide = linear.design(moved.withColumn("_all", F.concat(F.transform(features, lambda v: v.cast("double")), "perms")), "_all", keep=[fold])
        g = linear.grams(wide, fold)
        size = next(iter(g.values())).shape[0] - shuffles if g else 0
        null = [outer({f: m[np.ix_(at, at)] for f, m in g.items()})[1] for r in range(shuffles if g else 0) for at in [[*range(size), size + r]]]
    counts = sorted(((i, chosen.count(i)) for i in set(chosen)), key=lambda x: (-x[1], x[0]))
    return counts, r2, null


def posterior_means(rows: DataFrame, vector: str, mean: np.ndarray, load: np.ndarray, psi: np.ndarray, name: str = "factors") -> DataFrame:
    """Each row's expected factors given its observed cells; zeros with none."""
    k = load.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch[vector])
            x = x if x.shape[1] == len(mean) else np.full((len(x), len(mean)), np.nan)
            seen = np.isfinite(x)
            part = (load / psi[:, None])[None, :, :] * seen[:, :, None]
            inner = np.eye(k) + np.einsum("npk,pj->nkj", part, load)
            z = np.linalg.solve(inner, np.einsum("npk,np->nk", part, np.where(seen, x - mean, 0.0))[:, :, None])[:, :, 0] if len(x) else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(z), pa.list_(pa.float64()))], [*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), f"{name} array<double>"]))


def null_distance(real: DataFrame, null: DataFrame, value: str = "s") -> DataFrame:
    """Quantiles of real and null statistics, and the largest distance between their distribution functions."""
    from panelforge.operators.aggregate import ks_distance

    both = real.select(value, F.lit("real").alias("_g")).unionByName(null.select(value, F.lit("null").alias("_g")))
    q = lambda df, n: df.agg(F.percentile(value, F.lit(0.5)).alias(f"{n}_median"), F.percentile(value, F.lit(0.9)).alias(f"{n}_p90"), F.max(value).alias(f"{n}_largest"))
    return q(real, "real").crossJoin(q(null, "null")).crossJoin(ks_distance(both, "_g", "real", "null", value).select("ks"))




def spline_z(df: DataFrame, value: str, time: str, knots: Sequence[float] = (0.25, 0.5, 0.75), least: int = 30, time_limit: float = 0.15, raw_limit: float = 0.8) -> DataFrame:
    """``df`` with ``z``: log value minus its cubic spline in time, minus the median, over 1.4826 MAD.

    Beside it the rank correlations with time and with the raw value, and ``valid``: |with time| below
    ``time_limit`` and |with raw| above ``raw_limit``. Values that aren't positive, and too few rows, give null.
    """
    x = df.withColumn("_log", F.when(F.col(value) > 0, F.ln(F.col(value).cast("double"))))
    q = windows.quantiles(x.where("_log is not null"), time, knots)
    x = x.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(x.agg(F.avg(time).alias("_a"), F.stddev_pop(time).alias("_d"))))
    scaled = lambda c: (F.col(c) - F.col("_a")) / F.nullif(F.col("_d"), F.lit(0.0))
    basis = [f"_b{i}" for i in range(3 + len(knots))]
    powers = [F.pow(scaled(time), F.lit(float(k))) for k in (1, 2, 3)]
    bends = [F.pow(F.greatest(scaled(time) - scaled(f"q{i}"), F.lit(0.0)), F.lit(3.0)) for i in range(len(knots))]
    x = cut(x.withColumns(dict(zip(basis, [*powers, *bends]))).drop("_a", "_d", *[f"q{i}" for i in range(len(knots))]))
    x = linear.residuals(x, ["_log"], basis).drop(*basis)
    x = windows.robust_z(x, "_log_res", "z", least)
    ranks = x.where("z is not null")
    for c, name in (("z", "_rz"), (time, "_rt"), (value, "_rv")):
        ranks = windows.ranked(ranks, c, name)
    guards = ranks.agg(F.corr("_rz", "_rt").alias("with_time"), F.corr("_rz", "_rv").alias("with_raw"))
    return x.drop("_log", "_log_res").crossJoin(F.broadcast(guards)).withColumn("valid", (F.abs("with_time") < time_limit) & (F.abs("with_raw") > raw_limit))


def noise_test(df: DataFrame, entity: str, vector: str, noise: str, covariates: Sequence[str], replicates: int, axes: int = 5) -> dict[str, float]:
    """First canonical correlation of the vector's main axes with the noise, raw and with the covariates added one by one.

    Each rung has a p: the noise permuted among entities. ``angle``: between the directions of noise and
    of the first covariate (degrees; near 0 means that the one stands for the other).
    """
    _, mean, cov = linear.moments_of(linear.total_gram(linear.design(df, vector)))
    k = min(axes, len(mean))
    x = scores(df.select(entity, noise, *covariates, vector), vector, mean, linear.principal(cov, k)[1], "_s")
    row = lambda target: F.concat("_s", F.array(F.col(target).cast("double"), *[F.col(c).cast("double") for c in covariates]))
    rungs = {"raw": []} | {"+".join(covariates[: i + 1]): list(range(k + 1, k + 2 + i)) for i in range(len(covariates))}

    def ladder(g: np.ndarray) -> dict[str, float]:
        return linear.ladder(linear.moments_of(g)[2], range(k), [k], rungs)

    total = linear.total_gram(linear.design(x.withColumn("_v", row(noise)), "_v"))
    real = ladder(total)
    whole = x.withColumn("_v", row(noise)).where(~F.exists("_v", lambda v: v.isNull() | F.isnan(v))).withColumn(noise, F.col(noise).cast("double"))
    moved = resample.with_permutations(whole, entity, noise, replicates).withColumn("_v", F.concat("_v", "perms"))
    g = linear.total_gram(linear.design(moved, "_v"))
    base = k + 2 + len(covariates)  # of the matrix: the constant, the axes, the noise, the covariates
    null = [ladder(g[np.ix_(at, at)]) for r in range(replicates) for at in [[*range(k + 1), base + r, *range(k + 2, base)]]]
    out = dict(real)
    for name in rungs:
        out[f"p_{name}"] = (1 + sum(n[name] >= real[name] - 1e-9 for n in null)) / (1.0 + len(null))
    c = linear.moments_of(total)[2]
    a, b = (np.linalg.pinv(c[:k, :k]) @ c[:k, i] for i in (k, k + 1))
    out["angle"] = float(np.degrees(np.arccos(np.clip(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), -1, 1))))
    return out
