"""Linear models from one pass of per-group Gram matrices.

``grams`` sums the cross products of (1, features, targets) per key on the executors; only d x d
matrices come to the driver, where the small systems are solved. Predictions go back as weights that
are broadcast (their size is d by the number of folds) and applied in a second scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.vectors import matrix
from panelforge.operators.windows import numbered


def design(df: DataFrame, features: str | Sequence[str], targets: Sequence[str] = (), weight: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``_x array<double>`` of features then targets; rows with a missing one are left out."""
    x = F.transform(features, lambda v: v.cast("double")) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    row = F.concat(x, F.array(*[F.col(t).cast("double") for t in targets])) if targets else x
    out = df.select(*keep, row.alias("_x"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"))
    return out.where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)) & F.col("_w").isNotNull())


#: Bytes of Gram matrices that a Python worker holds before they go out.
HELD = 64 << 20


def gram_table(x: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, gram binary)``: the Gram matrix of (1, x), weighted, per key. Summed per task, sent on when ``HELD`` bytes are held (within a batch, too), merged by key.

    The shuffle is at most a matrix for each key that a task meets, and one more for each time it had to send on. For keys so many
    that their matrices don't fit, sort by key first (``screens.sorted_grams``).
    """
    kinds = ", ".join(f"{c} {dict(x.dtypes)[c]}" for c in by)
    schema = f"{kinds}, gram binary"
    names = list(by)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*total), types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([g.ravel().tobytes() for g in total.values()], pa.binary())], [*names, "gram"])

        for batch in batches:
            a = matrix(batch["_x"])
            if not len(a):
                continue
            types = [batch[c].type for c in names]
            a = np.column_stack([np.ones(len(a)), a])
            w = batch["_w"].to_numpy(zero_copy_only=False)
            index = pd.DataFrame({c: batch[c].to_pandas() for c in names}).groupby(names, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(index, kind="stable")
            starts = np.flatnonzero(np.diff(index[order], prepend=-1))
            firsts = zip(*(batch[c].take(pa.array(order[starts])).to_pylist() for c in names))
            for k, s, e in zip(firsts, starts, np.append(starts[1:], len(order))):
                own = a[order[s:e]]
                gram = (own * w[order[s:e], None]).T @ own
                if k in total:
                    total[k] += gram
                    continue
                total[k] = gram
                held += gram.nbytes
                if held > HELD:
                    yield out()
                    total, held = {}, 0
        if total:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({**{c: table[c][:1] for c in names}, "gram": pa.array([_added(table["gram"]).tobytes()], pa.binary())})

    return x.select(*names, "_x", "_w").mapInArrow(part, schema).groupBy(*names).applyInArrow(merge, schema)


def _added(column: pa.ChunkedArray) -> np.ndarray:
    total: np.ndarray | None = None
    for g in column:
        one = np.frombuffer(g.as_buffer())
        total = one.copy() if total is None else np.add(total, one, out=total)
    return total


def _square(g: bytes) -> np.ndarray:
    flat = np.frombuffer(g)
    return flat.reshape(int(len(flat) ** 0.5), -1)


def grams(x: DataFrame, by: str) -> dict[object, np.ndarray]:
    """The Gram matrices of few keys (folds, strata) on the driver."""
    return {r[by]: _square(r["gram"]) for r in gram_table(x, [by]).toLocalIterator()}


def total_gram(x: DataFrame) -> np.ndarray:
    return grams(x.withColumn("_one", F.lit(0)), "_one").get(0, np.zeros((1, 1)))


def moments_of(g: np.ndarray, ddof: int = 1) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, means and covariance of a Gram matrix of (1, x)."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    return n, mean, (g[1:, 1:] - n * np.outer(mean, mean)) / (n - ddof)


def covariance(df: DataFrame, features: str | Sequence[str]) -> tuple[list, np.ndarray]:
    g = total_gram(design(df, features))
    names = list(range(g.shape[0] - 1)) if isinstance(features, str) else list(features)
    return names, moments_of(g)[2]


def ridge(g: np.ndarray, p: int, alpha: float, standardize: bool = True) -> np.ndarray:
    """Intercept and weights (p features, the rest targets) of a ridge on standardised features; the intercept isn't penalised."""
    n, mean, cov = moments_of(g, 0)
    sd = np.sqrt(np.maximum(np.diag(cov)[:p], 0)) if standardize else np.ones(p)
    sd = np.where(sd > 0, sd, 1.0)
    w = np.linalg.solve(cov[:p, :p] / np.outer(sd, sd) * n + alpha * np.eye(p), cov[:p, p:] / sd[:, None] * n) / sd[:, None]
    return np.vstack([mean[p:] - mean[:p] @ w, w])


def dealt_folds(df: DataFrame, entity: str, k: int) -> DataFrame:
    """``(entity, fold)``: entities by size, largest first, dealt out to and fro; numbered by ranges."""
    n = df.groupBy(entity).agg(F.count("*").alias("_n"))
    n = numbered(n, [-F.col("_n"), entity])
    turn = (F.col("number") - 1) % (2 * k)
    return n.select(entity, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))


def hashed_fold(entity: str, k: int, seed: int = 0) -> Column:
    """Fold of an entity by hash: no order, no shuffle; even in expectation."""
    return F.pmod(F.xxhash64(F.col(entity), F.lit(seed)), F.lit(k)).cast("int")


@dataclass
class Ridge:
    """Weights per held-out fold, and where they apply."""

    weights: dict[int, np.ndarray]
    features: str | Sequence[str]

    def predict(self, df: DataFrame, fold: str = "fold", name: str = "pred") -> DataFrame:
        """Each row predicted by the weights that didn't see its fold."""
        folds = sorted(self.weights)
        if not folds:  # nothing to learn from: no prediction
            return design(df, self.features, keep=df.columns).select(*df.columns, F.lit(None).cast("double").alias(name))
        table, at = np.stack([self.weights[f][:, 0] for f in folds]), {f: i for i, f in enumerate(folds)}
        x = design(df, self.features, keep=df.columns)
        kinds, columns = ", ".join(f"{c} {t}" for c, t in df.dtypes), df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a = matrix(batch["_x"])
                w = table[[at[f] for f in batch[fold].to_pylist()]]
                p = w[:, 0] + (a * w[:, 1:]).sum(1) if len(a) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(p)], [*columns, name])

        return x.mapInArrow(run, f"{kinds}, {name} double")


def cross_validated(df: DataFrame, features: str | Sequence[str], target: str, fold: str = "fold", alpha: float = 50.0, weight: Column | None = None, standardize: str = "train") -> Ridge:
    """Ridge with every fold held out in turn, from one Gram matrix per fold (train = total - fold). No complete row gives no weights, and null predictions."""
    g = grams(design(df, features, [target], weight, [fold]), fold)
    if not g:
        return Ridge({}, features)
    total = sum(g.values())
    p = total.shape[0] - 2
    out = {}
    for f, own in g.items():
        train = total - own
        if standardize == "global":
            sd = np.sqrt(np.maximum(np.diag(moments_of(total, 0)[2])[:p], 1e-300))
            s = np.concatenate([[1.0], 1 / sd, [1.0]])
            w = ridge(train * np.outer(s, s), p, alpha, False)
            w[1:] /= sd[:, None]
            out[f] = w
        else:
            out[f] = ridge(train, p, alpha)
    return Ridge(out, features)


def held_out_r2(df: DataFrame, features: str | Sequence[str], target: str, fold: str = "fold", alpha: float = 50.0) -> float:
    """Out-of-fold R2 from the Gram matrices alone; nan without a complete row."""
    g = grams(design(df, features, [target], keep=[fold]), fold)
    if not g:
        return float("nan")
    total = sum(g.values())
    p, rss = total.shape[0] - 2, 0.0
    for own in g.values():
        w = ridge(total - own, p, alpha)[:, 0]
        v = np.append(-w, 1.0)
        rss += v @ own @ v
    _, _, cov = moments_of(total, 0)
    return 1 - rss / (cov[-1, -1] * total[0, 0])


def alpha_path(df: DataFrame, features: str | Sequence[str], target: str, alphas: Sequence[float], fold: str = "fold") -> dict[float, float]:
    """Out-of-fold R2 for each penalty, from the same Gram matrices (nan without a complete row)."""
    g = grams(design(df, features, [target], keep=[fold]), fold)
    out = {}
    for alpha in alphas:
        if not g:
            out[alpha] = float("nan")
            continue
        total = sum(g.values())
        rss = 0.0
        for own in g.values():
            v = np.append(-ridge(total - own, total.shape[0] - 2, alpha)[:, 0], 1.0)
            rss += v @ own @ v
        out[alpha] = float(1 - rss / (moments_of(total, 0)[2][-1, -1] * total[0, 0]))
    return out


def in_sample(df: DataFrame, features: str | Sequence[str], target: str, fold: str = "fold", alpha: float = 50.0) -> Ridge:
    """The ridge of all rows, for each fold that there is: its predictions are those of rows it has seen."""
    g = grams(design(df, features, [target], keep=[fold]), fold)
    if not g:
        return Ridge({}, features)
    total = sum(g.values())
    w = ridge(total, total.shape[0] - 2, alpha)
    return Ridge({f: w for f in g}, features)


def with_levels(df: DataFrame, columns: Sequence[str], most: int = 1000) -> tuple[DataFrame, list[str]]:
    """A 0/1 column for each level of categorical columns but the smallest one (null is a level); more than ``most`` levels raise."""
    out, names = df, []
    for c in columns:
        levels = [r[0] for r in df.select(c).distinct().limit(most + 1).collect()]
        if len(levels) > most:
            raise ValueError(f"more than {most} levels of {c}")
        for i, v in enumerate(sorted(levels, key=lambda x: (x is None, x if x is not None else 0))[1:]):
            names.append(f"_{c}_{i}")
            out = out.withColumn(names[-1], F.col(c).eqNullSafe(F.lit(v)).cast("double"))
    return out, names


def residuals(df: DataFrame, columns: Sequence[str], covariates: Sequence[str], fold: str | None = None, suffix: str = "_res", levels: Sequence[str] = ()) -> DataFrame:
    """Columns minus their least-squares fit on covariates, the levels of categorical ones and an intercept; with ``fold``, fitted on the other folds."""
    if levels:
        wide, names = with_levels(df, levels)
        return residuals(wide, columns, [*covariates, *names], fold, suffix).drop(*names)
    bad = set(columns) & set(covariates)
    if bad:
        raise ValueError(f"a covariate can't be a target: {sorted(bad)}")
    x = design(df.withColumn("_f", F.lit(0) if fold is None else F.col(fold)), list(covariates), list(columns), keep=["_f"])
    g = grams(x, "_f")
    total, p = sum(g.values()), len(covariates)
    rows = []
    for f, own in g.items():
        w = ridge(total if fold is None else total - own, p, 1e-10, False)
        rows.append((int(f), [float(v) for v in w.T.ravel()]))
    fits = df.sparkSession.createDataFrame(rows, "_f int, _w array<double>")
    out = df.withColumn("_f", F.lit(0) if fold is None else F.col(fold).cast("int")).join(F.broadcast(fits), "_f", "left")
    for i, c in enumerate(columns):
        at = i * (p + 1)
        fit = F.col("_w")[at] + sum((F.col("_w")[at + 1 + j] * F.col(z) for j, z in enumerate(covariates)), F.lit(0.0))
        out = out.withColumn(f"{c}{suffix}", F.col(c) - fit)
    return out.drop("_f", "_w")


def partial_correlation(a: str, b: str, z: str) -> Column:
    """Correlation of a and b given one covariate, from three correlations (an aggregate)."""
    ab, az, bz = F.corr(a, b), F.corr(a, z), F.corr(b, z)
    return (ab - az * bz) / F.sqrt((1 - az * az) * (1 - bz * bz))


def principal(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and axes; the largest loading of each axis is positive."""
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return values, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def canonical(cov: np.ndarray, p: int, k: int = 1, ridge_: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical correlations and weights of the first p columns against the others."""
    def root(m: np.ndarray) -> np.ndarray:
        v, u = np.linalg.eigh(m + ridge_ * np.trace(m) / len(m) * np.eye(len(m)))
        return u @ np.diag(1 / np.sqrt(np.maximum(v, 1e-12))) @ u.T

    rx, ry = root(cov[:p, :p]), root(cov[p:, p:])
    u, s, vt = np.linalg.svd(rx @ cov[:p, p:] @ ry)
    return s[:k], rx @ u[:, :k], ry @ vt.T[:, :k]


def held_out_canonical(g: dict[object, np.ndarray], p: int, keep: int = 5) -> float:
    """First canonical correlation on held-out folds: axes from the others' covariance after in-fold PCA of both sides."""
    total, out = sum(g.values()), []
    for own in g.values():
        cov = moments_of(total - own)[2]
        ax = principal(cov[:p, :p], min(keep, p))[1]
        ay = principal(cov[p:, p:], min(keep, cov.shape[0] - p))[1]
        lift = np.zeros((cov.shape[0], ax.shape[1] + ay.shape[1]))
        lift[:p, : ax.shape[1]], lift[p:, ax.shape[1] :] = ax, ay
        _, wx, wy = canonical(lift.T @ cov @ lift, ax.shape[1])
        test = lift.T @ moments_of(own)[2] @ lift
        a, b = np.append(wx[:, 0], np.zeros(ay.shape[1])), np.append(np.zeros(ax.shape[1]), wy[:, 0])
        out.append(a @ test @ b / np.sqrt((a @ test @ a) * (b @ test @ b)))
    return float(np.mean(out))


def conditional(cov: np.ndarray, keep: Sequence[int], given: Sequence[int]) -> np.ndarray:
    """Covariance of ``keep`` with ``given`` held fixed (Schur complement)."""
    if not len(given):
        return cov[np.ix_(keep, keep)]
    zz = np.linalg.pinv(cov[np.ix_(given, given)])
    return cov[np.ix_(keep, keep)] - cov[np.ix_(keep, given)] @ zz @ cov[np.ix_(given, keep)]


def ladder(cov: np.ndarray, left: Sequence[int], right: Sequence[int], rungs: dict[str, Sequence[int]]) -> dict[str, float]:
    """First canonical correlation of two blocks after adjusting for each rung's covariates."""
    out = {}
    for name, given in rungs.items():
        c = conditional(cov, [*left, *right], list(given))
        out[name] = float(canonical(c, len(left))[0][0])
    return out


def o_information(cov: np.ndarray) -> tuple[float, float, float, float]:
    """Total correlation, dual total correlation, their difference, and the correlation matrix's smallest eigenvalue."""
    sd = np.sqrt(np.diag(cov))
    r = cov / np.outer(sd, sd)
    logdet = lambda m: np.linalg.slogdet(m)[1] if len(m) else 0.0
    whole, n = logdet(r), len(r)
    tc = -0.5 * whole
    without = [logdet(np.delete(np.delete(r, i, 0), i, 1)) for i in range(n)]
    dtc = 0.5 * (sum(without) - (n - 1) * whole)
    return tc, dtc, tc - dtc, float(np.linalg.eigvalsh(r)[0])


def participation(values: np.ndarray) -> float:
    return float(values.sum() ** 2 / (values**2).sum())


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.degrees(np.arccos(np.clip(np.linalg.svd(qa.T @ qb)[1], -1, 1)))


def varimax(loadings: np.ndarray, rounds: int = 50) -> np.ndarray:
    rotation = np.eye(loadings.shape[1])
    for _ in range(rounds):
        x = loadings @ rotation
        u, _, vt = np.linalg.svd(loadings.T @ (x**3 - x * (x**2).mean(0)))
        rotation = u @ vt
    return loadings @ rotation


def forward_selection(g: dict[object, np.ndarray], p: int, most: int = 3, alpha: float = 1.0) -> tuple[list[int], float]:
    """Greedy features by out-of-fold error; every candidate system is a block of the same Gram matrices."""
    total = sum(g.values())

    def rss(at: list[int]) -> float:
        rows = [0, *[1 + i for i in at], p + 1]
        out = 0.0
        for own in g.values():
            t = (total - own)[np.ix_(rows, rows)]
            v = np.append(-ridge(t, len(at), alpha)[:, 0], 1.0)
            out += v @ own[np.ix_(rows, rows)] @ v
        return out

    chosen: list[int] = []
    best = float("inf")
    while len(chosen) < most:
        score, i = min((rss([*chosen, i]), i) for i in range(p) if i not in chosen)
        if score >= best:
            break
        best, chosen = score, [*chosen, i]
    return chosen, best


def flow(g: np.ndarray, p: int, ridge_: float = 1.0) -> tuple[float, float, list[float], list[float]]:
    """Velocity regressed on position (ridge on the intercept too): trace, largest real eigenvalue, fixed point and expanding axis."""
    w = np.linalg.solve(g[: p + 1, : p + 1] + ridge_ * np.eye(p + 1), g[: p + 1, p + 1 :])
    j = w[1:].T
    values, axes = np.linalg.eig(j)
    axis = axes[:, values.real.argmax()].real
    axis = axis / np.linalg.norm(axis) * np.sign(axis[np.abs(axis).argmax()])
    return float(np.trace(j)), float(values.real.max()), [float(v) for v in -np.linalg.pinv(j) @ w[0]], [float(v) for v in axis]


def pattern_sums(rows: DataFrame, vector: str, most: int = 10_000) -> dict[str, np.ndarray] | None:
    """By pattern of observed cells (1) and missing ones (0): the Gram matrix of (1, observed cells). None if there are more than ``most`` patterns."""
    x = rows.select(F.transform(vector, lambda v: v.cast("double")).alias("x"))
    x = x.withColumn("pattern", F.array_join(F.transform("x", lambda v: F.when(v.isNull() | F.isnan(v), "0").otherwise("1")), ""))
    x = x.select("pattern", F.filter("x", lambda v: v.isNotNull() & ~F.isnan(v)).alias("x")).where(F.size("x") > 0)
    return None if x.select("pattern").distinct().limit(most + 1).count() > most else _pattern_grams(x)


def _pattern_grams(x: DataFrame) -> dict[str, np.ndarray]:
    """Gram matrices of rows whose length depends on the pattern."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[list[float]]] = {}
            for k, v in zip(batch["pattern"].to_pylist(), batch["x"].to_pylist()):
                by.setdefault(k, []).append(v)
            for k, v in by.items():
                a = np.column_stack([np.ones(len(v)), np.array(v)])
                total[k] = total.get(k, 0) + a.T @ a
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([g.tobytes() for g in total.values()], pa.binary())], ["pattern", "g"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"pattern": table["pattern"][:1], "g": pa.array([sum(np.frombuffer(g) for g in table["g"].to_pylist()).tobytes()], pa.binary())})

    schema = "pattern string, g binary"
    out = {}
    for r in x.select("pattern", "x").mapInArrow(part, schema).groupBy("pattern").applyInArrow(merge, schema).toLocalIterator():
        g = np.frombuffer(r["g"])
        out[r["pattern"]] = g.reshape(int(len(g) ** 0.5), -1)
    return out


FitPredict = Callable[[DataFrame], DataFrame]
