"""Factor models whose rows stay on the executors: each round is one pass with broadcast parameters, whose sums are added in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import linear
from panelforge.operators.bijection import with_partner
from panelforge.operators.lineage import cut
from panelforge.operators.vectors import FAN, _added, matrix
from panelforge.operators.windows import numbered


def summed(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of`` over all batches: a vector of doubles, added per task, then by ``FAN`` tasks, then in all. None without a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        context = TaskContext.get()
        for batch in batches:
            if len(batch):
                one = np.asarray(of(batch), np.float64)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"fan": pa.array([context.partitionId() // FAN if context else 0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        return pa.table({"fan": pa.array([0], pa.int32()), "sums": pa.array([_added(table["sums"]).tobytes()], pa.binary())})

    schema = "fan int, sums binary"
    parts = df.mapInArrow(run, schema)
    if df.rdd.getNumPartitions() <= FAN:  # so few vectors that the driver adds them
        rows = parts.collect()
        return sum((np.frombuffer(r.sums) for r in rows[1:]), np.frombuffer(rows[0].sums).copy()) if rows else None
    met = parts.groupBy("fan").applyInArrow(added, schema)
    row = met.groupBy("fan").applyInArrow(added, schema).first()
    return None if row is None else np.frombuffer(row.sums).copy()


# -- factor analysis with missing cells ------------------------------------------------------------------


def row_sums(x: np.ndarray, mean: np.ndarray, load: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """E-step of rows (nan: missing): per feature the sums of (x - mean) E[z] and E[z z'] over the rows that have it, and the log-likelihood (without its constant)."""
    p, k = load.shape
    seen = np.isfinite(x)
    c = np.where(seen, x - mean, 0.0)
    scaled = load / psi[:, None]
    inner = np.eye(k) + np.einsum("np,pk,pj->nkj", seen.astype(float), scaled, load, optimize=True)
    b = c @ scaled
    cov = np.linalg.inv(inner)
    z = np.einsum("nkj,nj->nk", cov, b)
    second = cov + z[:, :, None] * z[:, None, :]
    top = c.T @ z
    low = np.einsum("np,nkj->pkj", seen.astype(float), second, optimize=True)
    like = -0.5 * ((seen * np.log(psi)).sum() + np.linalg.slogdet(inner)[1].sum() + (c * c / psi).sum() - (b * z).sum())
    return np.concatenate([top.ravel(), low.ravel(), [like]])


def maximised(load: np.ndarray, psi: np.ndarray, top: np.ndarray, low: np.ndarray, square: np.ndarray, n: np.ndarray, ard: bool) -> tuple[np.ndarray, np.ndarray]:
    """M-step: loadings and noise of each feature (those without a cell keep their loadings). ``ard`` weighs each factor by a precision of its own."""
    p, k = load.shape
    strict = np.diag(p / np.maximum((load**2).sum(0), 1e-9)) if ard else 1e-9 * np.eye(k)
    load = np.stack([np.linalg.solve(low[i] + (psi[i] * strict if ard else strict), top[i]) if n[i] else load[i] for i in range(p)])
    return load, np.maximum((square - (load * top).sum(1)) / np.maximum(n, 1), 1e-6)


def fitted(e_step: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], n: np.ndarray, s: np.ndarray, q: np.ndarray, k: int, rounds: int, tolerance: float, ard: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM from the features' counts, sums and squares; ``e_step`` gives the sums of the rows for given parameters."""
    p = len(n)
    if not p:
        return np.zeros(0), np.zeros((0, k)), np.zeros(0)
    mean = s / np.maximum(n, 1)
    square = q - 2 * mean * s + n * mean**2
    psi = np.maximum(q / np.maximum(n, 1) - mean**2, 1e-6)
    load = np.random.default_rng(0).standard_normal((p, k)) * np.sqrt(psi)[:, None] * 0.3
    last = -np.inf
    for _ in range(rounds):
        top, low, like = e_step(mean, load, psi)
        load, psi = maximised(load, psi, top, low, square, n, ard)
        if abs(like - last) < tolerance * abs(last):
            break
        last = like
    return mean, load, psi


def by_rows(rows: DataFrame, vector: str, k: int, rounds: int = 100, tolerance: float = 1e-5, ard: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, loadings and noise of a factor model, the rows read once a round: there may be as many patterns of missing cells as rows."""
    x = rows.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda v: v.cast("double")).alias("x"))
    x = cut(x.where(F.exists("x", lambda v: v.isNotNull() & ~F.isnan(v))))

    def counted(batch: pa.RecordBatch) -> np.ndarray:
        v = matrix(batch["x"])
        seen = np.isfinite(v)
        v = np.where(seen, v, 0.0)
        return np.concatenate([seen.sum(0), v.sum(0), (v * v).sum(0)])

    sums = summed(x, counted)
    if sums is None:
        return np.zeros(0), np.zeros((0, k)), np.zeros(0)
    n, s, q = sums.reshape(3, -1)
    p = len(n)

    def e_step(mean: np.ndarray, load: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        total = summed(x, lambda batch: sum(row_sums(v, mean, load, psi) for v in _slices(matrix(batch["x"]), p * k * k)))
        return total[: p * k].reshape(p, k), total[p * k : -1].reshape(p, k, k), float(total[-1])

    return fitted(e_step, n, s, q, k, rounds, tolerance, ard)


def _slices(x: np.ndarray, width: int) -> Iterator[np.ndarray]:
    step = max(1, (1 << 22) // max(width, 1))
    for a in range(0, len(x), step):
        yield x[a : a + step]


# -- non-negative factors -----------------------------------------------------------------------------------


def nonnegative(gram: np.ndarray, cross: np.ndarray, start: np.ndarray | None = None, rounds: int = 500, tolerance: float = 1e-12) -> np.ndarray:
    """Rows w >= 0 with the least w gram w' - 2 w cross', by coordinate descent until nothing moves."""
    w = np.zeros_like(cross) if start is None else start.copy()
    diagonal = np.maximum(np.diag(gram), 1e-300)
    for _ in range(rounds):
        moved = 0.0
        for r in range(gram.shape[0]):
            new = np.maximum(0.0, w[:, r] + (cross[:, r] - w @ gram[:, r]) / diagonal[r])
            moved = max(moved, float(np.abs(new - w[:, r]).max(initial=0.0)))
            w[:, r] = new
        if moved <= tolerance * max(1.0, float(np.abs(w).max(initial=0.0))):
            break
    return w


def first_topics(gram: np.ndarray, k: int) -> np.ndarray:
    """Topics to start from: the larger-signed part of each leading axis of the cross products, lifted off zero by a little that differs from cell to cell."""
    values, axes = np.linalg.eigh(gram)
    out = []
    for r in range(k):
        v = axes[:, -1 - r % len(values)]
        part = np.maximum(v, 0) if np.linalg.norm(np.maximum(v, 0)) >= np.linalg.norm(np.minimum(v, 0)) else np.maximum(-v, 0)
        out.append(part * np.sqrt(max(values[-1 - r % len(values)], 0.0)) + 1e-3)
    h = np.stack(out)
    return h * (1 + 0.01 * np.random.default_rng(0).random(h.shape))


def topics(rows: DataFrame, vector: str, k: int, rounds: int = 200, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """``k`` non-negative topics (rows that sum to 1) of non-negative vectors, zeros included, and the share of their squares that they explain.

    Alternating non-negative least squares: each row solves its weights on its executor from the broadcast topics, and sends on
    its part of the topics' matrices. Null vectors are left out; no rows give no topics (and nan).
    """
    x = cut(rows.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda v: v.cast("double")).alias("x")))
    gram = summed(x, lambda batch: (lambda v: (v.T @ v).ravel())(matrix(batch["x"])))
    if gram is None:
        return np.zeros((0, 0)), float("nan")
    p = int(round(len(gram) ** 0.5))
    gram = gram.reshape(p, p)
    h, last, whole = first_topics(gram, k), np.inf, float(np.trace(gram))
    for _ in range(rounds):
        def solved(batch: pa.RecordBatch, h: np.ndarray = h) -> np.ndarray:
            v = matrix(batch["x"])
            w = nonnegative(h @ h.T, v @ h.T)
            return np.concatenate([(w.T @ w).ravel(), (w.T @ v).ravel()])

        both = summed(x, solved)
        a, c = both[: k * k].reshape(k, k), both[k * k :].reshape(k, p)
        h = nonnegative(a, c.T, h.T).T
        rest = whole - 2 * float((c * h).sum()) + float((a * (h @ h.T)).sum())
        if last - rest < tolerance * whole:
            break
        last = rest
    return h / np.maximum(h.sum(1, keepdims=True), 1e-300), 1 - rest / whole if whole else float("nan")


def with_topics(df: DataFrame, vector: str, h: np.ndarray, name: str = "topics") -> DataFrame:
    """Each row's non-negative weights on the topics (null for a null vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch[vector])
            w = nonnegative(h @ h.T, np.nan_to_num(v) @ h.T) if v.size else np.zeros((len(v), len(h)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r if ok else None for r, ok in zip(w, batch[vector].is_valid().to_pylist())], pa.list_(pa.float64()))], [*batch.schema.names, name])

    return df.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in df.dtypes), f"{name} array<double>"]))


def code_vectors(shares: DataFrame, entity: str, code: str, value: str, codes: Sequence[int]) -> DataFrame:
    """``(entity, v)``: a vector over all of a codebook's codes, 0 where an entity has no row."""
    at = {c: F.coalesce(F.max(F.when(F.col(code) == c, F.col(value))), F.lit(0.0)) for c in codes}
    return shares.groupBy(entity).agg(F.array(*at.values()).alias("v"))


def shuffled_columns(df: DataFrame, row: str, vector: str, seed: int = 0) -> DataFrame:
    """``(number, vector)``: every column of the vectors permuted among the rows by a bijection of its own; each cell moves once."""
    x = cut(numbered(df.where(F.col(vector).isNotNull()).select(row, vector), [row], name="_i"))
    cells = x.withColumn("_n", F.lit(x.count())).select("_i", "_n", F.posexplode(vector).alias("_k", "_v"))
    moved = with_partner(cells, "_i", "_n", "_k", "number", seed)
    return moved.groupBy("number").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias(vector))


def rank_sweep(df: DataFrame, row: str, vector: str, ranks: Sequence[int], seed: int = 0, rounds: int = 50, tolerance: float = 1e-6) -> list[tuple[int, float, float]]:
    """``(rank, explained, explained of shuffled columns)`` for each number of topics: what structure between codes adds."""
    null = cut(shuffled_columns(df, row, vector, seed))
    return [(k, *(topics(x, vector, k, rounds, tolerance)[1] for x in (df, null))) for k in ranks]


def factor_analysis(rows: DataFrame, vector: str, k: int, rounds: int = 100, tolerance: float = 1e-5, ard: bool = False, most_patterns: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, loadings and noise by EM over observed cells only (missing cells are nulls).

    Up to ``most_patterns`` patterns of missing cells, rows enter as one set of sums per pattern, made once; with more, each
    round reads the rows (``by_rows``). Both give the same model. ``ard`` weighs each factor's loadings by a precision of its own, so
    factors that aren't needed go to zero. No observed cell gives empty arrays.
    """
    found = linear.pattern_sums(rows, vector, most_patterns)
    if found is None:
        return by_rows(rows, vector, k, rounds, tolerance, ard)
    parts = [(np.flatnonzero([c == "1" for c in pattern]), g[0, 0], g[0, 1:], g[1:, 1:]) for pattern, g in found.items()]
    p = max((int(at.max()) for at, *_ in parts), default=-1) + 1
    n, s, q = np.zeros(p), np.zeros(p), np.zeros(p)
    for at, m, a, b in parts:
        n[at] += m
        s[at] += a
        q[at] += np.diag(b)

    def e_step(mean: np.ndarray, load: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        top, low, like = np.zeros((p, k)), np.zeros((p, k, k)), 0.0
        for at, m, a, b in parts:
            w, v = load[at], psi[at]
            centred = b - np.outer(mean[at], a) - np.outer(a, mean[at]) + m * np.outer(mean[at], mean[at])
            precision = np.eye(k) + (w / v[:, None]).T @ w
            inner = np.linalg.inv(precision)
            beta = inner @ (w / v[:, None]).T
            top[at] += centred @ beta.T
            low[at] += m * inner + beta @ centred @ beta.T
            like -= 0.5 * (m * (np.log(v).sum() + np.linalg.slogdet(precision)[1]) + (np.diag(centred) / v).sum() - np.trace((w / v[:, None]).T @ centred @ (w / v[:, None]) @ inner))
        return top, low, like

    return fitted(e_step, n, s, q, k, rounds, tolerance, ard)
