"""Vector and token tables: pooling, medians, fusion, texture, code assignment.

Sums of vectors are taken per task and key, then merged in two steps, so a key with very many rows sends a
few partial sums, not its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.lineage import cut
from panelforge.operators.windows import quantiles


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as a float64 matrix. A null vector is a row of nan, a null number nan; other lengths raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not column.null_count and n and len(flat) % n == 0:
        sizes = np.diff(column.offsets.to_numpy()) if hasattr(column, "offsets") else np.full(n, len(flat) // n)
        if (sizes == sizes[0]).all():
            return flat.reshape(n, -1)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.array([len(v) for v in column if v.is_valid], np.int64)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    out = np.full((n, int(sizes[0]) if len(sizes) else 0), np.nan)
    out[valid] = flat.reshape(len(sizes), -1) if len(sizes) else 0
    return out


#: Bytes of running sums that a task holds before they go out, and tasks whose sums meet in the first of two merges.
HELD, FAN = 64 << 20, 64


def _partial_sums(keys: list[str], vector: str, weight: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(keys, fan, sums)``: a task's running sums by key (rows, weights, vectors, weighted vectors) as packed doubles."""
    total: dict[tuple, np.ndarray] = {}
    types: list[pa.DataType] = []
    context = TaskContext.get()
    fan = context.partitionId() // FAN if context else 0

    def out() -> pa.RecordBatch:
        columns = [pa.array(list(c), t) for c, t in zip(zip(*total), types)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(total), fan, np.int32)), pa.array([v.tobytes() for v in total.values()], pa.binary())], [*keys, "_fan", "_sums"])

    held = 0
    for batch in batches:
        batch = batch.filter(batch[vector].is_valid())
        if not batch.num_rows:
            continue
        x = matrix(batch[vector])
        types = [batch[k].type for k in keys]
        w = np.ones(len(x)) if weight is None else np.nan_to_num(batch[weight].to_numpy(zero_copy_only=False).astype(float))
        index = pd.DataFrame({k: batch[k].to_pandas() for k in keys}).groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(index, kind="stable")
        start = np.flatnonzero(np.diff(index[order], prepend=-1))
        rows = np.diff(np.append(start, len(order)))
        sums = np.column_stack([rows, np.add.reduceat(w[order], start), np.add.reduceat(x[order], start), np.add.reduceat((x * w[:, None])[order], start)])
        for key, own in zip(zip(*(batch[k].take(pa.array(order[start])).to_pylist() for k in keys)), sums):
            if key in total:
                if len(total[key]) != len(own):
                    raise ValueError("vectors of different lengths")
                total[key] += own
                continue
            total[key] = own.copy()
            held += own.nbytes
            if held > HELD:
                yield out()
                total, held = {}, 0
    if total:
        yield out()


def sum_arrays(column: str, length: int) -> Column:
    """Element-wise sum of an array column as an array (built-in sums, combined map-side)."""
    return F.array(*[F.sum(F.col(column)[i]) for i in range(length)])


def _added(column: pa.ChunkedArray) -> np.ndarray:
    """The sum of packed doubles, one after another."""
    total: np.ndarray | None = None
    for v in column:
        one = np.frombuffer(v.as_buffer())
        if total is not None and len(one) != len(total):
            raise ValueError("vectors of different lengths")
        total = one.copy() if total is None else np.add(total, one, out=total)
    return total


def mean_by(df: DataFrame, keys: Sequence[str], vector: str, weight: str | None = None) -> DataFrame:
    """``(keys, n, mean)``: element-wise mean by key of the rows with a vector; weighted, the plain mean where weights sum to nothing. A key without any vector has no row.

    A task sends a key's sums once (or each time it holds too many keys); those of ``FAN`` tasks meet first, then their sums, so a
    key that all tasks have is no large group anywhere.
    """
    x = df.select(*keys, vector, *([weight] if weight else []))
    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    names = list(keys)

    def some(table: pa.Table) -> pa.Table:
        return pa.table({**{k: table[k][:1] for k in names}, "_sums": pa.array([_added(table["_sums"]).tobytes()], pa.binary())})

    def every(table: pa.Table) -> pa.Table:
        v = _added(table["_sums"])
        plain, weighed = v[2:].reshape(2, -1)
        mean = weighed / v[1] if v[1] > 0 else plain / v[0]
        return pa.table({**{k: table[k][:1] for k in names}, "n": pa.array([int(v[0])]), "mean": pa.array([mean], pa.list_(pa.float64()))})

    parts = x.mapInArrow(partial(_partial_sums, names, vector, weight), f"{kinds}, _fan int, _sums binary")
    met = parts.groupBy(*keys, "_fan").applyInArrow(some, f"{kinds}, _sums binary")
    return met.groupBy(*keys).applyInArrow(every, f"{kinds}, n long, mean array<double>")


#: Rows of a group whose vectors are sorted in one task; larger groups go by ranges of (group, element).
GROUP = 4096


def median_by(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise exact median by key; missing numbers (null or nan) are left out, an element without any is null, and so is a key without a vector.

    Groups of at most ``GROUP`` rows (counted first) are one matrix each; of larger ones every element's values are counted and the counts
    summed up by ranges, so no task holds a group.
    """
    names, kinds = list(keys), ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    x = df.select(*keys, F.transform(vector, lambda v: v.cast("double")).alias("_x"))
    large = cut(x.groupBy(*keys).agg(F.count("_x").alias("_n")).where(F.col("_n") > GROUP))
    same = lambda one: reduce(and_, [F.col(f"x.{k}").eqNullSafe(F.col(f"{one}.{k}")) for k in names])
    few = large.isEmpty()
    rest = x if few else x.alias("x").join(large.alias("l"), same("l"), "left_anti")

    def median(table: pa.Table) -> pa.Table:
        column = table["_x"].filter(table["_x"].is_valid())
        values = matrix(column) if len(column) else np.zeros((0, 0))
        seen = np.isfinite(values) | np.isinf(values)
        out = [float(np.median(v[s])) if s.any() else None for v, s in zip(values.T, seen.T)] if len(column) else None
        return pa.table({**{k: table[k][:1] for k in names}, "median": pa.array([out], pa.list_(pa.float64()))})

    found = rest.groupBy(*keys).applyInArrow(lambda table: median(table), f"{kinds}, median array<double>")
    if few:
        return found
    own = x.alias("x").join(large.alias("l"), same("l"), "left_semi").select(*keys, F.posexplode("_x").alias("_i", "_v"))
    every = own.groupBy(*keys).agg(F.max("_i").alias("_last")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    q = quantiles(own.where(~F.isnan("_v")), "_v", [0.5], [*keys, "_i"])
    both = every.alias("x").join(q.alias("q"), same("q") & (F.col("x._i") == F.col("q._i")), "left").select(*[f"x.{k}" for k in names], "x._i", "q.q0")
    return found.unionByName(both.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "q0"))), lambda e: e["q0"]).alias("median")))


def to_tokens(df: DataFrame, vector: str, width: int) -> DataFrame:
    """A vector as rows of tokens of ``width`` numbers: ``patch``, ``tok``."""
    n = F.floor(F.size(vector) / width).cast("int")
    return df.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(vector, i * width + 1, width))).alias("patch", "tok"))


def with_pooled(df: DataFrame, vector: str, pools: dict[str, Callable[[np.ndarray], np.ndarray]], width: int) -> DataFrame:
    """Plug point: each pool maps tokens (rows, patches, width) to vectors (rows, k); a null vector has null pools."""
    names = list(pools)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch[vector])
            t = x.reshape(len(x), -1, width)
            missing = ~batch[vector].is_valid().to_numpy(zero_copy_only=False)
            made = [pa.array([None if m else v for m, v in zip(missing, np.asarray(pools[n](t), float))], pa.list_(pa.float64())) if x.size else pa.nulls(len(x), pa.list_(pa.float64())) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return df.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in df.dtypes), *(f"{n} array<double>" for n in names)]))


def gaussian_centre(patches: int) -> np.ndarray:
    side = (patches - 1) / 2
    return np.exp(-(((np.arange(patches) - side) / max(side, 1)) ** 2))


POOLS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "mean": lambda t: t.mean(1),
    "max": lambda t: t.max(1),
    "std": lambda t: t.std(1),
    "centre": lambda t: t[:, t.shape[1] // 4 : t.shape[1] - t.shape[1] // 4].mean(1),
    "periphery": lambda t: np.concatenate([t[:, : t.shape[1] // 4], t[:, t.shape[1] - t.shape[1] // 4 :]], axis=1).mean(1),
    "product": lambda t: t.mean(1) * t.max(1),
    "norm_weighted": lambda t: (t * np.linalg.norm(t, axis=2, keepdims=True)).sum(1) / np.linalg.norm(t, axis=2).sum(1)[:, None],
    "gaussian": lambda t: np.einsum("npd,p->nd", t, gaussian_centre(t.shape[1]) / gaussian_centre(t.shape[1]).sum()),
}


def texture(t: np.ndarray) -> np.ndarray:
    """Norm mean, std and range, gradient energy along the tokens, edge minus centre, mean variance."""
    n = np.linalg.norm(t, axis=2)
    q = max(1, t.shape[1] // 4)
    edge = np.concatenate([n[:, :q], n[:, -q:]], axis=1).mean(1)
    return np.stack([n.mean(1), n.std(1), np.ptp(n, axis=1), (np.diff(t, axis=1) ** 2).mean((1, 2)), edge - n[:, q:-q].mean(1), t.var(1).mean(1)], axis=1)


def top_patches(k: int, direction: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The mean of a frame's k tokens with the largest |projection|."""

    def pool(t: np.ndarray) -> np.ndarray:
        score = np.abs(t @ direction)
        at = np.argpartition(-score, k - 1, axis=1)[:, :k]
        return np.take_along_axis(t, at[:, :, None], axis=1).mean(1)

    return pool


def dot(vector: str, weights: Sequence[float]) -> Column:
    """Saliency: the vector's product with fixed weights, as built-in functions (for few dimensions)."""
    return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, map(float, weights))), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v)


def masked_mean(values: str, mask: str) -> Column:
    """Sum(v * m) / sum(m); the plain mean without mask."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double"))
    m = total(F.col(mask))
    return F.when(m > 0, total(F.zip_with(values, mask, lambda a, b: a.cast("double") * b)) / F.nullif(m, F.lit(0.0))).otherwise(total(F.col(values)) / F.size(values))


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population standard deviations of a vector column (0 becomes 1); empty ones without a vector."""
    r = mean_by(df.withColumn("_k", F.lit(0)), ["_k"], vector).first()
    if r is None:
        return 0, np.zeros(0), np.zeros(0)
    q = mean_by(df.select(F.lit(0).alias("_k"), F.transform(vector, lambda v: v.cast("double") * v.cast("double")).alias("_q")), ["_k"], "_q").first()
    mean = np.array(r["mean"])
    sd = np.sqrt(np.maximum(np.array(q["mean"]) - mean**2, 0))
    return r.n, mean, np.where(sd > 0, sd, 1.0)


def fused(df: DataFrame, vectors: Sequence[str], name: str = "fused") -> DataFrame:
    """Blocks standardised by their own moments (one broadcast row, whatever the dimensions), then concatenated."""
    row: dict[str, list[float]] = {}
    for i, v in enumerate(vectors):
        _, mean, sd = moments(df, v)
        row |= {f"_m{i}": [float(x) for x in mean], f"_s{i}": [float(x) for x in sd]}
    one = df.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{c} array<double>" for c in row))
    x = df.crossJoin(F.broadcast(one))
    parts = []
    for i, v in enumerate(vectors):
        centred = F.zip_with(v, f"_m{i}", lambda a, b: a.cast("double") - b)
        parts.append(F.zip_with(centred, f"_s{i}", lambda a, b: a / b))
    return x.withColumn(name, F.concat(*parts)).drop(*row)


def assign(df: DataFrame, vector: str, centres: np.ndarray, name: str = "code", mean: np.ndarray | None = None, sd: np.ndarray | None = None) -> DataFrame:
    """The nearest centre of each row and the squared distance, after (x - mean) / sd if given (the centres go along with the task); null for a null vector."""
    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch[vector])
            missing = ~batch[vector].is_valid().to_numpy(zero_copy_only=False)
            x = np.nan_to_num(x) if x.size else np.zeros((len(x), centres.shape[1]))
            x = x if mean is None else (x - mean) / sd
            d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
            at = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32), mask=missing), pa.array(np.maximum(d[np.arange(len(at)), at], 0), mask=missing)], [*batch.schema.names, name, "distance"])

    return df.mapInArrow(run, f"{kinds}, {name} int, distance double")


def code_shares(df: DataFrame, entity: str, frame: str, code: str, known: Sequence[int] | None = None) -> DataFrame:
    """Per entity the mean over its frames of each code's share of the frame's patches: a row for every entity and code.

    A code that an entity lacks has share 0, as in a full matrix (so a log-ratio of the shares sees it). The codes are
    ``known`` (the codebook's), or else those that occur in the table; they must be few, the entities need not be.
    """
    c = df.where(F.col(code).isNotNull()).groupBy(entity, frame, code).agg(F.count("*").alias("_c"))
    n = c.groupBy(entity, frame).agg(F.sum("_c").alias("_p"))
    f = n.groupBy(entity).agg(F.count("*").alias("_f"))
    found = c.join(n, [entity, frame]).groupBy(entity, code).agg(F.sum(F.col("_c") / F.col("_p")).alias("_s"))
    kind = dict(df.dtypes)[code]
    names = F.array(*[F.lit(k).cast(kind) for k in known]) if known is not None else None
    grid = f.withColumn(code, F.explode(names)) if known is not None else f.crossJoin(F.broadcast(c.agg(F.collect_set(code).alias("_codes")))).withColumn(code, F.explode("_codes"))
    return grid.join(found, [entity, code], "left").select(entity, code, (F.coalesce("_s", F.lit(0.0)) / F.col("_f")).alias("share"))
