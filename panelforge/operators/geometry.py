"""Nearest neighbours, graphs, intrinsic dimension and cluster comparison.

Exact neighbours come from groups of rows that meet all others, batch by batch: a product of single precision and a bound of
its rounding tell which pairs may be among a row's k nearest, and only those are worked out. The pairs are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators.lineage import cut, forget, scratch, stored
from panelforge.operators.vectors import matrix
from panelforge.operators.windows import numbered

#: Rows of a group that are compared with all others in one task, at least; and the groups at most, so that the copies of the table grow with it.
BLOCK = 2048
MOST_GROUPS = 64
#: Rows of a group compared with a batch at a time, and others that give each its first bound.
TILE, FIRST = 512, 512
#: Numbers that a task packs before they go out (some 64 kB for each of 64 groups, so a batch of 10,000 blocks is bounded), and others that a group meets at a time, about.
PACK, MEET = 1 << 19, 4096


@dataclass(frozen=True)
class Metric:
    """A distance between rows of two matrices; called, it gives all of them.

    ``rows`` gives those of pairs, from differences. ``left(a, limit, slack) @ right(b, slack).T`` is at most zero wherever the distance is within the
    row's ``limit``, if ``slack`` covers the rounding of the product; elsewhere it mostly isn't. ``least``: cells a row has to have.
    """

    every: Callable[[np.ndarray, np.ndarray], np.ndarray]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray]
    left: Callable[[np.ndarray, np.ndarray, float], np.ndarray]
    right: Callable[[np.ndarray, float], np.ndarray]
    least: int | None = None

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.every(a, b)

    def usable(self, v: np.ndarray) -> np.ndarray:
        if self.least is None:
            return np.isfinite(v).all(1)
        return ~np.isinf(v).any(1) & ((~np.isnan(v)).sum(1) >= max(1, self.least))


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]
    return np.sqrt(np.maximum(d, 0))


euclidean = Metric(
    _euclidean,
    lambda a, b: np.sqrt(((a - b) ** 2).sum(1)),
    lambda a, limit, slack: np.hstack([-2 * a, ((1 - slack) * (a * a).sum(1) - (1 + slack) * limit * limit)[:, None], np.ones((len(a), 1))]),
    lambda b, slack: np.hstack([b, np.ones((len(b), 1)), (1 - slack) * (b * b).sum(1)[:, None]]),
)


def masked(least: int) -> Metric:
    """Distance over the common observed cells scaled to all p; pairs with too few are infinitely far."""

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ma, mb = (~np.isnan(x) for x in (a, b))
        a0, b0 = np.nan_to_num(a), np.nan_to_num(b)
        common = ma.astype(float) @ mb.T.astype(float)
        d = (a0 * a0) @ mb.T - 2 * a0 @ b0.T + ma @ (b0 * b0).T
        out = np.sqrt(np.maximum(d, 0) * a.shape[1] / np.maximum(common, 1))
        return np.where(common >= least, out, np.inf)

    def rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = a - b
        common = (~np.isnan(gap)).sum(1)
        return np.where(common >= least, np.sqrt(np.nansum(gap * gap, axis=1) * a.shape[1] / np.maximum(common, 1)), np.inf)

    def left(a: np.ndarray, limit: np.ndarray, slack: float) -> np.ndarray:
        there, a0 = ~np.isnan(a), np.nan_to_num(a)
        return np.hstack([(1 - slack) * a0 * a0 - ((1 + slack) * limit * limit / a.shape[1])[:, None] * there, -2 * a0, there])

    def right(b: np.ndarray, slack: float) -> np.ndarray:
        b0 = np.nan_to_num(b)
        return np.hstack([~np.isnan(b), b0, (1 - slack) * b0 * b0])

    return Metric(distance, rows, left, right, least)


class _Nearest:
    """The ``k`` nearest others of a group of rows, among batches of others: a product tells which pairs may be among them, and only those are worked out."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, metric: Metric):
        ok = metric.usable(v)
        self.ids, self.v, self.k, self.metric = ids[ok], v[ok], k, metric
        self.dst, self.dist = np.zeros((len(self.ids), k), np.int64), np.full((len(self.ids), k), np.inf)

    def _keep(self, s: int, r: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """Merge pairs of rows from ``s`` on into their lists, ties by id."""
        touched, at = np.unique(r, return_inverse=True)
        held = self.dist[s + touched]
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        dst, dist = np.concatenate([self.dst[s + touched].ravel(), ids]), np.concatenate([held.ravel(), d])
        order = np.lexsort((dst, np.round(dist, 9), row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(touched)))[row]
        order = order[place < self.k]
        self.dst[s + touched], self.dist[s + touched] = dst[order].reshape(-1, self.k), dist[order].reshape(-1, self.k)

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        ok = self.metric.usable(v)
        ids, v = ids[ok], v[ok]
        if not len(ids) or not len(self.ids):
            return
        largest = max(np.nanmax(np.abs(self.v)), np.nanmax(np.abs(v)))
        kind = np.float32 if 1e-9 < largest < 1e9 else np.float64
        slack = float(8 * (v.shape[1] + 8) * np.finfo(kind).eps)
        right = self.metric.right(v, slack).astype(kind).T
        product, below = np.empty((TILE, len(ids)), kind), np.empty((TILE, len(ids)), bool)
        for s in range(0, len(self.ids), TILE):
            a, own = self.v[s : s + TILE], self.ids[s : s + TILE]
            limit = self.dist[s : s + TILE, -1]
            if np.isinf(limit).any():  # a bound from a few of the others
                d = self.metric(a, v[:FIRST])
                d[own[:, None] == ids[None, :FIRST]] = np.inf
                if d.shape[1] >= self.k:
                    few = np.argpartition(d, self.k - 1, axis=1)[:, : self.k]
                    r = np.repeat(np.arange(len(a)), self.k)
                    apart = np.where(np.isfinite(d[r, few.ravel()]), self.metric.rows(a[r], v[few.ravel()]), np.inf)
                    limit = np.minimum(limit, apart.reshape(-1, self.k).max(1))
            limit = np.minimum(limit, 4 * (1 + largest) * v.shape[1]) + 2e-9
            np.matmul(self.metric.left(a, limit, slack).astype(kind), right, out=product[: len(a)])
            near = np.flatnonzero(np.less_equal(product[: len(a)], 0, out=below[: len(a)]))
            for part in np.array_split(near, -(-len(near) // (1 << 16))) if len(near) else ():
                r, c = np.divmod(part, len(ids))
                apart = self.metric.rows(a[r], v[c])
                ok = np.isfinite(apart) & (own[r] != ids[c]) & (apart <= limit[r])
                if ok.any():
                    self._keep(s, r[ok], ids[c[ok]], apart[ok])

    def pairs(self) -> pa.RecordBatch:
        ok = np.isfinite(self.dist)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, ok.sum(1))), pa.array(self.dst[ok]), pa.array(self.dist[ok])], ["src", "dst", "dist"])


def _packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row for each group: its rows' ids and numbers."""
    i, ids, v = map(np.concatenate, zip(*held))
    order = np.argsort(i, kind="stable")
    takes = np.split(order, np.flatnonzero(np.diff(i[order])) + 1)
    return pa.RecordBatch.from_pydict({
        "i": pa.array([int(i[x[0]]) for x in takes], pa.int32()), "ids": pa.array([ids[x].astype("<i8").tobytes() for x in takes], pa.binary()),
        "v": pa.array([v[x].tobytes() for x in takes], pa.binary()), "width": pa.array([v.shape[1]] * len(takes), pa.int32()),
    })


def _unpacked(ids: pa.Scalar, v: pa.Scalar, width: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    ids, data, width = np.frombuffer(ids.as_buffer(), "<i8"), v.as_buffer(), width.as_py()
    return ids, np.frombuffer(data, "<f8" if len(data) == 8 * width * len(ids) else "<f4").reshape(len(ids), width).astype(np.float64)


def nearest(df: DataFrame, row: str, vector: str, k: int, distance: Metric = euclidean, blocks: int | None = None) -> DataFrame:
    """``(src, dst, rank, dist)``: the k nearest others of each row; ties by id. Null vectors have and are no neighbours.

    Each group of rows meets all others in one task, batch by batch. Rows travel packed, many to a block, and the blocks are dealt out before they are
    copied, so a table in few files is copied by many tasks. Work is quadratic; a task holds its group and a batch, and the table moves once for each group (at
    most ``MOST_GROUPS``).
    """
    x = df.where(F.col(vector).isNotNull()).select(F.col(row).cast("long").alias("id"), F.col(vector).alias("v"))
    if blocks is None:
        blocks = min(MOST_GROUPS, max(1, -(-x.count() // BLOCK)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if len(batch):
                v = matrix(batch["v"])
                single = pa.types.is_float32(batch["v"].type.value_type)
                held.append((batch["i"].to_numpy(), batch["id"].to_numpy(), v.astype("<f4" if single else "<f8")))
                size += v.size
            if size > PACK:
                yield _packed(held)
                held, size = [], 0
        if held:
            yield _packed(held)

    groups = F.concat(F.array(F.struct(F.col("i").alias("g"), F.lit(0).alias("side"))), F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct(i.alias("g"), F.lit(1).alias("side"))))
    packed = x.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("i"), "id", "v").mapInArrow(pack, "i int, ids binary, v binary, width int")
    copies = packed.repartition(blocks).select(F.inline(groups).alias("i", "side"), "ids", "v", "width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, found, held = None, [], None, []

        def meet(least: int) -> None:
            nonlocal held
            if held and sum(len(i) for i, _ in held) >= least:
                found.meet(*map(np.concatenate, zip(*held)))
                held = []

        for batch in batches:
            for i, side, *block in zip(batch["i"].to_pylist(), batch["side"].to_pylist(), batch["ids"], batch["v"], batch["width"]):
                if i != at:  # sorted: a group's own rows come before the others
                    if found is not None:
                        meet(1)
                        yield found.pairs()
                    at, own, found = i, [], None
                if side == 0:
                    own.append(_unpacked(*block))
                    continue
                if found is None:
                    found = _Nearest(*map(np.concatenate, zip(*own)), k, distance) if own else _Nearest(np.zeros(0, np.int64), np.zeros((0, block[2].as_py())), k, distance)
                    own = []
                held.append(_unpacked(*block))
                meet(MEET)
        if found is not None:
            meet(1)
            yield found.pairs()

    local = copies.repartitionById(blocks, F.col("i")).sortWithinPartitions("i", "side").mapInArrow(run, "src long, dst long, dist double")
    w = Window.partitionBy("src").orderBy(F.bround("dist", 9), "dst")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def affinity(edges: DataFrame, scale_rank: int) -> DataFrame:
    """Self-tuning weights exp(-d^2 / (s_i s_j)), s the distance to the ``scale_rank``-th neighbour; symmetric by the larger."""
    edges = cut(edges)  # read three times
    s = edges.where(F.col("rank") == scale_rank).select(F.col("src").alias("node"), F.col("dist").alias("s"))
    x = edges.join(s.withColumnRenamed("node", "src").withColumnRenamed("s", "s1"), "src").join(s.withColumnRenamed("node", "dst").withColumnRenamed("s", "s2"), "dst")
    x = x.withColumn("w", F.exp(-F.col("dist") * F.col("dist") / (F.col("s1") * F.col("s2"))))
    return x.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("w"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per node the share of its k neighbours that two spaces have in common."""
    both = a.select("src", "dst").join(b.select("src", "dst"), ["src", "dst"]).groupBy("src").agg(F.count("*").alias("n"))
    return a.select("src").distinct().join(both, "src", "left").select("src", (F.coalesce("n", F.lit(0)) / float(k)).alias("overlap"))


def two_nn(edges: DataFrame) -> DataFrame:
    """Two-nearest-neighbour dimension: maximum likelihood, and regression through the origin with F = i/(n+1)."""
    r = edges.where("rank <= 2").groupBy("src").agg(F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("r2")).where("r1 > 0")
    x = cut(r.select("src", F.ln(F.col("r2") / F.col("r1")).alias("m")))
    n = x.count()
    e = numbered(x, ["m", "src"]).withColumn("y", -F.ln(1 - F.col("number") / float(n + 1)))
    return e.agg((F.count("*") / F.sum("m")).alias("mle"), (F.sum(F.col("m") * F.col("y")) / F.sum(F.col("m") * F.col("m"))).alias("regression"))


def levina_bickel(edges: DataFrame, k: int) -> DataFrame:
    edges = cut(edges)  # read twice
    t = edges.where(F.col("rank") <= k).join(edges.where(F.col("rank") == k).select("src", F.col("dist").alias("t")), "src")
    per = t.where((F.col("rank") < k) & (F.col("dist") > 0)).groupBy("src").agg((F.count("*") / F.sum(F.ln(F.col("t") / F.col("dist")))).alias("d"))
    return per.agg(F.avg("d").alias("dimension"), (F.count("*") / F.sum(1 / F.col("d"))).alias("harmonic"))


def cluster_links(edges: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """Observed over expected neighbour edges between clusters."""
    l1, l2 = labels.select(F.col(node).alias("src"), F.col(label).alias("a")), labels.select(F.col(node).alias("dst"), F.col(label).alias("b"))
    e = edges.join(l1, "src").join(l2, "dst").groupBy("a", "b").agg(F.count("*").alias("observed"))
    e = cut(e)  # read four times
    rows, cols, total = e.groupBy("a").agg(F.sum("observed").alias("ra")), e.groupBy("b").agg(F.sum("observed").alias("cb")), e.agg(F.sum("observed").alias("t"))
    return e.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total)).select("a", "b", "observed", (F.col("observed") * F.col("t") / (F.col("ra") * F.col("cb"))).alias("ratio"))


def cluster_graph(links: DataFrame, over: float = 1.0) -> DataFrame:
    """``(cluster, degree, component, clusters, links, branch, tree)``: the graph of clusters whose ratio either way passes ``over``.

    ``branch``: degree of 3 or more; ``tree``: a component with one link fewer than clusters. Clusters without a link are components of their own.
    """
    every = links.select(F.col("a").alias("cluster")).unionAll(links.select("b")).distinct()
    e = links.where((F.col("a") != F.col("b")) & (F.col("ratio") > over)).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    e = cut(e)
    degree = e.select(F.col("src").alias("cluster")).unionAll(e.select("dst")).groupBy("cluster").agg(F.count("*").alias("degree"))
    of = connected(e) if not e.isEmpty() else e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    x = every.join(degree, "cluster", "left").join(of.withColumnRenamed("node", "cluster"), "cluster", "left")
    x = x.select("cluster", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("component", "cluster").alias("component"))
    sizes = x.groupBy("component").agg(F.count("*").alias("clusters"), (F.sum("degree") / 2).cast("long").alias("links"))
    return x.join(sizes, "component").select("cluster", "degree", "component", "clusters", "links", (F.col("degree") >= 3).alias("branch"), (F.col("links") == F.col("clusters") - 1).alias("tree"))


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` by label propagation with pointer jumping, until nothing changes; each round is stored, and the one before it goes."""
    spark, path, r = edges.sparkSession, scratch(edges.sparkSession, "components"), 0
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    both = stored(both, f"{path}/links")
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")), f"{path}/{r}")
    while True:
        new = both.join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m")).join(label, "a").select("a", F.least("m", "c").alias("c"))
        jump = new.select(F.col("a").alias("c"), F.col("c").alias("cc"))
        new = stored(new.join(jump, "c", "left").select("a", F.least("c", F.coalesce("cc", "c")).alias("c")), f"{path}/{r + 1}")
        changed = new.join(label.withColumnRenamed("c", "old"), "a").where("c <> old").limit(1).count()
        forget(spark, f"{path}/{r}")
        label, r = new, r + 1
        if not changed:
            forget(spark, f"{path}/links")
            return label.select(F.col("a").alias("node"), F.col("c").alias("component"))


def contingency(df: DataFrame, a: str, b: str) -> np.ndarray:
    """Counts of two labellings (few labels each)."""
    rows = df.groupBy(a, b).count().collect()
    left, right = ({v: i for i, v in enumerate(sorted({r[c] for r in rows}))} for c in (a, b))
    out = np.zeros((len(left), len(right)))
    for r in rows:
        out[left[r[a]], right[r[b]]] = r["count"]
    return out


def _entropy(p: np.ndarray) -> float:
    p = p[p > 0] / p.sum()
    return float(-(p * np.log(p)).sum())


def mutual_information(c: np.ndarray) -> float:
    return _entropy(c.sum(1)) + _entropy(c.sum(0)) - _entropy(c.ravel())


#: Terms of a sum that are held at a time.
_TERMS = 1 << 16


def _expected_cell(n: int, a: int, b: int) -> float:
    """Mean of k/n log(n k / (a b)) with k hypergeometric: terms by the ratio of neighbours, out from the mode until they are nothing."""
    low, high = max(0, a + b - n), min(a, b)
    mode = min(high, max(low, (a + 1) * (b + 1) // (n + 2)))
    mass, total = 1.0, mode / n * math.log(n * mode / (a * b)) if mode else 0.0

    for step in (1, -1):
        at, last = mode, 0.0
        while low <= at + step <= high and last > -745:
            k = np.arange(at + step, max(low, min(high, at + step * _TERMS)) + step, step, dtype=np.float64)
            if step == 1:  # p(k) / p(k - 1)
                ratio = (a - k + 1) * (b - k + 1) / (k * (n - a - b + k))
            else:  # p(k) / p(k + 1)
                ratio = (k + 1) * (n - a - b + k + 1) / ((a - k) * (b - k))
            logs = last + np.cumsum(np.log(ratio))
            p = np.exp(logs)
            mass += p.sum()
            total += (p[k > 0] * k[k > 0] / n * np.log(n * k[k > 0] / (a * b))).sum()
            at, last = int(k[-1]), float(logs[-1])
    return total / mass  # scaled by their own sum: no large logarithms cancel


def expected_information(c: np.ndarray) -> float:
    """Mean mutual information of labellings with the same sizes (hypergeometric); cells of the same sizes are worked out once."""
    n, a, b = int(c.sum()), c.sum(1).astype(np.int64), c.sum(0).astype(np.int64)
    left, right = (np.unique(v[v > 0], return_counts=True) for v in (a, b))
    return float(sum(_expected_cell(n, int(i), int(j)) * int(x) * int(y) for i, x in zip(*left) for j, y in zip(*right)))


def adjusted_information(c: np.ndarray) -> float:
    e = expected_information(c)
    most = (_entropy(c.sum(1)) + _entropy(c.sum(0))) / 2
    return (mutual_information(c) - e) / (most - e) if most > e else 1.0


def best_match(score: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one match of rows and columns with the largest total, by shortest augmenting paths."""
    cost = score.max() - score
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < low[free]
            low[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def pair_distances(df: DataFrame, row: str, vector: str, pairs: DataFrame) -> DataFrame:
    """Euclidean distance of each listed pair (a, b)."""
    gap = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))
    one = df.select(F.col(row).alias("a"), F.col(vector).alias("va"))
    two = df.select(F.col(row).alias("b"), F.col(vector).alias("vb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", gap.alias("dist"))


def sampled_pairs(df: DataFrame, row: str, n: int, draw: Callable[[int], Column] | None = None) -> DataFrame:
    """``n`` draws of two rows (a, b), by hash of the draw's number; draws of one row twice go, repeats stay once."""
    draw = draw or (lambda side: F.xxhash64("_d", F.lit(side)))
    x = cut(numbered(df.select(row), [row]))
    total = x.count()
    d = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "_d")
    d = d.select(*[(F.pmod(draw(side), F.lit(max(total, 1))) + 1).alias(f"_{side}") for side in (1, 2)])
    one, two = x.select(F.col("number").alias("_1"), F.col(row).alias("a")), x.select(F.col("number").alias("_2"), F.col(row).alias("b"))
    return d.join(one, "_1").join(two, "_2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def codebook(tokens: DataFrame, vector: str, k: int, seed: int = 0, rounds: int = 10, sample: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres in standardised units, and the tokens' means and deviations.

    Fitted on a hash sample of about ``sample`` tokens; codes that no token of it chose move to the
    tokens farthest from their own centre, followed by one more pass of means. No token gives no centres.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from panelforge.operators.vectors import assign, mean_by, moments

    n, mean, sd = moments(tokens, vector)
    if not n:
        return np.zeros((0, 0)), mean, sd
    share = min(1.0, sample / max(n, 1))
    x = tokens.select(F.transform(vector, lambda v: v.cast("double")).alias("_t")).where(F.col("_t").isNotNull())
    if share < 1:
        x = x.where(F.pmod(F.xxhash64("_t", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    one = x.sparkSession.createDataFrame([([float(v) for v in mean], [float(v) for v in sd])], "_m array<double>, _d array<double>")
    z = F.zip_with(F.zip_with("_t", "_m", lambda a, b: a - b), "_d", lambda a, b: a / b)
    x = cut(x.crossJoin(F.broadcast(one)).select(z.alias("_z")))
    fit = np.array(KMeans(k=k, seed=seed, maxIter=rounds).fit(x.select(array_to_vector("_z").alias("features"))).clusterCenters())
    centres = np.vstack([fit, np.zeros((k - len(fit), fit.shape[1]))])
    near = assign(x, "_z", centres)
    used = {r.code for r in near.select("code").distinct().collect()} & set(range(len(fit)))
    dead = [c for c in range(k) if c not in used]
    if dead:
        far = near.orderBy(F.desc("distance"), "_z").select("_z").limit(len(dead)).collect()
        for c, r in zip(dead, far):
            centres[c] = r["_z"]
        for r in mean_by(assign(x, "_z", centres), ["code"], "_z").collect():
            centres[r.code] = r["mean"]
    return centres, mean, sd
