"""Exact top-k inner product search over buckets of similar length.

Vectors are dealt into buckets by length (a bucket's vectors differ by ``BAND`` in their lengths' logarithm) and, within a
bucket, by the coordinate that dominates them; a bucket's pieces are rows of a written table, each with its vectors in
falling length, as integers in as few bytes as they need. Queries come in chunks of bounded size, which are broadcast. A chunk first meets the pieces of the longest vectors,
which gives each query a score to beat; then it meets all pieces, and the score to beat rises with what a task finds.

For a query q, a score to beat s and a piece of greatest length L, only vectors whose cosine reaches the local threshold
t = s / (|q| L) can count. Past 1 the piece is left out. Else a piece takes for each query the cheaper of two ways: by
length, the piece's vectors down to length s / |q| are multiplied at once; or by coordinates, only vectors whose unit
coordinates lie where a cosine of t lets them, at the query's largest coordinates, are multiplied. Which is cheaper is told by
the share of a few of the piece's vectors that such a threshold leaves. All scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.store import partitions, written

#: Bytes of a piece's vectors, and of the queries that are broadcast at a time.
PIECE, CHUNK = 1 << 20, 8 << 20
#: A bucket's range of lengths, as a difference of natural logarithms.
BAND = 0.1
#: Pieces of the longest vectors that give the first scores to beat.
FIRST = 8
#: Coordinates of a query that prune, vectors that tell how well, and the cost of a vector picked out against one in line.
FOCUS, PROBES, PICKED = 4, 64, 8.0
#: Squared length up to which scores surely fit into 64 bits.
LONGEST = float(1 << 62)
#: Slack of the bounds, for rounding.
_EPS = 1e-9
_NONE = np.iinfo(np.int64).max


# -- pieces ---------------------------------------------------------------------------------------------


def _rows_of(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """``(row, id, dim, x, length)`` for each vector that takes part; a null id is the largest number."""
    given = F.transform(F.col(embedding), lambda v: v.cast("double"))
    rows = vectors.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(_NONE)).alias("id"), given.alias("v"))
    finite = F.forall("v", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(True)))
    squared = F.aggregate("v", F.lit(0.0), lambda s, y: s + F.floor(y * scale).cast("double") * F.floor(y * scale).cast("double"))
    rows = rows.withColumn("squared", squared).where(F.col("squared") <= LONGEST)
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", F.size("v").alias("dim"), F.transform("v", lambda y: F.floor(y * scale)).alias("x"), F.sqrt("squared").alias("length"))


def _leading(x: str) -> F.Column:
    """The coordinate of largest size (the first of several) and its sign, as one number."""
    most = F.aggregate(x, F.lit(0).cast("long"), lambda s, y: F.greatest(s, F.abs(y)))
    at = F.array_position(F.transform(x, lambda y: F.abs(y)), most)
    return (at * 2 + (F.coalesce(F.try_element_at(x, F.greatest(at, F.lit(1)).cast("int")), F.lit(0)) > 0).cast("int")).cast("int")


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in as few bytes as they need."""
    low, high = x.min(initial=0), x.max(initial=0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


_PIECES = "dim int, band int, n int, longest double, width int, rows binary, ids binary, data binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted rows: a piece ends where the dimension or the band changes, or when it is full."""
    held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def piece() -> pa.RecordBatch:
        dim, band = held[0][:2]
        x = _narrow(np.concatenate([h[4] for h in held]))
        rows, ids = (np.concatenate([h[k] for h in held]) for k in (2, 3))
        squared = (x.astype(np.float64) ** 2).sum(1)
        order = np.argsort(-squared, kind="stable")
        values = [[dim], [band], [len(x)], [float(np.sqrt(squared.max(initial=0.0)))], [x.dtype.itemsize], [rows[order].tobytes()], [ids[order].tobytes()], [x[order].tobytes()]]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["dim", "band", "n", "longest", "width", "rows", "ids", "data"])

    for batch in batches:
        dim, band, rows, ids = (batch[c].to_numpy() for c in ("dim", "band", "row", "id"))
        flat = batch["x"].flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(dim, dtype=np.int64)])
        edge = np.flatnonzero((dim[1:] != dim[:-1]) | (band[1:] != band[:-1])) + 1
        cuts = np.concatenate([[0], edge, [len(dim)]])
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0][:2] != (dim[a], band[a]):
                yield piece()
                held, size = [], 0
            most = max(1, PIECE // max(2, 2 * int(dim[a])))
            while a < b:
                e = min(b, a + most - size)
                held.append((int(dim[a]), int(band[a]), rows[a:e], ids[a:e], flat[at[a] : at[e]].reshape(e - a, int(dim[a]))))
                size += e - a
                a = e
                if size >= most:
                    yield piece()
                    held, size = [], 0
    if held:
        yield piece()


def _matrix(piece: dict) -> np.ndarray:
    return np.frombuffer(piece["data"], f"<i{piece['width']}").reshape(piece["n"], piece["dim"])


# -- search -----------------------------------------------------------------------------------------------


class Queries:
    """A chunk of queries of one dimension: integers, lengths, their rows, and for each the best scores so far."""

    def __init__(self, pieces: list[dict], floors: dict[int, int], k: int) -> None:
        self.x = np.concatenate([_matrix(p).astype(np.int64) for p in pieces])
        self.rows = np.concatenate([np.frombuffer(p["rows"], "<i8") for p in pieces])
        self.real = self.x.astype(np.float64)
        self.length = np.sqrt((self.real**2).sum(1))
        self.unit = self.real / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        #: Scores below these can't count; a query without one takes any.
        self.floor = np.array([floors.get(r, np.iinfo(np.int64).min) for r in self.rows.tolist()], np.int64)
        self.k = k
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Keep the best ``k`` of a query's scores (ties: smaller id), and let what they ask for rise."""
        if q in self.found:
            scores, ids = np.concatenate([self.found[q][0], scores]), np.concatenate([self.found[q][1], ids])
        if len(scores) > self.k:
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
        self.found[q] = scores, ids
        if len(scores) == self.k:
            self.floor[q] = max(self.floor[q], scores.min())


def regions(unit: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between which values a unit vector's coordinate lies if its cosine with a query is at least ``t``, the query's being ``unit``."""
    spread = np.sqrt(np.maximum(0.0, (1 - t**2) * (1 - unit**2)))
    low = np.where(-unit >= t, -1.0, t * unit - spread)
    high = np.where(unit >= t, 1.0, t * unit + spread)
    return low - _EPS, high + _EPS


def products(x: np.ndarray, real: np.ndarray, y: np.ndarray, bound: float) -> np.ndarray:
    """Exact products of integer rows: doubles hold each partial sum below 2^53, longs beyond."""
    if bound < 2.0**53:
        return (real @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.astype(np.int64).T


def search_piece(q: Queries, piece: dict) -> None:
    """The products of a piece's vectors that can count for a query."""
    y = _matrix(piece)
    rows, ids = np.frombuffer(piece["rows"], "<i8"), np.frombuffer(piece["ids"], "<i8")
    real = y.astype(np.float64)
    length = np.sqrt((real**2).sum(1))
    longest = float(piece["longest"])
    reach = q.length * longest
    floor = q.floor.astype(np.float64)
    t = np.where(reach > 0, floor / np.maximum(reach, 1e-300), np.where(floor > 0, np.inf, -np.inf))
    alive = t <= 1 + _EPS
    if not alive.any():
        return
    # vectors long enough: all, unless the score to beat is positive
    need = np.where(floor > 0, floor / np.maximum(q.length, 1e-300) * (1 - _EPS), 0.0)
    upto = np.where(floor > 0, np.searchsorted(-length, -need, "right"), len(y))
    by_length = alive.copy()
    unit = None
    some = np.flatnonzero(alive & (t > -1))
    if len(some) and len(y) > 2 * PROBES:
        unit = real / np.maximum(length, 1e-300)[:, None]
        probes = unit[np.linspace(0, len(y) - 1, PROBES).astype(np.int64)]
        at = q.focus[some]
        low, high = regions(np.take_along_axis(q.unit[some], at, 1), t[some, None])
        seen = probes[:, at]  # probe, query, coordinate
        share = ((seen >= low) & (seen <= high)).all(2).mean(0)
        by_length[some[share * len(y) * PICKED < upto[some]]] = False
    bound = float(q.length.max(initial=0.0)) * longest
    # by length: queries of like prefixes are multiplied together
    some = np.flatnonzero(by_length)
    for s in range(0, len(some), 256):
        part = some[s : s + 256]
        n = int(upto[part].max(initial=0))
        for c in range(0, n, 4096):
            e = min(n, c + 4096)
            scores = products(q.x[part], q.real[part], y[c:e], bound)
            good = (scores >= q.floor[part][:, None]) & (rows[None, c:e] != q.rows[part][:, None])
            for k in np.flatnonzero(good.any(1)).tolist():
                hit = np.flatnonzero(good[k])
                own = scores[k, hit]
                if len(hit) > q.k:  # the k-th best of these is a score to beat, too
                    least = np.partition(own, len(own) - q.k)[len(own) - q.k]
                    hit, own = hit[own >= least], own[own >= least]
                q.take(int(part[k]), own, ids[c + hit])
    # by coordinates
    for k in np.flatnonzero(alive & ~by_length).tolist():
        f = q.focus[k]
        low, high = regions(q.unit[k, f], t[k])
        keep = np.arange(int(upto[k]))
        for c, a, b in zip(f.tolist(), low, high):
            v = unit[keep, c]
            keep = keep[(v >= a) & (v <= b)]
        keep = keep[rows[keep] != q.rows[k]]
        if len(keep):
            scores = products(q.x[k : k + 1], q.real[k : k + 1], y[keep], bound)[0]
            good = scores >= q.floor[k]
            q.take(k, scores[good], ids[keep[good]])


def _searched(given, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of this task's pieces for each query of a chunk; longer pieces of a batch first."""
    chunk, floors = given.value
    by_dim: dict[int, list[dict]] = {}
    for piece in chunk:
        by_dim.setdefault(piece["dim"], []).append(piece)
    queries = {dim: Queries(pieces, floors, k) for dim, pieces in by_dim.items()}
    for batch in batches:
        for piece in sorted(batch.to_pylist(), key=lambda p: -p["longest"]):
            if piece["dim"] in queries:
                search_piece(queries[piece["dim"]], piece)
    for q in queries.values():
        for part in range(0, len(q.rows), 4096):
            own = [(int(q.rows[i]), *q.found[i]) for i in range(part, min(len(q.rows), part + 4096)) if i in q.found]
            if own:
                n = [len(s) for _, s, _ in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r for r, _, _ in own], n)), pa.array(np.concatenate([s for _, s, _ in own])), pa.array(np.concatenate([i for _, _, i in own]))], ["row", "score", "id"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best; tasks cut their own before any rows move."""
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(pieces: DataFrame, chunk: list[dict], floors: dict[int, int], k: int) -> DataFrame:
    given = pieces.sparkSession.sparkContext.broadcast((chunk, floors))
    return _best(pieces.mapInArrow(partial(_searched, given, k), "row long, score long, id long"), k)


def top_products(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, every: int = 100, scale: float = 1024.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of each query with the other rows.

    A vector is its components' ``floor(scale * component)`` (component as double). Queries are the rows whose id ``every``
    divides; each row but the query's own is a candidate, those with the query's id included if an id repeats (then each
    of its rows gives a list of its own). Ties go to smaller ids, a null id counting as the largest (and giving null). Vectors
    that are null or hold null or non-finite components take no part, nor do those whose squared integer length passes 2^62, as their
    scores need more than 64 bits; vectors of another length than the query's aren't its candidates. Zero and empty vectors score 0.
    An empty table gives no row. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(_rows_of(vectors, vec_id, embedding, scale))
    band = F.when(F.col("length") > 0, F.floor(F.log("length") / BAND)).otherwise(-1).cast("int")
    keyed = rows.withColumns({"band": band, "leading": _leading("x")})
    order = [F.col("dim"), F.desc("band"), F.col("leading"), F.col("row")]
    dealt = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    pieces = written(dealt.select("dim", "band", "row", "id", "x").mapInArrow(_packed, _PIECES))
    asked = keyed.where((F.col("id") % every == 0) & (F.col("id") != _NONE))
    asked = asked.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    queries = written(asked.select("dim", "band", "row", "id", "x").mapInArrow(_packed, _PIECES))
    first = pieces.orderBy(F.desc("longest")).limit(FIRST)
    first = written(first)
    out: DataFrame | None = None
    for chunk in _chunks(queries):
        floors = {r.row: r.score for r in _search(first, chunk, {}, k).where(F.col("rank") == k).collect()}
        found = written(_search(pieces, chunk, floors, k))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    names = rows.where((F.col("id") % every == 0) & (F.col("id") != _NONE)).select("row", F.col("id").alias("query_id"))
    return out.join(names, "row").select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != _NONE, F.col("id")).alias("vec_id"), "score")


def _chunks(queries: DataFrame) -> Iterator[list[dict]]:
    """Query pieces in lists of at most ``CHUNK`` bytes (one piece at least), read one after another."""
    chunk: list[dict] = []
    size = 0
    for r in queries.toLocalIterator():
        piece = r.asDict() | {c: bytes(r[c]) for c in ("rows", "ids", "data")}
        if chunk and size + len(piece["data"]) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(piece)
        size += len(piece["data"])
    if chunk:
        yield chunk
