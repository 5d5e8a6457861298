"""Embedding near-dedup by counting collisions of one-dimensional projections.

Vectors are projected onto many random lines. Each line is sorted at its two ends, where few vectors
lie: a vector enters the lists of the ``t`` ends on which it stands out most. Along a sorted list a
window slides that is centred on the query, and pairs within it have their collisions counted: the
windows, centred on the query too, of ``COUNTED`` further lines. Pairs that reach the calibrated
count are verified by their cosine in double precision.

Calibration is for pairs at exactly the threshold, the hardest ones. ``t`` is the least at which
``RECALL`` of such pairs, drawn at random, meet in a list. Their coordinates differ by a normal of
standard deviation ``2 sin(angle / 2)``, so collisions are binomial, and the count asked for is the
largest that ``RECALL`` of them reach. The number of lines grows with the rows, so lists keep their
length; past ``LINES`` lines a list is an end of two lines at once, one of either family.

Equal vectors stand as one class. Classes that lie close around the centre of a crowded cell are one
ball: all of them link. Single classes are searched among themselves; balls are queries, by their
centres and for an angle wider by the radii, against everything. Two balls whose angles leave no doubt
link in whole, or not at all; other pairs are compared member by member. Groups of near copies so cost
their size, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.graph import components
from panelforge.llm.store import checkpointed, written
from panelforge.llm.text import U64, mix

THRESHOLD, RECALL, SEED = 0.9, 0.9998, 11
#: Lines on which collisions are counted; pairs short of the first lines' count are left at once.
COUNTED, FIRST = 48, 24
#: Half-width of a window, in standard deviations of a threshold pair's difference, and its steps.
REACH, STEPS = 1.5, 12
#: Half-width of the window that slides along a list.
SLIDE = 2.0
#: Vectors of a list, about; lines that one family has at most.
LIST, LINES = 512, 1 << 15
#: Members of a list or a ball that one task compares at once; more are split into pairs of pieces.
PIECE = 2048
#: A cell of so many classes may become a ball.
CROWD = 8
#: Bytes up to which a table is broadcast.
SMALL = 16 << 20
_TOTALS = "cell long, fan int, total binary"
#: Angles closer than this to a bound count as open.
SLACK = 1e-6


def _normals(name: int, dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, name, dim]).standard_normal((dim, n), dtype=np.float32)


@lru_cache(maxsize=16)
def _lines(name: int, dim: int, n: int) -> np.ndarray:
    return _normals(name, dim, n)


def least_count(lines: int, recall: float = RECALL) -> int:
    """The largest number of collisions that ``recall`` of the threshold pairs reach."""
    p = math.erf(REACH / math.sqrt(2))
    tail, c = 0.0, lines + 1
    while tail < recall and c > 0:
        c -= 1
        tail += math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
    return c


def _ends(unit: np.ndarray, name: int, lines: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``t`` line ends (twice the line, plus its side) that stand out most, in order, and the coordinates there."""
    at = unit.astype(np.float32) @ _lines(name, unit.shape[1], lines)
    size = np.abs(at)
    top = np.argpartition(-size, t - 1, axis=1)[:, :t] if t < lines else np.tile(np.arange(lines), (len(unit), 1))
    value = np.take_along_axis(size, top, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    return 2 * top + (np.take_along_axis(at, top, 1) > 0), value


class Plan:
    """Lines, ends and counts for lists of about ``n`` vectors (of which the pairs are wanted) and an angle (radians) that pairs may have."""

    def __init__(self, n: int, angle: float, kind: str = "<f8") -> None:
        self.kind = kind
        self.gap = 2 * math.sin(min(angle, math.pi) / 2)
        self.angle = angle
        self.families = 1 if n * 16 <= 2 * LINES * LIST else 2
        guess = 12 if self.families == 1 else 64
        self.lines = int(min(LINES, max(8, (n * guess / LIST) ** (1 / self.families) / 2)))
        self.first, self.whole = least_count(FIRST), least_count(COUNTED)

    def ends(self, dim: int) -> int:
        return _calibrated(dim, self.lines, self.families, round(math.cos(self.angle), 3))

    def lists(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the lists it enters and its coordinate in each."""
        n, dim = unit.shape
        t = self.ends(dim)
        name, value = _ends(unit, 0, self.lines, t)
        if self.families == 2:
            other, _ = _ends(unit, 1, self.lines, t)
            name = (name[:, :, None] * (2 * self.lines) + other[:, None, :]).reshape(n, -1)
            value = np.repeat(value, other.shape[1], axis=1)
        return name + (dim << 36), value

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """The coordinates on the counted lines, in steps of a window's half-width, as bytes."""
        at = unit.astype(np.float32) @ _lines(2, unit.shape[1], COUNTED)
        return (np.clip(np.rint(at * (STEPS / (REACH * self.gap))), -127, 127) + 128).astype(np.uint8)


@lru_cache(maxsize=64)
def _calibrated(dim: int, lines: int, families: int, cosine: float) -> int:
    """The least number of ends at which RECALL of the pairs at this cosine meet within a window."""
    rng = np.random.default_rng([SEED, 9, dim])
    most = min(48, lines)
    worst = []
    for _ in range(8):
        x, z = rng.standard_normal((2, 500, dim))
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-300)
        y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z
        need = np.zeros(len(x), int)
        for f in range(families):
            (a, at_a), (b, at_b) = _ends(x, f, lines, most), _ends(y, f, lines, most)
            same = a[:, :, None] == b[:, None, :]
            if f == 0:  # along which the window slides
                same &= np.abs(at_a[:, :, None] - at_b[:, None, :]) <= SLIDE * 2 * math.sin(math.acos(cosine) / 2)
            rank = np.maximum(np.arange(most)[:, None], np.arange(most)[None, :])
            need = np.maximum(need, np.where(same, rank, most - 1).min((1, 2)) + 1)
        worst.append(need)
    return int(np.quantile(np.concatenate(worst), RECALL, method="higher"))


# -- vectors ----------------------------------------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norm; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors (as doubles) of a binary column, by length: their places and the matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    blobs = [x.as_buffer() for x in column]
    size = np.array([x.size for x in blobs], np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(blobs[i] for i in at), kind).reshape(len(at), -1).astype(float)


def _keys(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    salt = mix(np.arange(1, x.shape[1] + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return mix(mix(x.view(U64) ^ salt).sum(1, dtype=U64) + U64(x.shape[1])).view(np.int64)


def _prepared(cells: int, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its id, and of a vector that can link its hash, cell and bytes."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            lists = part["vec"]
            size = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # null lists have no values, null values are nan
            first = np.concatenate([[0], np.cumsum(size)])
            key, cell = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            vec: list[bytes | None] = [None] * len(size)
            for n in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == n)
                x = flat[first[at][:, None] + np.arange(n)] + 0.0  # -0.0 becomes 0.0
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                at, x = at[good], np.ascontiguousarray(x[good])
                if len(at):
                    key[at] = _keys(x)
                    place = np.floor(_unit(x).astype(np.float32) @ _lines(3, n, cells) + 0.37).astype(np.int64)
                    cell[at] = mix((place.view(U64) * mix(np.arange(1, cells + 1, dtype=U64))).sum(1, dtype=U64) + U64(n)).view(np.int64)
                    for i, row in zip(at.tolist(), x.astype(kind)):
                        vec[i] = row.tobytes()
            missing = np.array([v is None for v in vec])
            yield pa.RecordBatch.from_pydict({
                "vec_id": part["vec_id"], "key": pa.array(key, mask=missing), "cell": pa.array(cell, mask=missing), "vec": pa.array(vec, pa.binary()),
            })


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between rows; exact for small ones too."""
    return 2 * np.arctan2(np.sqrt(((a - b) ** 2).sum(1)), np.sqrt(((a + b) ** 2).sum(1)))


def _sums(kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by cell."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            cells, fan = part["cell"].to_numpy(), part["fan"].to_numpy()
            for at, x in _rows(part["vec"], kind):
                name, which = np.unique(cells[at], return_inverse=True)
                order = np.argsort(which, kind="stable")
                total = np.add.reduceat(_unit(x)[order], np.searchsorted(which[order], np.arange(len(name))), axis=0)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(name), "fan": pa.array(np.full(len(name), fan[0])), "total": pa.array([r.tobytes() for r in total], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<f8") for x in table["total"].to_pylist())
    return pa.table({"cell": table["cell"][:1], "fan": table["fan"][:1], "total": pa.array([total.tobytes()], pa.binary())})


def _centred(kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = [np.frombuffer(x.as_buffer(), "<f8") for x in batch["total"]]
        ok = [bool(x.any()) for x in total]
        yield pa.RecordBatch.from_pydict({"cell": batch["cell"].filter(pa.array(ok)), "pivot": pa.array([(x / np.abs(x).max()).astype(kind).tobytes() for x, k in zip(total, ok) if k], pa.binary())})


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between rows; exact for small ones too."""
    return 2 * np.arctan2(np.sqrt(((a - b) ** 2).sum(1)), np.sqrt(((a + b) ** 2).sum(1)))


def _paired(left: pa.Array, right: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and unit vectors of the rows whose two vectors are of one length."""
    sizes = [np.array([x.as_buffer().size for x in column], np.int64) for column in (left, right)]
    same = np.flatnonzero(sizes[0] == sizes[1])
    left, right = left.take(pa.array(same)), right.take(pa.array(same))
    for (at, x), (_, y) in zip(_rows(left, kind), _rows(right, kind)):
        yield same[at], _unit(x), _unit(y)


def _pivoted(reach: float, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ball of each class: its cell's if the centre is near enough, else its own."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            ball, turn = part["key"].to_numpy().copy(), np.zeros(part.num_rows)
            crowded = np.flatnonzero(part["pivot"].is_valid().to_numpy(zero_copy_only=False))
            near = part.take(pa.array(crowded))
            cells = near["cell"].to_numpy()
            for at, x, centre in _paired(near["vec"], near["pivot"], kind):
                angle = _angles(x, centre)
                at, angle = at[angle <= reach], angle[angle <= reach]
                ball[crowded[at]], turn[crowded[at]] = cells[at], angle
            yield pa.RecordBatch.from_pydict({"key": part["key"], "copies": part["copies"], "low": part["low"], "vec": part["vec"], "ball": pa.array(ball), "turn": pa.array(turn)})


# -- lists ------------------------------------------------------------------------------------------


def _fixed(x: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = x.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _entered(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            nodes = part["node"].to_numpy()
            for at, x in _rows(part["vec"], plan.kind):
                unit = _unit(x)
                name, value = plan.lists(unit)
                t = name.shape[1]
                yield pa.RecordBatch.from_pydict({
                    "list": pa.array(name.ravel()), "value": pa.array(value.ravel()), "node": pa.array(np.repeat(nodes[at], t)),
                    "sketch": _fixed(np.repeat(plan.sketch(unit), t, axis=0)),
                })


def _lengths(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many enter each list, by task."""
    names, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            for _, x in _rows(batch["vec"].slice(a, 256), plan.kind):
                name = np.concatenate([names, plan.lists(_unit(x))[0].ravel()])
                names, at = np.unique(name, return_inverse=True)
                count = np.bincount(at, np.concatenate([count, np.ones(len(name) - len(count), np.int64)]), len(names)).astype(np.int64)
                if len(names) > 1 << 20:
                    yield pa.RecordBatch.from_pydict({"list": pa.array(names), "n": pa.array(count)})
                    names, count = names[:0], count[:0]
    if len(names):
        yield pa.RecordBatch.from_pydict({"list": pa.array(names), "n": pa.array(count)})


def _collided(plan: Plan, apart: bool, table: pa.Table) -> pa.Table:
    """Pairs of one sorted list that reach the count, or of two pieces of it; ``apart``: of queries and others only."""
    value, side, nodes = (table[c].to_numpy() for c in ("value", "side", "node"))
    order = np.lexsort((nodes, value, side))
    value, side, nodes = value[order], side[order], nodes[order]
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, COUNTED)[order]
    lines = np.ascontiguousarray(sketch.T)
    split = int(np.searchsorted(side, 1))
    one = split == len(side) and not apart
    rights = value if one else value[split:]
    base = 0 if one else split
    reach, window, width = SLIDE * plan.gap, np.uint8(STEPS + 1), np.uint8(2 * STEPS + 2)
    out = [np.zeros((2, 0), np.int64)]
    for a in range(0, split, 64):
        b = min(split, a + 64)
        low = a if one else base + int(np.searchsorted(rights, value[a] - reach, "left"))
        high = base + int(np.searchsorted(rights, value[b - 1] + reach, "right"))
        if high <= low:
            continue
        count = np.zeros((b - a, high - low), np.uint8)
        away, hit = np.empty_like(count), np.empty(count.shape, bool)
        for j in range(FIRST):
            np.subtract(lines[j, low:high][None, :], (lines[j, a:b] - window)[:, None], out=away)
            np.less_equal(away, width, out=hit)
            count += hit.view(np.uint8)
        i, k = np.nonzero(count >= plan.first)
        total = count[i, k].astype(np.int64)
        i, k = i + a, k + low
        ok = np.abs(value[i] - value[k]) <= reach
        ok &= i < k if one else nodes[i] != nodes[k]
        i, k, total = i[ok], k[ok], total[ok]
        for c in range(0, len(i), 1 << 14):
            x, y = i[c : c + (1 << 14)], k[c : c + (1 << 14)]
            more = (sketch[y, FIRST:] - (sketch[x, FIRST:] - window) <= width).sum(1)
            keep = total[c : c + (1 << 14)] + more >= plan.whole
            out.append(np.stack([nodes[x[keep]], nodes[y[keep]]]))
    pair = np.sort(np.concatenate(out, axis=1), axis=0)
    return pa.table({"a": pa.array(pair[0], pa.int64()), "b": pa.array(pair[1], pa.int64())})


def _near(df: DataFrame, width: int, blob: str | None = None) -> DataFrame:
    """Broadcast a table of a checked size (``width`` bytes a row, and ``blob``'s); beyond it the join is a shuffle."""
    size = df.agg(F.sum(F.lit(width) + (F.octet_length(blob) if blob else F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if size <= SMALL else df


def _lists(vectors: DataFrame, plan: Plan) -> DataFrame:
    return vectors.mapInArrow(partial(_entered, plan), "list long, value float, node long, sketch binary")


def _pieces(vectors: DataFrame, plan: Plan) -> DataFrame:
    """Lists too long for one task, and their pieces."""
    lengths = vectors.mapInArrow(partial(_lengths, plan), "list long, n long").groupBy("list").agg(F.sum("n").alias("n"))
    return checkpointed(lengths.where(F.col("n") > PIECE).select("list", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")))


def _among(vectors: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of ``vectors`` that reach the count."""
    entries, full = _lists(vectors, plan), _pieces(vectors, plan)
    if full.isEmpty():
        dealt = entries.select("*", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"))
    else:
        entries = entries.join(_near(full, 24), "list", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
        dealt = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1)
        dealt = dealt.select("list", "value", "node", "sketch", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"))
    return dealt.groupBy("list", "x", "y").applyInArrow(lambda table: _collided(plan, False, table), "a long, b long")


def _against(queries: DataFrame, vectors: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of one of ``queries`` and one of ``vectors`` (which holds the queries too) that reach the count."""
    full = _near(_pieces(vectors, plan), 24)
    both = []
    for side, of in enumerate((queries, vectors)):
        entries = _lists(of, plan).join(full, "list", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int") if side else F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
        both.append(entries.select("list", "value", "node", "sketch", piece.alias("x"), F.lit(side).alias("side")))
    return both[0].union(both[1]).groupBy("list", "x").applyInArrow(lambda table: _collided(plan, True, table), "a long, b long")


def _judged(threshold: float, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of balls that link in whole (``sure``), and those whose members must be compared."""
    bound = math.acos(threshold)
    for batch in batches:
        r = batch["r_a"].to_numpy() + batch["r_b"].to_numpy()
        sure, open_ = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
        for at, left, right in _paired(batch["v_a"], batch["v_b"], kind):
            angle, single = _angles(left, right), r[at] == 0
            exact = np.einsum("ij,ij->i", left, right) >= threshold
            sure[at] = np.where(single, exact, angle + r[at] <= bound - SLACK)
            open_[at] = ~single & ~sure[at] & (angle - r[at] <= bound + SLACK)
        keep = sure | open_
        yield pa.RecordBatch.from_pydict({"a": batch["a"].filter(pa.array(keep)), "b": batch["b"].filter(pa.array(keep)), "sure": pa.array(sure[keep])})


def _members(threshold: float, kind: str, table: pa.Table) -> pa.Table:
    """Two balls (pieces of them) member by member: links of each member, weighed by copies."""
    side, keys, copies = (table[c].to_numpy() for c in ("side", "key", "copies"))
    (_, vectors), = _rows(table["vec"], kind)  # balls of different lengths never come here
    unit = _unit(vectors)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    links = np.zeros(len(keys), np.int64)
    for a in range(0, len(left), 256):
        linked = unit[left[a : a + 256]] @ unit[right].T >= threshold
        links[left[a : a + 256]] += linked @ copies[right]
        links[right] += copies[left[a : a + 256]] @ linked
    keep = links > 0
    return pa.table({"a": table["a"].take(pa.array(np.flatnonzero(keep))), "b": table["b"].take(pa.array(np.flatnonzero(keep))), "key": pa.array(keys[keep]), "links": pa.array(links[keep])})


def _compared(open_: DataFrame, members: DataFrame, sizes: DataFrame, threshold: float, kind: str) -> DataFrame:
    """``(a, b, key, links)``: the open pairs of balls, in pieces of their members."""
    cut = sizes.select("node", F.ceil(F.col("members") / PIECE).cast("int").alias("pieces"))
    for end in "ab":
        open_ = open_.join(cut.select(F.col("node").alias(end), F.col("pieces").alias(f"pieces_{end}")), end)
    out = None
    for side, (own, other) in enumerate(("ab", "ba")):
        mine = open_.join(members.withColumnRenamed("ball", own), own)
        mine = mine.withColumn(own + "_", F.pmod(F.xxhash64("key"), F.col(f"pieces_{own}")).cast("int"))
        mine = mine.withColumn(other + "_", F.explode(F.sequence(F.lit(0), F.col(f"pieces_{other}") - 1)))
        mine = mine.select("a", "b", "a_", "b_", "key", "copies", "vec", F.lit(side).alias("side"))
        out = mine if out is None else out.unionByName(mine)
    return out.groupBy("a", "b", "a_", "b_").applyInArrow(lambda table: _members(threshold, kind, table), "a long, b long, key long, links long")


def embedding_components(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row for each row of ``vectors``.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, and
    are their own component; vectors of different lengths never link. Rows are vectors of their own,
    whatever their ids: rows with equal vectors link with each other, and rows with one id and
    different vectors are judged apart. ``n_links`` counts rows. A row with a null id counts as a link;
    the smallest id of a component is taken over the others (null if there is none). ``kept`` says that
    the row has the component's id. Norms are scaled, so no finite vector overflows or vanishes. Other
    columns are ignored; an empty table gives an empty result.
    """
    kind = "<f4" if "array<float>" == dict(vectors.dtypes)[embedding] else "<f8"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if kind == "<f4" else "array<double>").alias("vec"))
    cells = max(8, math.ceil(math.log2(max(2, rows.count())) / 2))
    rows = written(rows.mapInArrow(partial(_prepared, cells, kind), "vec_id long, key long, cell long, vec binary"))
    theta = math.acos(threshold)

    known = rows.where("key is not null")
    sized = known.groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    crowded = known.groupBy("cell").agg(F.count("*").alias("n"), F.min("key").alias("x"), F.max("key").alias("y"))
    crowded = checkpointed(crowded.where((F.col("n") >= CROWD) & (F.col("x") < F.col("y"))).select("cell"))
    sums = known.join(_near(crowded, 16), "cell", "left_semi").select("cell", "vec", F.pmod(F.spark_partition_id(), F.lit(64)).alias("fan"))
    sums = sums.mapInArrow(partial(_sums, kind), _TOTALS).groupBy("cell", "fan").applyInArrow(_added, _TOTALS).groupBy("cell").applyInArrow(_added, _TOTALS)
    pivots = written(sums.mapInArrow(partial(_centred, kind), "cell long, pivot binary"))
    classes = known.dropDuplicates(["key"]).select("key", "cell", "vec").join(sized, "key")
    members = classes.join(_near(pivots, 64, "pivot"), "cell", "left").select("key", "cell", "copies", "low", "vec", "pivot")
    members = written(members.mapInArrow(partial(_pivoted, theta / 4, kind), "key long, copies long, low long, vec binary, ball long, turn double"))
    balls = members.groupBy(F.col("ball").alias("node")).agg(F.sum("copies").alias("weight"), F.count("*").alias("members"), F.max("turn").alias("radius"), F.min("low").alias("low"))
    balls = checkpointed(balls)
    n, n_balls, radius = balls.agg(F.count("*"), F.count_if(F.col("radius") > 0), F.coalesce(F.max("radius"), F.lit(0.0))).first()
    single = members.where("key = ball").select(F.col("key").alias("node"), "vec")
    pairs = _among(single, Plan(n, theta, kind))
    centres = single
    if n > single.count():
        round_ = pivots.select(F.col("cell").alias("node"), F.col("pivot").alias("vec")).join(_near(balls.select("node"), 16), "node", "left_semi")
        round_ = written(round_)
        centres = single.union(round_)
        pairs = pairs.union(_against(round_, centres, Plan(4 * n_balls, theta + 2 * radius, kind)))
    pairs = checkpointed(pairs.distinct())
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    some = written(centres.join(_near(checkpointed(ends), 16), "node", "left_semi").join(balls.select("node", "radius"), "node"))
    both = pairs
    for end in "ab":
        both = both.join(some.select(F.col("node").alias(end), F.col("vec").alias(f"v_{end}"), F.col("radius").alias(f"r_{end}")), end)
    judged = checkpointed(both.select("a", "b", "v_a", "v_b", "r_a", "r_b").mapInArrow(partial(_judged, threshold, kind), "a long, b long, sure boolean"))
    links = judged.where("sure").select("a", "b")
    degree = _degrees(links, balls.select("node", "weight"))
    open_ = judged.where("not sure").select("a", "b")
    of_member = None
    if not open_.isEmpty():
        found = checkpointed(_compared(open_, members.select("ball", "key", "copies", "vec"), balls, threshold, kind))
        links = links.union(found.select("a", "b").distinct())
        of_member = found.groupBy("key").agg(F.sum("links").alias("more"))

    joined = components(links)
    of_ball = balls.join(degree, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_ball = checkpointed(of_ball.select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component", "low"))
    least = of_ball.groupBy("component").agg(F.min("low").alias("component_id"))
    of_ball = of_ball.join(least, "component").select(F.col("node").alias("ball"), "n_links", "component_id")
    of_key = members.select("key", "ball").join(of_ball, "ball")
    if of_member is not None:
        of_key = of_key.join(of_member, "key", "left").withColumn("n_links", F.col("n_links") + F.coalesce("more", F.lit(0)))
    out = rows.select("vec_id", "key").join(of_key.select("key", "n_links", "component_id", F.lit(True).alias("known")), "key", "left")
    component: Column = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _degrees(links: DataFrame, weights: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    return both.join(weights.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("links"))
