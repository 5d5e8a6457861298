"""N-gram Jaccard join by universe-partition pigeonhole.

The universe of shingles is partitioned by hash. Sets fall into size bands; band ``k`` has ``m_k``
segments of about four shingles. Two sets with Jaccard >= t differ in at most
``H = (1-t)/(1+t) * (|r|+|s|)`` shingles. A probe gives each segment 0, 1 or 2 units: skip it, match
it exactly, or match it within one deletion. When the units exceed ``H``, some segment must match,
so no link is lost. Units go to segments by cost (signatures emitted and matches expected by segment
length; empty and one-shingle segments come last). Candidates are then verified on whole sets.

Before that the universe is reduced, still without loss: a document of whose shingles less than a share
of t occur in another set has no partner. Shingles that very many sets hold are told beforehand, by tasks
that see them in several sets; they only count for their sets and aren't dealt out. Copies of one set stand as one class throughout, signatures
shared by many sets link to one centre first, and only those whose members are still in different
components are compared further, so groups of copies don't expand into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import blocks
from panelforge.llm.graph import components
from panelforge.llm.store import checkpointed, partitions, written
from panelforge.llm.text import U64, mix, shingles, slices

WORDS, NUM, DEN = 5, 75, 100
#: Members of a signature up to which all its pairs are candidates at once.
SMALL = 24
INDEX, RESIDUE, PROBE, PROBE_NEAR, PROBE_RESIDUE = range(5)
#: Members that one task compares at once; a larger signature is split into pairs of pieces.
PIECE = 2048
#: Signatures that a member carries along.
FIRST = 8
#: Hashes per part of an exchange.
PART = 1_000_000
#: Sets of one task that make a shingle hot, hot shingles (8 bytes each) that are broadcast, and shingles a task keeps count of.
HOT, HOTTEST, COUNTED = 64, 1 << 20, 1 << 18


def bands(limit: int = 1 << 40) -> np.ndarray:
    """Upper sizes of the bands; the next is the largest size that can link with this one's."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * DEN // NUM))
    return np.array(out, np.int64)


BANDS = bands()


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[U64(0)], np.cumsum(values, dtype=U64)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return total[at[1:]] - total[at[:-1]]


class Frequent:
    """How many sets held a shingle, for those that two sets of one slice held; where these get too many, the rarest are forgotten."""

    def __init__(self) -> None:
        self.values, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, n: np.ndarray, keys: np.ndarray) -> None:
        """Count a slice: each document's distinct shingles, how many it has, and its set's key (copies of a set count once)."""
        first = np.zeros(len(n), bool)
        first[np.unique(keys, return_index=True)[1]] = True
        found = np.sort(values[np.repeat(first, n)])
        start, length = blocks.runs(found)
        values = np.concatenate([self.values, found[start[length > 1]]])
        counts = np.concatenate([self.counts, length[length > 1]])
        order = np.argsort(values, kind="stable")
        start, _ = blocks.runs(values[order])
        self.values = values[order][start]
        self.counts = np.add.reduceat(counts[order], start) if len(start) else counts
        if len(self.values) > COUNTED:
            keep = np.sort(np.argsort(-self.counts, kind="stable")[: COUNTED // 2])
            self.values, self.counts = self.values[keep], self.counts[keep]


_CLASSES = "doc_id long, key long, n_shingles long, k1 long, k2 long"


def _classes(k: int, hot: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and keys of each row's set; rows of size -1 tell this task's hot shingles (``k1``) and their sets (``k2``)."""
    names, frequent = ["doc_id", "key", "n_shingles", "k1", "k2"], Frequent()
    for batch in batches:
        for a, b, data, offsets in slices(batch["text"]):
            values, n = shingles(data, offsets, k)
            keys = [_sums(mix(values ^ U64(salt)), n).view(np.int64) for salt in (0, 0x5851F42D4C957F2D)]
            frequent.add(values, n, keys[0])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["key"].slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1])], names)
    at = frequent.counts >= hot
    values, counts = frequent.values[at], frequent.counts[at]
    none = pa.nulls(len(values), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(values), -1)), pa.array(values.view(np.int64)), pa.array(counts)], names)


def _universe(k: int, parts: int, hot: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sets' shingles; of the hot ones only how many a set has, as a block without hashes."""
    known = np.frombuffer(hot.value, "<u8")
    for batch in batches:
        for _, _, data, offsets in slices(batch["text"]):
            values, n = shingles(data, offsets, k)
            if not len(values):
                continue
            keys = _sums(mix(values), n).view(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            if len(known):
                sure = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
                count = np.bincount(owner[sure], minlength=len(n))
                some = np.flatnonzero(count)
                # by hash of the set, so that its copies meet
                yield blocks.count_rows(keys[some], count[some], mix(keys[some].view(U64)), parts)
                values, owner = values[~sure], owner[~sure]
            yield blocks.block_rows(values, owner, keys, parts)


def _shared(table: pa.Table) -> pa.Table:
    """For each set, how many of its shingles of this part occur in another set; and, told apart, how many hot ones it has."""
    plain = pa.compute.greater(pa.compute.binary_length(table["tails"]), 0)
    sure, told = blocks.count_values(table.filter(pa.compute.invert(plain)))
    sure, first = np.unique(sure, return_index=True)
    values, owner = blocks.block_values(table.filter(plain))
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    start, length = blocks.runs(values)
    many = np.zeros(len(start), bool)
    if len(start):
        many = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
    keep = np.repeat(many, length)
    values, owner = values[keep], owner[keep]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner = owner[new]
    start, length = blocks.runs(owner)
    return pa.table({"k1": pa.array(np.concatenate([owner[start], sure]), pa.int64()), "shared": pa.array(np.concatenate([length, told[first]]), pa.int64())})


#: Cost of the first and the second unit by a segment's length.
_LENGTH = np.arange(64.0)
COST = np.stack([1 + 64 / 4**_LENGTH, _LENGTH + 64 / 4 ** np.maximum(_LENGTH - 1, 0)])
COST[:, 0] = 1e3, 2e3
COST[1, 1] = 1.5e3


def _segments(values: np.ndarray, n: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, ...]:
    """Partition each set into its band's segments: of each shingle its segment; of each segment its owner, salt, content and length."""
    m = (BANDS[band] + 3) // 4
    base = np.concatenate([[0], np.cumsum(m)])
    salt = mix(band.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(7))
    own = np.repeat(np.arange(len(n)), n)
    mixed = mix(values ^ salt[own])
    seg = base[own] + (((mixed >> U64(32)) * m.astype(U64)[own]) >> U64(32)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    length = np.bincount(seg, minlength=base[-1])
    content = _sums(mixed[order], length)
    who = np.repeat(np.arange(len(n)), m)
    place = np.arange(base[-1]) - base[who]
    tag = mix(salt[who] + place.astype(U64) * U64(0xD6E8FEB86659FD93))
    return mixed, seg, who, tag, content, length


def _signatures(parts: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in slices(batch["text"], 1 << 18):
            values, n = shingles(data, offsets, k)
            if not len(values):
                continue
            keys, kept = _sums(mix(values), n).view(np.int64)[n > 0], n[n > 0]
            band = np.searchsorted(BANDS, kept)
            out: list[tuple[np.ndarray, np.ndarray, int]] = []
            mixed, seg, who, tag, content, length = _segments(values, kept, band)
            out.append((mix(content + tag), who, INDEX))
            out.append((mix(content[seg] - mixed + tag[seg]), who[seg], RESIDUE))
            _probe(out, mixed, seg, who, tag, content, length, 2 * kept * (DEN - NUM) // (DEN + NUM) + 1, np.arange(len(kept)))
            low = np.flatnonzero((band > 0) & (BANDS[np.maximum(band - 1, 0)] * DEN >= kept * NUM))
            if len(low):
                pick = np.repeat(np.isin(np.arange(len(kept)), low), kept)
                need = (kept[low] + BANDS[band[low] - 1]) * (DEN - NUM) // (DEN + NUM) + 1
                _probe(out, *_segments(values[pick], kept[low], band[low] - 1), need, low)
            sig = np.concatenate([x[0] for x in out])
            own = np.concatenate([x[1] for x in out])
            kind = np.concatenate([np.full(len(x[0]), x[2]) for x in out])
            order = np.argsort(own * 8 + kind, kind="stable")
            sig, run = sig[order], (own * 8 + kind)[order]
            names = np.arange(len(kept) * 8)
            yield _named(blocks.block_rows(sig, run, names, parts), keys, kept)


def _named(rows: pa.RecordBatch, keys: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Put document, size and kind in place of the slice's own numbers."""
    owners, sizes = [], []
    for x in rows["owners"].to_pylist():
        run = np.frombuffer(x, "<i8")
        owners.append(keys[run // 8].astype("<i8").tobytes())
        sizes.append((size[run // 8] * 8 + run % 8).astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([rows["part"], pa.array(owners, pa.binary()), rows["counts"], rows["tails"], pa.array(sizes, pa.binary())], ["part", "owners", "counts", "tails", "sizes"])


def _probe(out: list, mixed: np.ndarray, seg: np.ndarray, who: np.ndarray, tag: np.ndarray, content: np.ndarray, length: np.ndarray, need: np.ndarray, names: np.ndarray) -> None:
    """Give out each set's units, cheapest first, and add the probes they ask for."""
    n_seg = len(who)
    cost = COST[:, np.minimum(length, 63)].ravel()
    owner = np.concatenate([who, who])
    order = np.lexsort((cost, owner))
    rank = np.arange(2 * n_seg) - np.searchsorted(owner[order], np.arange(len(names)))[owner[order]]
    chosen = np.zeros(2 * n_seg, bool)
    chosen[order] = rank < need[owner[order]]
    near = chosen[n_seg:]
    exact = chosen[:n_seg] & ~near
    out.append((mix(content + tag)[exact], names[who[exact]], PROBE))
    out.append((mix(content + tag)[near], names[who[near]], PROBE_NEAR))
    of = near[seg]
    out.append((mix(content[seg] - mixed + tag[seg])[of], names[who[seg[of]]], PROBE_RESIDUE))


def _fits(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return DEN * np.minimum(n_a, n_b) >= NUM * np.maximum(n_a, n_b)


def _matched(table: pa.Table) -> pa.Table:
    """Candidate pairs of one part; members of signatures shared by many go out as a list too."""
    keys = np.frombuffer(b"".join(table["owners"].to_pylist()), "<i8")
    sizes = np.frombuffer(b"".join(table["sizes"].to_pylist()), "<i8")
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4")
    tails = blocks.unpacked(b"".join(table["tails"].to_pylist()))
    doc, size, kind = (np.repeat(x, counts) for x in (keys, sizes // 8, sizes % 8))
    order = np.argsort(tails)
    tails, doc, size, kind = tails[order], doc[order], size[order], kind[order]
    start, length = blocks.runs(tails)
    group = np.repeat(np.arange(len(start)), length)
    many = np.zeros(len(start), bool)
    if len(start):
        many = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        for kinds in ((kind <= RESIDUE), (kind >= PROBE)):
            many &= np.logical_or.reduceat(kinds, start)
    keep = many[group]
    doc, size, kind, group = doc[keep], size[keep], kind[keep], group[keep]
    start, length = blocks.runs(group)
    pairs: list[np.ndarray] = []
    hot: list[np.ndarray] = []
    for s, n in zip(start, length):
        d, z, q = doc[s : s + n], size[s : s + n], kind[s : s + n]
        if n <= SMALL:
            left, right = np.nonzero((q >= PROBE)[:, None] & (q <= RESIDUE)[None, :] & (d[:, None] != d[None, :]))
            ok = ((q[right] == INDEX) | (q[left] == PROBE_NEAR)) & (z[right] <= z[left]) & _fits(z[left], z[right])
            pairs.append(np.stack([d[left[ok]], d[right[ok]], z[left[ok]], z[right[ok]]]))
        else:
            d, first = np.unique(d, return_index=True)
            z = z[first]
            ok = (d != d[0]) & _fits(z, np.full(len(z), z[0]))
            pairs.append(np.stack([d[ok], np.full(ok.sum(), d[0]), z[ok], np.full(ok.sum(), z[0])]))
            hot.append(np.stack([np.full(len(d), group[s], np.int64), d, z]))
    x = np.concatenate(pairs, axis=1) if pairs else np.zeros((4, 0), np.int64)
    swap = x[0] > x[1]
    x = np.where(swap, x[[1, 0, 3, 2]], x)
    x = np.unique(x, axis=1)
    y = np.concatenate(hot, axis=1) if hot else np.zeros((3, 0), np.int64)
    part = table["part"][0].as_py() if len(table) else 0
    n, k = x.shape[1], y.shape[1]
    return pa.table({
        "a": pa.array(np.concatenate([x[0], y[1]]), pa.int64()),
        "b": pa.array(np.concatenate([x[1], np.zeros(k, np.int64)]), pa.int64()),
        "n_a": pa.array(np.concatenate([x[2], y[2]]), pa.int64()),
        "n_b": pa.array(np.concatenate([x[3], np.zeros(k, np.int64)]), pa.int64()),
        "sig": pa.array(np.concatenate([np.full(n, -1), y[0]]), pa.int64()),
        "part": pa.array(np.full(n + k, part), pa.int32()),
    })


def _sketch(values: np.ndarray) -> bytes:
    """Parity bitmap of a set, of two to four bits a shingle; it folds by halves to smaller ones."""
    bits = 64
    while bits < 2 * len(values):
        bits *= 2
    odd = np.bincount((values & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _crossing(best: bool, table: pa.Table) -> pa.Table:
    """Pairs of a signature's members that are in different components and can still link; or the likeliest pair of each two components.

    Sets that link differ in few shingles, and the bitmaps differ in no more bits than the sets in
    shingles. This drops no pair that links; only what is left is verified on whole sets.
    """
    order = np.lexsort((table["component"].to_numpy(), table["side"].to_numpy()))
    node, n, comp, side = (table[c].to_numpy()[order] for c in ("a", "n_a", "component", "side"))
    maps = [np.frombuffer(x, "<u8") for x in table["sketch"].take(pa.array(order)).to_pylist()]
    width = min((len(x) for x in maps), default=1)
    folded = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in maps]) if maps else np.zeros((0, 1), U64)
    split = int(np.searchsorted(side, 1))
    ids = table["ids"].combine_chunks()
    ids, mine = None if best else [ids[int(i)].values.to_numpy() for i in order], table["id"][0].as_py() if len(order) else 0
    out = []
    for i in range(split):
        # within one piece each pair once, by component; between two pieces all of the other's
        at = np.arange(np.searchsorted(comp[:split], comp[i], "right"), split) if split == len(node) else split + np.flatnonzero(comp[split:] != comp[i])
        differ = np.bitwise_count(folded[at] ^ folded[i]).sum(1)
        ok = _fits(n[at], n[i]) & (differ * (DEN + NUM) <= (DEN - NUM) * (n[at] + n[i]))
        if not best:
            ok[ok] = [not len(x) or x[0] >= mine for x in (np.intersect1d(ids[i], ids[j], assume_unique=True) for j in at[ok])]
        gap, at = differ[ok] / (n[at[ok]] + n[i]), at[ok]
        out.append(np.stack([np.full(len(at), node[i]), node[at], np.full(len(at), comp[i]), comp[at], (gap * 1e9).astype(np.int64)]))
    x = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
    if best and x.shape[1]:
        x = x[:, np.lexsort((x[4], x[3], x[2]))]
        x = x[:, np.concatenate([[True], (np.diff(x[2]) != 0) | (np.diff(x[3]) != 0)])]
    x = np.sort(x[:2], axis=0)
    return pa.table({"a": pa.array(x[0], pa.int64()), "b": pa.array(x[1], pa.int64())})


def _likeliest(table: pa.Table) -> pa.Table:
    return _crossing(True, table)


def _remaining(table: pa.Table) -> pa.Table:
    return _crossing(False, table)


def _sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in slices(batch["text"]):
            values, n = shingles(data, offsets, k)
            at = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_pydict({
                "set": pa.array(_sums(mix(values), n).view(np.int64)),
                "grams": pa.array([values[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary()),
                "sketch": pa.array([_sketch(values[x:y]) for x, y in zip(at, at[1:])], pa.binary()),
            })


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["left"], batch["right"]):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(DEN * common >= NUM * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets link, compared whole."""
    left = pairs.join(sets.select(F.col("set").alias("a"), F.col("grams").alias("left")), "a")
    both = left.join(sets.select(F.col("set").alias("b"), F.col("grams").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(_verified, "a long, b long")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, key, component)`` for each row of ``docs``.

    Null or empty texts and texts without words have 0 shingles and are their own component; a text
    of fewer than ``k`` words is one shingle, so it links with equal sequences only. Rows are judged by
    their own texts, whatever their ids: repeated ids keep a row each. ``component_id`` is the smallest id
    of the component (null ids don't count; null without any other). ``key`` is a hash of id and text,
    ``component`` one of the component (null without shingles). Other columns are ignored. Shingles that ``hot`` sets
    of a task hold are counted apart; that changes what is shuffled, not the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    sized = written(keyed.mapInArrow(partial(_classes, k, hot), _CLASSES))
    # tasks saw these in two sets at least, so they need no proof; those beyond the broadcast go the ordinary way
    most = sized.where("n_shingles < 0").groupBy("k1").agg(F.sum("k2").alias("n")).orderBy(F.desc("n"), "k1").limit(HOTTEST)
    known = np.sort(most.select("k1").toArrow()["k1"].to_numpy().view(U64))
    known = spark.sparkContext.broadcast(known.astype("<u8").tobytes())
    sized = sized.where("n_shingles >= 0")
    total = sized.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(max(4 * partitions(spark), total // PART + 1))

    # a class is a set, told by its hash k1; one of its rows brings the text
    classes = sized.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("key").alias("rep"), F.min("doc_id").alias("least"))
    shared = (
        rows.mapInArrow(partial(_universe, k, parts, known), blocks.SCHEMA)
        .groupBy("part").applyInArrow(_shared, "k1 long, shared long")
        .groupBy("k1").agg(F.sum("shared").alias("shared"))
    )
    near = checkpointed(classes.join(shared, "k1").where(F.col("shared") * DEN >= F.col("n_shingles") * NUM).select(F.col("rep").alias("key"), "n_shingles"))
    left, left_total = near.agg(F.count("*"), F.sum("n_shingles")).first()
    texts = written(keyed.join(_sized(near.select("key"), left), "key", "left_semi").dropDuplicates(["key"]).select("text"))

    parts = int(max(4 * partitions(spark), 3 * (left_total or 0) // PART + 1))
    found = written(
        texts.mapInArrow(partial(_signatures, parts, k), blocks.SCHEMA + ", sizes binary")
        .groupBy("part").applyInArrow(_matched, "a long, b long, n_a long, n_b long, sig long, part int")
    )
    sets = written(texts.mapInArrow(partial(_sets, k), "set long, grams binary, sketch binary"))
    tried = found.where("sig < 0").select("a", "b").distinct()
    links = checkpointed(_links(tried, sets))
    # signatures of many members: join what components the likeliest pairs join, then try all that is left
    hot = found.where("sig >= 0").select("part", "sig", "a", "n_a")
    sketches = sets.select(F.col("set").alias("a"), "sketch")
    for best in () if hot.isEmpty() else (True, False):
        of = written(hot.join(components(links).withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a")))
        open_ = of.groupBy("part", "sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).where("x < y").select("part", "sig", "pieces")
        of = written(of.join(open_, ["part", "sig"]).withColumn("id", F.shiftleft(F.col("part").cast("long"), 40).bitwiseOR(F.col("sig"))))
        # the first few signatures of each member: a pair needn't go out again where both have an earlier one
        first = of.groupBy("a").agg(F.slice(F.sort_array(F.collect_set("id")), 1, FIRST).alias("ids"))
        of = of.join(first.join(sketches, "a"), "a").withColumn("own", F.pmod(F.xxhash64("a"), F.col("pieces")).cast("int"))
        of = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        of = of.select("part", "sig", "a", "n_a", "sketch", "component", "id", "ids", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
        more = of.groupBy("part", "sig", "x", "y").applyInArrow(_likeliest if best else _remaining, "a long, b long")
        more = checkpointed(more.distinct().join(tried, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            tried, links = tried.unionAll(more), links.unionAll(checkpointed(_links(more, sets)))
    joined = components(links)

    linked = checkpointed(joined.withColumnRenamed("node", "k1").join(classes.select("k1", "least"), "k1"))
    linked = linked.join(linked.groupBy("component").agg(F.min("least").alias("first")), "component").select("k1", "component", "first")
    of_class = classes.join(linked, "k1", "left")
    of_class = of_class.select("k1", "k2", "n_shingles", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"), F.coalesce("component", "k1").alias("component"))
    out = sized.where("n_shingles > 0").join(of_class, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", "component_id", "key", "component")
    return out.unionAll(sized.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "key", F.lit(None).cast("long")))


def _sized(ids: DataFrame, count: int) -> DataFrame:
    """Broadcast a list of ids up to a checked size (32 MB); beyond it the join is an ordinary shuffle."""
    return F.broadcast(ids) if count * 16 <= 32 << 20 else ids
