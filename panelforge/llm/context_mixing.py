"""Language-model scores by online logistic context mixing.

Bytes are predicted bit by bit. Predictors of several orders count (context, bits so far) in the
training texts; their stretched probabilities are combined by weights that a gate (bits so far, and how
often the longest context was seen) selects; an adaptive map then refines the result. Counts and the
map cover all training texts. The weights are learned online, bit after bit, from all byte occurrences
of the training texts, with each one's own occurrence left out of its counts. Up to ``LEARN`` occurrences are one
stream, learned in hash order. Of more, each part learns where its counts are: a sextuple of n occurrences comes in visits of equal weight,
as many as n is times the part's mean; the visits are dealt by hash into streams of about ``LEARN``, and all streams' weights
are averaged, each gate's by the occurrences that passed it. Neither partitions nor the order of rows change
a score. The weights are fixed while scoring. (``share`` below 1 draws that share by hash instead.)
The texts come in as sextuples (five bytes of context and the next) with their counts in the training
texts, dealt out by the last two bytes of context, into parts whose number only the corpus decides. A part so holds every sextuple that its contexts of
two or more bytes need, and counts them exactly; single bytes of context have one table of 65536 numbers.

Each distinct sextuple is scored once, in its part. Those of a share of at least 1/2097152 of all bytes
(so at most 2097152 of them) are looked up in a broadcast table, the others are dealt out by hash and joined.
The unigram base score counts words exactly: words of a share of at least 1/65536 of all tokens (so
at most 65536 of them) are looked up in a broadcast list, the others are dealt out by hash and joined
with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import blocks
from panelforge.llm.store import partitions, written
from panelforge.llm.text import LOWER, U64, counts_of, mix, slices, spans, word_hashes

ORDERS = (1, 2, 3, 5)
GRAM_HEAD, GRAM_BITS = 1 << 21, 22
GATES, STEPS = 3, 24
#: The share of byte occurrences that the weights are learned from: all.
SHARE = 1.0
#: Byte occurrences of a stream, about; how many are one step; passes over them; step size.
LEARN, TOGETHER, PASSES, RATE = 1 << 17, 256, 2, 0.02
#: Rounds over all occurrences, if parts learn by themselves; each starts from the mean of the last.
ROUNDS = 3
#: Bytes of text for a part of the counts, and the parts of sextuples at least.
PART, PARTS = 16 << 20, 64
HEAD = 65536
#: Groups in which the streams' weights are added up before all are.
FAN = 256
_GATHER = 400_000
END = mix(np.array([0x454E44], U64))[0]


def sextuples(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, it and the five before it in its document (zeros before the start)."""
    place = np.arange(len(data), dtype=np.int32) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.int32)
    out = data.astype(U64)
    for j in range(1, 6):
        before = np.zeros(len(data), U64)
        before[j:] = data[:-j] if len(data) > j else 0
        before[place < j] = 0
        out |= before << U64(8 * j)
    return out


def merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    start, _ = blocks.runs(values[order])
    return values[order][start], np.add.reduceat(counts[order], start) if len(start) else counts[:0]


class Tally:
    """Counts of 64-bit values in bounded memory; what is full goes out."""

    def __init__(self, limit: int = _GATHER) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, limit

    def add(self, values: np.ndarray, times: int = 1) -> None:
        values = np.sort(values)
        start, length = blocks.runs(values)
        self.parts.append((values[start], length * times))
        self.size += len(start)
        if self.size > 4 * self.limit:
            self.parts = [self.take()]
            self.size = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        out = merged(np.concatenate([x for x, _ in self.parts]), np.concatenate([n for _, n in self.parts]))
        self.parts, self.size = [], 0
        return out


def _tally_rows(tally: Tally, parts: int, whole: bool) -> Iterator[pa.RecordBatch]:
    values, counts = tally.take()
    if len(values):
        part = blocks.parts_of(mix((values >> U64(8)) & U64(0xFFFF)) if whole else values, parts)
        order = np.argsort(part, kind="stable")
        names, cut = np.unique(part[order], return_index=True)
        cuts = np.append(cut, len(order))
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(names.astype(np.int32)),
            "vals": pa.array([blocks.packed(values[order[a:b]], 6 if whole else 8) for a, b in zip(cuts, cuts[1:])], pa.binary()),
            "counts": pa.array([counts[order[a:b]].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
        })


def _gather(parts: int, what: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()
    for batch in batches:
        for a, b, data, offsets in slices(batch["text"]):
            if what == "bytes":
                grams = sextuples(data, offsets)
                held = np.repeat(batch["held_out"].slice(a, b - a).to_numpy(zero_copy_only=False), np.diff(offsets))
                tally.add(grams[~held])
                tally.add(grams[held], 0)
            else:
                data = LOWER[data]
                starts, ends, _ = spans(data, offsets)
                tally.add(np.concatenate([word_hashes(data, starts, ends), np.full(b - a, END)]))
            if tally.size > 4 * tally.limit:
                yield from _tally_rows(tally, parts, what == "bytes")
    yield from _tally_rows(tally, parts, what == "bytes")


def _summed(width: int, table: pa.Table) -> pa.Table:
    values = blocks.unpacked(b"".join(table["vals"].to_pylist()), width)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4").astype(np.int64)
    values, counts = merged(values, counts)
    return pa.table({
        "part": table["part"][:1].cast(pa.int32()),
        "vals": pa.array([values.tobytes()], pa.binary()), "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary()),
        "n": pa.array([int(counts.sum())]), "v": pa.array([len(values)]),
    })


# -- the model ---------------------------------------------------------------------------------------


def _steps(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bits so far (with a leading one) and the bit, for each of a byte's eight bits."""
    byte = (key & U64(255)).astype(np.int64)
    for d in range(8):
        yield (1 << d) | (byte >> (8 - d)), (byte >> (7 - d)) & 1


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by the last two bytes of the sextuples, for contexts of one byte."""
    for batch in batches:
        for key, n in _part_rows(batch):
            pair, n = merged(key & U64(0xFFFF), n)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pair.astype(np.int32)), "n": pa.array(n)})


def _part_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for vals, counts in zip(batch["vals"], batch["counts"]):
        yield np.frombuffer(vals.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<i8")


def _sum_floats(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<f8") for x in table["data"].to_pylist())
    return pa.table({"i": table["i"][:1], "data": pa.array([total.astype("<f8").tobytes()], pa.binary())})


class Counts:
    """How often the contexts of one part went on with some bits in the training texts."""

    def __init__(self, single: np.ndarray, key: np.ndarray, n: np.ndarray) -> None:
        self.single = np.concatenate([[0], np.cumsum(single)])
        self.longer = []
        for order in ORDERS[1:]:
            own, total = merged(self._own(key, order), n)
            self.longer.append((own, np.concatenate([[0], np.cumsum(total)])))

    @staticmethod
    def _own(key: np.ndarray, order: int) -> np.ndarray:
        return key & U64((1 << 8 * (order + 1)) - 1)

    def paths(self, key: np.ndarray) -> np.ndarray:
        """Occurrences by order, number of bits and sextuple: of its context with the byte's first bits."""
        out = np.empty((len(ORDERS), 9, len(key)), np.int64)
        for o, order in enumerate(ORDERS):
            own = self._own(key, order)
            for d in range(9):
                low = (own >> U64(8 - d)) << U64(8 - d)
                high = low + U64(1 << (8 - d))
                if order == 1:
                    out[o, d] = self.single[high.astype(np.int64)] - self.single[low.astype(np.int64)]
                else:
                    known, total = self.longer[o - 1]
                    out[o, d] = total[np.searchsorted(known, high)] - total[np.searchsorted(known, low)]
        return out


def _inputs(paths: np.ndarray, d: int, node: np.ndarray, bit: np.ndarray, without: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions (and a bias) of bit ``d`` and the gate; ``without``: without its own occurrence."""
    x = np.empty((len(bit), len(ORDERS) + 1))
    x[:, -1] = 0.3
    for o in range(len(ORDERS)):
        same = paths[o, d + 1]
        other = paths[o, d] - same
        same = np.maximum(same - 1, 0) if without else same
        x[:, o] = np.log((same + 0.4) / (other + 0.4)) * (2 * bit - 1)
        seen = same + other
    return x, node * GATES + (seen > 0) + (seen > 8)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _drawn(single: np.ndarray, rate: float, streams: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sextuples drawn to learn from, by stream: how often each is drawn, and its paths."""
    for batch in batches:
        for keys, n in _part_rows(batch):
            chance = (mix(keys + U64(1)) >> U64(11)).astype(float) / float(1 << 53)
            times = np.floor(n * rate + chance).astype(np.int64)
            at = np.flatnonzero(times)
            if not len(at):
                continue
            paths = np.moveaxis(Counts(single, keys, n).paths(keys[at]), 2, 0).astype("<i8")
            stream = (mix(keys[at] + U64(2)) % U64(streams)).astype(np.int64)
            order = np.argsort(stream, kind="stable")
            names, cut = np.unique(stream[order], return_index=True)
            takes = [order[a:b] for a, b in zip(cut, np.append(cut[1:], len(order)))]
            yield pa.RecordBatch.from_pydict({"stream": pa.array(names), "vals": pa.array([keys[at[x]].tobytes() for x in takes], pa.binary()), "times": pa.array([times[at[x]].tobytes() for x in takes], pa.binary()), "paths": pa.array([paths[x].tobytes() for x in takes], pa.binary())})


def _stream_weights(table: pa.Table) -> pa.Table:
    """A stream's occurrences, and its weights times these."""
    keys, times, paths = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("vals", "<u8"), ("times", "<i8"), ("paths", "<i8")))
    weights = learned(keys, times, np.moveaxis(paths.reshape(-1, len(ORDERS), 9), 0, 2))
    mass = float(times.sum())
    return pa.table({"i": pa.array([int(table["stream"][0].as_py()) % FAN], pa.int32()), "data": pa.array([np.append(weights.ravel() * mass, mass).astype("<f8").tobytes()], pa.binary())})


def _visits(keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sextuples with their occurrences, by stream: places of the keys (ascending), their visits' hashes and weights.

    A visit weighs at most 1 (the mean count), so frequent sextuples come often and no step is longer than one of single occurrences.
    """
    mean = n.sum() / len(n)
    often = np.ceil(n / mean).astype(np.int64)
    streams = max(1, round(int(often.sum()) / LEARN))
    at = np.repeat(np.arange(len(keys), dtype=np.int32), often)
    start = np.cumsum(often) - often
    stream = (((mix(keys + U64(2)) % U64(streams)).astype(np.int64)[at] + np.arange(len(at)) - start[at]) % streams).astype(np.int32)  # in turn, from one that the hash names
    order = np.argsort(stream, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(stream[order])) + 1):
        x = at[own]
        yield x, mix(mix(keys[x]) + (own - start[x]).astype(U64)), (n / mean / often)[x]


def _part_weights(single: np.ndarray, start: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all training occurrences of the parts: by gate the streams' weights times the occurrences that passed it, and these."""
    total = np.zeros((256 * GATES, len(ORDERS) + 2))
    for batch in batches:
        for keys, n in _part_rows(batch):
            table = Counts(single, keys, n)
            keys, n = keys[n > 0], n[n > 0]
            for at, order, weight in _visits(keys, n) if len(keys) else ():
                own, place = np.unique(at, return_inverse=True)
                seen = _bits(keys[own], table.paths(keys[own]))
                order = np.argsort(order)
                weights = _taught(start, place[order], weight[order], seen)
                count = np.bincount(place, weight) * (n.sum() / len(n))
                mass = np.bincount(seen[1].ravel(), np.repeat(count, 8), minlength=len(weights))
                total[:, :-1] += weights * mass[:, None]
                total[:, -1] += mass
    yield pa.RecordBatch.from_pydict({"i": pa.array([0], pa.int32()), "data": pa.array([total.astype("<f8").tobytes()], pa.binary())})


def _bits(keys: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, gates and bits of sextuples (a row each), without their own occurrence."""
    x, gate, bits = np.empty((len(keys), 8, len(ORDERS) + 1)), np.empty((len(keys), 8), np.int16), np.empty((len(keys), 8), np.int8)
    for d, (node, bit) in enumerate(_steps(keys)):
        x[:, d], gate[:, d] = _inputs(paths, d, node, bit, True)
        bits[:, d] = bit
    return x, gate, bits


def learned(keys: np.ndarray, times: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """Weights by gate, from sextuples (taken in hash order), how often each counts and their paths."""
    order = np.argsort(mix(keys))
    return _taught(np.full((256 * GATES, len(ORDERS) + 1), 0.3), order, times[order], _bits(keys, paths))


def _taught(weights: np.ndarray, order: np.ndarray, times: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """``weights`` after passes over rows of ``table`` in an order, each counting so many times. The eight bits have different gates, so one step does all."""
    inputs, gates, bits = table
    weights, times = weights.copy(), times.astype(float)
    for t in range(PASSES):
        for a in range(0, len(order), TOGETHER):
            own = order[a : a + TOGETHER]
            x, gate, c = inputs[own].reshape(-1, weights.shape[1]), gates[own].ravel(), np.repeat(times[a : a + TOGETHER], 8)
            err = (bits[own].ravel() - _squash((weights[gate] * x).sum(1))) * c
            mass = np.bincount(gate, c, minlength=len(weights))
            step = np.stack([np.bincount(gate, err * x[:, i], minlength=len(weights)) for i in range(x.shape[1])], axis=1)
            weights += RATE / (1 + t) * step / np.sqrt(mass + 1)[:, None]
    return weights


def _bucket(x: np.ndarray) -> np.ndarray:
    return np.clip(((x + 8) * (STEPS / 16)).astype(np.int64), 0, STEPS - 1)


def _learn_map(single: np.ndarray, weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((256 * STEPS, 2))
    for batch in batches:
        for keys, n in _part_rows(batch):
            table = Counts(single, keys, n)
            keys, n = keys[n > 0], n[n > 0]
            for a in range(0, len(keys), 1 << 16):
                key, c = keys[a : a + (1 << 16)], n[a : a + (1 << 16)].astype(float)
                paths = table.paths(key)
                for d, (node, bit) in enumerate(_steps(key)):
                    x, gate = _inputs(paths, d, node, bit, True)
                    at = node * STEPS + _bucket((weights[gate] * x).sum(1))
                    for v in (0, 1):
                        total[:, v] += np.bincount(at[bit == v], c[bit == v], minlength=len(total))
    yield pa.RecordBatch.from_pydict({"i": pa.array([0], pa.int32()), "data": pa.array([total.astype("<f8").tobytes()], pa.binary())})


def _log10(table: Counts, weights: np.ndarray, refined: np.ndarray, key: np.ndarray) -> np.ndarray:
    """log10 of the probability of each sextuple's last byte after the others."""
    out = np.zeros(len(key))
    for a in range(0, len(key), 1 << 16):
        k, sl = key[a : a + (1 << 16)], slice(a, a + (1 << 16))
        paths = table.paths(k)
        for d, (node, bit) in enumerate(_steps(k)):
            x, gate = _inputs(paths, d, node, bit, False)
            mixed = np.clip((weights[gate] * x).sum(1), -8, 8)
            p = 0.5 * (_squash(mixed) + refined[node * STEPS + _bucket(mixed)])
            out[sl] += np.log10(np.where(bit == 1, p, 1 - p))
    return out


def _gram_scores(single: np.ndarray, weights: np.ndarray, refined: np.ndarray, parts: int, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores of the parts' sextuples, dealt out by hash; in part -1 the frequent ones, with their counts."""
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for keys, count in _part_rows(batch):
            waiting.append((keys, _log10(Counts(single, keys, count), weights, refined, keys), count))
            if sum(len(x) for x, *_ in waiting) > 10 * _GATHER:
                yield _dealt(waiting, parts, n)
                waiting = []
    if waiting:
        yield _dealt(waiting, parts, n)


def _dealt(scores: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int, n: int) -> pa.RecordBatch:
    keys, logs, count = map(np.concatenate, zip(*scores))
    part = blocks.parts_of(mix(keys), parts)
    order = np.argsort(part, kind="stable")
    names, cut = np.unique(part[order], return_index=True)
    head = np.flatnonzero((count > 0) & (count * GRAM_HEAD >= n))
    takes = [*(order[a:b] for a, b in zip(cut, np.append(cut[1:], len(order)))), head]
    return pa.RecordBatch.from_pydict({
        "part": pa.array([*names.tolist(), -1], pa.int32()),
        "vals": pa.array([keys[x].tobytes() for x in takes], pa.binary()),
        "corpus": pa.array([logs[x].astype("<f8").tobytes() for x in takes], pa.binary()),
        "counts": pa.array([*[None] * len(names), count[head].tobytes()], pa.binary()),
    })


class Model:
    """The frequent words and sextuples; made on the driver, broadcast, of a bounded size."""

    def __init__(self, head: np.ndarray, head_count: np.ndarray, grams: np.ndarray, logs: np.ndarray, count: np.ndarray) -> None:
        self.head, self.head_count = head, head_count
        order = np.lexsort((grams, count))  # of those in one slot the most frequent stays; the others are joined
        self.gram, self.log = np.full(1 << GRAM_BITS, (1 << 64) - 1, U64), np.zeros(1 << GRAM_BITS)
        slot = _gram_slot(grams[order])
        self.gram[slot], self.log[slot] = grams[order], logs[order]


def _gram_slot(keys: np.ndarray) -> np.ndarray:
    return (keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - GRAM_BITS)


def _head(model: Model, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(model.head):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(model.head, words), len(model.head) - 1)
    return at, model.head[at] == words


def _score(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    logs = np.log10(model.head_count + 0.5)
    for batch in batches:
        for a, b, data, offsets in slices(batch["text"]):
            grams = sextuples(data, offsets)
            slot = _gram_slot(grams)
            own = np.repeat(np.arange(b - a), np.diff(offsets))
            total = np.bincount(own, np.where(model.gram[slot] == grams, model.log[slot], 0.0), minlength=b - a) if len(own) else np.zeros(b - a)
            data = LOWER[data]
            starts, ends, doc = spans(data, offsets)
            words, doc = np.concatenate([word_hashes(data, starts, ends), np.full(b - a, END)]), np.concatenate([doc, np.arange(b - a)])
            at, hit = _head(model, words)
            yield pa.RecordBatch.from_pydict({
                "key": batch["key"].slice(a, b - a), "doc_id": batch["doc_id"].slice(a, b - a), "held_out": batch["held_out"].slice(a, b - a),
                "n_tokens": pa.array(counts_of(doc, b - a).astype(np.int64)),
                "head_known": pa.array(np.bincount(doc[hit], minlength=b - a).astype(np.int64)),
                "head_sum": pa.array(np.bincount(doc[hit], logs[at[hit]], minlength=b - a) if hit.any() else np.zeros(b - a)),
                "n_bytes": pa.array(np.diff(offsets)),
                "score": pa.array(total),
            })


def _tail(shared: Broadcast, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        ids = batch["key"].to_numpy()
        for a, b, data, offsets in slices(batch["text"]):
            data = LOWER[data]
            starts, ends, doc = spans(data, offsets)
            words = word_hashes(data, starts, ends)
            keep = ~_head(model, words)[1]
            if keep.any():
                rows = blocks.block_rows(words[keep], doc[keep], ids[a:b], parts)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.binary()), pa.nulls(rows.num_rows, pa.binary())], [*rows.schema.names, "vals", "corpus"])


def _known(buckets: int, table: pa.Table) -> pa.Table:
    """Join a part's words with their corpus counts; sums by document."""
    low = U64((1 << 8 * blocks.TAIL) - 1)
    vals = np.frombuffer(b"".join(x for x in table["vals"].to_pylist() if x), "<u8") & low
    corpus = np.frombuffer(b"".join(x for x in table["corpus"].to_pylist() if x), "<i8")
    order = np.argsort(vals)
    vals, corpus = vals[order], corpus[order]
    lists = table.filter(pa.compute.is_valid(table["tails"]))
    words, owner = blocks.block_values(lists)
    order = np.argsort(owner, kind="stable")
    words, owner = words[order], owner[order]
    count = np.zeros(len(words))
    if len(vals):
        at = np.minimum(np.searchsorted(vals, words), len(vals) - 1)
        count = np.where(vals[at] == words, corpus[at], 0).astype(float)
    start, _ = blocks.runs(owner)
    sums = (np.add.reduceat(np.log10(count + 0.5), start), np.add.reduceat((count > 0).astype(np.int64), start)) if len(start) else (np.zeros(0), np.zeros(0, np.int64))
    return _by_bucket(owner[start], buckets, total=sums[0], known=sums[1])


def _gram_tail(shared: Broadcast, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        ids = batch["key"].to_numpy()
        for a, b, data, offsets in slices(batch["text"]):
            grams, doc = sextuples(data, offsets), np.repeat(np.arange(b - a), np.diff(offsets))
            keep = model.gram[_gram_slot(grams)] != grams
            if keep.any():
                grams = grams[keep]
                rows = blocks.block_rows(grams, doc[keep], ids[a:b], parts, part=blocks.parts_of(mix(grams), parts), width=6)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.binary()), pa.nulls(rows.num_rows, pa.binary())], [*rows.schema.names, "vals", "corpus"])


def _by_bucket(owner: np.ndarray, buckets: int, **sums: np.ndarray) -> pa.Table:
    """Sums of documents, dealt out by document in packed rows."""
    bucket = blocks.parts_of(mix(owner.view(U64)), buckets)
    order = np.argsort(bucket, kind="stable")
    names, cut = np.unique(bucket[order], return_index=True)
    takes = [order[a:b] for a, b in zip(cut, np.append(cut[1:], len(order)))]
    columns = {"owner": owner, **sums}
    return pa.table({"bucket": pa.array(names.astype(np.int32)), **{c: pa.array([x[t].tobytes() for t in takes], pa.binary()) for c, x in columns.items()}})


def _bucket_sums(table: pa.Table) -> pa.Table:
    """One row for each document of a bucket; sums are added in order of size, so in the same order each time."""
    owner, total, known = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("owner", "<i8"), ("total", "<f8"), ("known", "<i8")))
    order = np.lexsort((total, owner))
    start, _ = blocks.runs(owner[order])
    add = lambda x: np.add.reduceat(x[order], start) if len(start) else x
    return pa.table({"key": pa.array(owner[order][start], pa.int64()), "total": pa.array(add(total), pa.float64()), "known": pa.array(add(known), pa.int64())})


def _gram_known(buckets: int, table: pa.Table) -> pa.Table:
    """Join a part's sextuples with their scores; sums by document."""
    vals = np.frombuffer(b"".join(x for x in table["vals"].to_pylist() if x), "<u8")
    logs = np.frombuffer(b"".join(x for x in table["corpus"].to_pylist() if x), "<f8")
    order = np.argsort(vals)
    vals, logs = vals[order], logs[order]
    lists = table.filter(pa.compute.is_valid(table["tails"]))
    owners, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    for a in range(0, lists.num_rows, 256):
        grams, owner = blocks.block_values(lists.slice(a, 256), width=6)
        start, _ = blocks.runs(owner)
        owners.append(owner[start])
        sums.append(np.add.reduceat(logs[np.searchsorted(vals, grams)], start) if len(start) else np.zeros(0))
    owner, total = np.concatenate(owners), np.concatenate(sums)
    order = np.lexsort((total, owner))
    start, _ = blocks.runs(owner[order])
    total = np.add.reduceat(total[order], start) if len(start) else total
    return _by_bucket(owner[order][start], buckets, total=total, known=np.zeros(len(start), np.int64))


def _drawn_weights(grams: DataFrame, single: np.ndarray, share: float, n_grams: int) -> np.ndarray:
    """From a share of the occurrences, at least ``LEARN`` of them: the draws are sent to their streams."""
    rate = min(1.0, max(share, LEARN / max(n_grams, 1)))
    streams = max(1, round(n_grams * rate / LEARN))
    drawn = grams.mapInArrow(partial(_drawn, single, rate, streams), "stream long, vals binary, times binary, paths binary")
    met = drawn.groupBy("stream").applyInArrow(_stream_weights, "i int, data binary").groupBy("i").applyInArrow(_sum_floats, "i int, data binary")
    row = met.withColumn("i", F.lit(0)).groupBy("i").applyInArrow(_sum_floats, "i int, data binary").first()
    return np.full((256 * GATES, len(ORDERS) + 1), 0.3) if row is None else (lambda v: (v[:-1] / v[-1]).reshape(256 * GATES, -1))(np.frombuffer(row.data, "<f8"))


def _all_weights(grams: DataFrame, single: np.ndarray) -> np.ndarray:
    """From all occurrences: each part learns its own, and only weights meet, after each round."""
    weights = np.full((256 * GATES, len(ORDERS) + 1), 0.3)
    for _ in range(ROUNDS):
        row = grams.mapInArrow(partial(_part_weights, single, weights), "i int, data binary").groupBy("i").applyInArrow(_sum_floats, "i int, data binary").first()
        total = np.frombuffer(row.data, "<f8").reshape(256 * GATES, -1)
        weights = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1e-300), weights)
    return weights


def mixing_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: object = None, share: float = SHARE) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)`` for each row.

    ``held_out`` (a boolean column or expression; null counts as false) marks the rows not to learn
    from; by default those whose crc32(id as text) mod 5 is 1. ``share`` of all training bytes give the weights (by default all). Null texts count as empty: one token
    (the end), score 0, bits per byte null. Without any training row every count is 0 and each bit has
    probability one half. Repeated rows are scored alike. Other columns are ignored.
    """
    spark = docs.sparkSession
    mark = F.expr(f"crc32(cast({doc_id} as string)) % 5 = 1") if held_out is None else held_out
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(mark, F.lit(False)).alias("held_out"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    train = rows.where(~F.col("held_out")).select("text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets = int(max(4 * partitions(spark), size // PART)), partitions(spark)
    kind = "part int, vals binary, counts binary"
    total = f"{kind}, n long, v long"
    packed, sums = "bucket int, owner binary, total binary, known binary", "key long, total double, known long"

    words = written(train.mapInArrow(partial(_gather, parts, "words"), kind).groupBy("part").applyInArrow(lambda table: _summed(8, table), total))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    frequent = words.mapInArrow(partial(_frequent, n), "word binary, count binary").collect()
    head = np.concatenate([np.zeros(0, U64), *(np.frombuffer(r.word, "<u8") for r in frequent)])
    head_count = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["count"], "<i8") for r in frequent)])
    order = np.argsort(head)

    pieces = int(max(PARTS, size // PART))
    grams = written(rows.select("text", "held_out").mapInArrow(partial(_gather, pieces, "bytes"), kind).groupBy("part").applyInArrow(lambda table: _summed(6, table), total))
    n_grams = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    single = np.zeros(1 << 16, np.int64)
    for r in grams.mapInArrow(_singles, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        single[r.pair] = r.n
    weights = _all_weights(grams, single) if share >= 1 and n_grams > LEARN else _drawn_weights(grams, single, share, n_grams)
    refined = _squash((np.arange(STEPS) + 0.5) * (16 / STEPS) - 8)[None, :].repeat(256, 0).ravel()
    for r in grams.mapInArrow(partial(_learn_map, single, weights), "i int, data binary").groupBy("i").applyInArrow(_sum_floats, "i int, data binary").collect():
        hits = np.frombuffer(r.data, "<f8").reshape(-1, 2)
        refined = (hits[:, 1] + 20 * refined) / (hits.sum(1) + 20)
    gram_parts = max(partitions(spark), n_grams >> 26)
    gram_scores = written(grams.coalesce(max(12, partitions(spark) // 4)).mapInArrow(partial(_gram_scores, single, weights, refined, gram_parts, n_grams), "part int, vals binary, corpus binary, counts binary"))
    often = gram_scores.where("part = -1").select("vals", "corpus", "counts").toPandas()
    model = spark.sparkContext.broadcast(Model(head[order], head_count[order], *(np.frombuffer(b"".join(map(bytes, often[c])), kind) for c, kind in (("vals", "<u8"), ("corpus", "<f8"), ("counts", "<i8")))))

    scored = rows.mapInArrow(partial(_score, model), f"key long, doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens long, head_known long, head_sum double, n_bytes long, score double")
    lists = rows.select("key", "text").mapInArrow(partial(_tail, model, parts), f"{blocks.SCHEMA}, vals binary, corpus binary")
    corpus = words.select("part", *[F.lit(None).cast("binary").alias(c) for c in ("owners", "counts", "tails")], "vals", F.col("counts").alias("corpus"))
    tails = lists.unionAll(corpus).groupBy("part").applyInArrow(lambda table: _known(buckets, table), packed)
    tails = tails.groupBy("bucket").applyInArrow(_bucket_sums, sums).select("key", F.col("total").alias("tail_sum"), F.col("known").alias("tail_known"))
    gram_lists = rows.select("key", "text").mapInArrow(partial(_gram_tail, model, gram_parts), f"{blocks.SCHEMA}, vals binary, corpus binary")
    gram_corpus = gram_scores.where("part >= 0").select("part", *[F.lit(None).cast("binary").alias(c) for c in ("owners", "counts", "tails")], "vals", "corpus")
    gram_sums = gram_lists.unionAll(gram_corpus).groupBy("part").applyInArrow(lambda table: _gram_known(buckets, table), packed)
    gram_sums = gram_sums.groupBy("bucket").applyInArrow(_bucket_sums, sums).select("key", F.col("total").alias("gram_sum"))
    scored = written(scored)
    same = scored.groupBy("key").agg(F.count("*").alias("same"))
    out = scored.join(same.join(tails, "key", "left").join(gram_sums, "key", "left"), "key", "left")
    out = out.withColumn("score", F.col("score") + F.coalesce(F.col("gram_sum") / F.col("same"), F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce((F.col("tail_known") / F.col("same")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce(F.col("tail_sum") / F.col("same"), F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + 0.5 * (v + 1))))).alias("base_score") if n else F.lit(0.0).alias("base_score"),
        "score", "n_bytes", F.when(F.col("n_bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _frequent(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for vals, counts in zip(batch["vals"], batch["counts"]):
            word, count = np.frombuffer(vals.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<i8")
            keep = (count * HEAD >= n) | (word == END)
            if keep.any():
                yield pa.RecordBatch.from_pydict({"word": pa.array([word[keep].tobytes()], pa.binary()), "count": pa.array([count[keep].tobytes()], pa.binary())})
