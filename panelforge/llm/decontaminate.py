"""Benchmark decontamination by template canonicalisation.

Words (runs of letters and digits) become template tokens: numbers, units and names (words with one
capital, in front, that don't begin a sentence) turn into typed placeholders, neighbouring numbers into one; other words
are lower-cased. Windows of ``WINDOW`` tokens are hash-joined with the benchmark's. A match lines a
document up with an item. Windows whose slots hold the item's values count; of the others the largest
set found whose values go together (a value of one side always beside the same value of the other), so
questions with other numbers and names are caught and chance matches of mere templates mostly aren't.
Items without such a window, and those of at most ``WINDOW`` words, are also joined word by word.

The windows of a benchmark of a checked size are a sorted table that is broadcast and searched. A larger
benchmark and the documents are dealt out by window hash and meet in a shuffled hash join; the pairs
that have a window in common are then judged on their whole texts, in the same way.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import blocks
from panelforge.llm.store import checkpointed, partitions
from panelforge.llm.text import LOWER, U64, WORD_BASE, mix, powers, slices, spans, window_hashes, word_hashes

WINDOW, LITERAL, ENOUGH, COVER = 8, 4, 6, 0.5
#: Bytes of benchmark text up to which its windows are broadcast, and bytes of text for a part of the shuffled join.
SMALL, PART = 16 << 20, 4 << 20

# Units of measurement.
UNITS = (
    "mm cm m km inch inches ft feet yard yards mile miles mg g kg lb lbs oz ton tons ml l litre litres liter liters "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent degrees celsius fahrenheit kelvin hz khz mhz ghz w kw mw j kj v kv a ma pa kpa n kn mph kmh "
    "dollar dollars euro euros pound pounds cent cents usd eur gbp"
).split()

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DIGIT, _STOP = (np.zeros(256, bool) for _ in range(2))
_DIGIT[48:58] = True
_STOP[[33, 46, 63]] = True
NUMBER, UNIT, NAME = (mix(np.array([x], U64))[0] for x in (101, 102, 103))


def _unit_hashes() -> np.ndarray:
    joined = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = spans(joined, np.array([0, len(joined)]), _BREAK)
    return np.sort(word_hashes(joined, starts, ends))


UNIT_HASHES = _unit_hashes()


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals in lower case (their UTF-8 keeps its length)."""
    low = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    low[after] += 32
    return low


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template token, value (the word's own hash; of all words for neighbouring numbers) and document of each token; hash and document of each word."""
    starts, ends, doc = spans(data, offsets, _BREAK)
    low = lowered(data)
    values = word_hashes(low, starts, ends)
    tokens = values.copy()
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[ends] - digits[starts] == ends - starts
    units = UNIT_HASHES
    unit = units[np.minimum(np.searchsorted(units, values), len(units) - 1)] == values
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    begins = np.ones(len(doc), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    raised = np.concatenate([[0], np.cumsum(low != data)])
    first = np.minimum(starts + 1 + (data[starts] == 0xC3), ends)
    # one capital, in front: words all in capitals are plain
    name = (raised[first] > raised[starts]) & (raised[ends] - raised[starts] == 1) & (ends > first) & ~begins
    tokens[unit], tokens[name], tokens[number] = UNIT, NAME, NUMBER
    keep = np.ones(len(doc), bool)
    keep[1:] = ~(number[1:] & number[:-1] & (doc[1:] == doc[:-1]))
    up, down = powers(WORD_BASE, len(doc) + 1)
    prefix = np.concatenate([np.zeros(1, U64), np.cumsum(values * up[: len(doc)], dtype=U64)])
    first = np.flatnonzero(keep)
    joined = (prefix[np.append(first[1:], len(doc))] - prefix[first]) * down[first] if len(first) else values
    return tokens[keep], joined, doc[keep], values, doc


def _windows(tokens: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that lie in one document and have enough plain words."""
    if len(tokens) < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    hashes = window_hashes(tokens, width)
    plain = np.concatenate([[0], np.cumsum((tokens != NUMBER) & (tokens != UNIT) & (tokens != NAME))])
    ok = (doc[: len(hashes)] == doc[width - 1 :]) & (plain[width:] - plain[:-width] >= min(LITERAL, width))
    at = np.flatnonzero(ok)
    return at, hashes[at]


class Index:
    """Windows of benchmark items: hash, item, place; of template tokens, and of words for items that need those; and each item's tokens and values."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        rows = [(i, t) for i, t in rows if i is not None and t]
        text = [t.encode() for _, t in rows]
        data = np.frombuffer(b"".join(text), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
        tokens, values, doc, words, word_doc = templates(data, offsets)
        edge = np.searchsorted(doc, np.arange(len(rows) + 1))
        self.items = np.array([i for i, _ in rows], np.int64)
        self.tokens = [tokens[a:b] for a, b in zip(edge, edge[1:])]
        self.values = [values[a:b] for a, b in zip(edge, edge[1:])]
        lengths = np.diff(edge)
        self.by_width, self.total = self._by_width(partial(_windows, tokens, doc), doc, edge, lengths, lengths >= LITERAL)
        edge = np.searchsorted(word_doc, np.arange(len(rows) + 1))
        lengths = np.diff(edge)
        literal = (lengths > 0) & ((self.total == 0) | (lengths <= WINDOW))
        self.literal, self.literal_total = self._by_width(partial(_literal_windows, words, word_doc), word_doc, edge, lengths, literal)

    @staticmethod
    def _by_width(windows: Callable[[int], tuple[np.ndarray, np.ndarray]], doc: np.ndarray, edge: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        out, total = {}, np.zeros(len(lengths), np.int64)
        for width in np.unique(np.minimum(WINDOW, lengths[wanted])).tolist():
            mine = wanted & ((lengths >= WINDOW) if width == WINDOW else (lengths == width))
            at, hashes = windows(width)
            ok = mine[doc[at]] if len(at) else np.zeros(0, bool)
            at, hashes = at[ok], hashes[ok]
            order = np.argsort(hashes, kind="stable")
            out[width] = hashes[order], doc[at[order]], (at - edge[doc[at]])[order]
            total += np.bincount(doc[at], minlength=len(lengths))
        return out, total


def _literal_windows(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of words that lie in one document."""
    hashes = window_hashes(words, width)
    at = np.flatnonzero(doc[: len(hashes)] == doc[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    return at, hashes[at]


def _joined(found: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, item and place of each pair of equal windows."""
    hashes, item, place = found
    low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
    n = high - low
    pair = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(at, n), item[pair], place[pair]


def _consistent(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether the values go together one to one."""
    pairs = set(zip(left.tolist(), right.tolist()))
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def _counted(slots: np.ndarray, left: np.ndarray, right: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, bool]:
    """The places whose windows count, and whether a slot in those has another value.

    ``slots``: sorted places of the slots, with their ``left`` and ``right`` values. Each value of one
    side goes with the value of the other that most windows have beside it; the better side is taken.
    """

    def free(bad: np.ndarray) -> np.ndarray:
        return np.searchsorted(bad, places) == np.searchsorted(bad, places + width)

    exact = free(slots[left != right])
    if exact.all() or _consistent(left, right):
        return places, not exact.all()
    weight = np.searchsorted(places, slots, "right") - np.searchsorted(places, slots - width, "right")
    best = exact
    for one, other in ((left, right), (right, left)):
        votes: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for a, b, w in zip(one.tolist(), other.tolist(), weight.tolist()):
            votes[a][b] += w
        taken = np.array([max(votes[a], key=lambda b: (votes[a][b], a == b, b)) for a in one.tolist()], U64)
        kept = exact | free(slots[taken != other])
        best = kept if kept.sum() > best.sum() else best
    return places[best], bool((best & ~exact).any())


def _found(index: Index, tokens: np.ndarray, values: np.ndarray, doc: np.ndarray, words: np.ndarray, word_doc: np.ndarray) -> Iterator[tuple[int, int, int, float, bool]]:
    lined: dict[tuple[int, int, int], set[tuple[int, int]]] = defaultdict(set)
    for width, windows in index.by_width.items():
        at, item, place = _joined(windows, *_windows(tokens, doc, width))
        for d, j, shift, p in zip(doc[at].tolist(), item.tolist(), (at - place).tolist(), place.tolist()):
            lined[d, j, shift].add((p, width))
    best: dict[tuple[int, int], tuple[set[int], bool]] = {}
    for (d, j, shift), found in lined.items():
        width = next(iter(found))[1]
        places = np.array(sorted(p for p, _ in found))
        at = np.unique(places[:, None] + np.arange(width))
        slots = at[np.isin(index.tokens[j][at], (NUMBER, UNIT, NAME))]
        kept, other = _counted(slots, index.values[j][slots], values[shift + slots], places, width)
        if len(kept):
            seen, changed = best.get((d, j), (set(), False))
            best[d, j] = seen | set(kept.tolist()), changed or other
    done = set()
    for (d, j), (places, changed) in best.items():
        if len(places) >= ENOUGH or len(places) >= COVER * index.total[j]:
            done.add((d, j))
            yield d, int(index.items[j]), len(places), len(places) / int(index.total[j]), changed
    literal = [np.zeros((0, 3), np.int64)]
    for width, windows in index.literal.items():
        at, item, place = _joined(windows, *_literal_windows(words, word_doc, width))
        literal.append(np.stack([word_doc[at], item, place], axis=1))
    pairs, n = np.unique(np.unique(np.concatenate(literal), axis=0)[:, :2], axis=0, return_counts=True)
    for (d, j), k in zip(pairs.tolist(), n.tolist()):
        if (d, j) not in done and (k >= ENOUGH or k >= COVER * index.literal_total[j]):
            yield d, int(index.items[j]), k, k / int(index.literal_total[j]), False


def _matches(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index: Index = shared.value
    for batch in batches:
        for a, b, data, offsets in slices(batch["text"]):
            rows = sorted(_found(index, *templates(data, offsets)))
            if rows:
                d, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a).take(pa.array(d)), *(pa.array(x) for x in rest)], ["doc_id", "item_id", "n_windows", "coverage", "changed"])


def _salted(hashes: np.ndarray, literal: bool, width: int) -> np.ndarray:
    return mix(hashes + U64(width + 16 * literal))


def _item_rows(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window hashes of items, dealt out by hash."""
    for batch in batches:
        index = Index(list(zip(batch["key"].to_pylist(), batch["t"].to_pylist())))
        found = [(_salted(h, literal, width), item) for literal, windows in ((False, index.by_width), (True, index.literal)) for width, (h, item, _) in windows.items()]
        if sum(len(h) for h, _ in found):
            yield _sided(np.concatenate([h for h, _ in found]), np.concatenate([i for _, i in found]), index.items, parts, True)


def _document_rows(widths: list[tuple[bool, int]], parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window hashes of documents in the widths that items have, dealt out by hash."""
    for batch in batches:
        keys = batch["key"].to_numpy()
        for a, b, data, offsets in slices(batch["text"]):
            tokens, _, doc, words, word_doc = templates(data, offsets)
            for literal, width in widths:
                own, of = (words, word_doc) if literal else (tokens, doc)
                at, hashes = (_literal_windows if literal else _windows)(own, of, width)
                if len(at):
                    yield _sided(_salted(hashes, literal, width), of[at], keys[a:b], parts, False)


def _sided(hashes: np.ndarray, owner: np.ndarray, keys: np.ndarray, parts: int, item: bool) -> pa.RecordBatch:
    rows = blocks.block_rows(hashes, owner, keys, parts)
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array([item] * rows.num_rows)], [*rows.schema.names, "item"])


def _widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index = Index(list(zip(batch["key"].to_pylist(), batch["t"].to_pylist())))
        found = [(literal, width) for literal, windows in ((False, index.by_width), (True, index.literal)) for width in windows]
        yield pa.RecordBatch.from_pydict({"literal": pa.array([x for x, _ in found], pa.bool_()), "width": pa.array([x for _, x in found], pa.int32())})


def _met(table: pa.Table) -> pa.Table:
    """Documents and items that have a window of this part in common."""
    item = table["item"].combine_chunks()
    (hashes, owner), (known, items) = (blocks.block_values(table.filter(side)) for side in (pa.compute.invert(item), item))
    order = np.lexsort((items, known))
    known, items = known[order], items[order]
    at, place, _ = _joined((known, items, items), np.arange(len(hashes)), hashes)
    pairs = np.unique(np.stack([owner[at], place], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    return pa.table({"key": pa.array(pairs[:, 0], pa.int64()), "item": pa.array(pairs[:, 1], pa.int64())})


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs judged on their whole texts."""
    for batch in batches:
        for n in range(batch.num_rows):
            row = batch.slice(n, 1)
            index = Index([(row["i"][0].as_py(), row["t"][0].as_py())])
            for _, _, data, offsets in slices(row["text"]):
                for _, *found in _found(index, *templates(data, offsets)):
                    yield pa.RecordBatch.from_arrays([row["doc_id"], *(pa.array([x]) for x in found)], ["doc_id", "item_id", "n_windows", "coverage", "changed"])


def _shuffled(rows: DataFrame, items: DataFrame, size: int, kind: str) -> DataFrame:
    spark = rows.sparkSession
    rows, items = (x.withColumn("key", F.xxhash64(*x.columns)) for x in (rows, items))
    widths = sorted((r.literal, r.width) for r in items.select("key", "t").mapInArrow(_widths, "literal boolean, width int").distinct().collect())
    parts = int(max(4 * partitions(spark), size // PART, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART))
    schema = f"{blocks.SCHEMA}, item boolean"
    both = rows.select("key", "text").mapInArrow(partial(_document_rows, widths, parts), schema).union(items.select("key", "t").mapInArrow(partial(_item_rows, parts), schema))
    pairs = checkpointed(both.groupBy("part").applyInArrow(_met, "key long, item long").distinct())
    both = pairs.join(rows, "key").join(items.withColumnRenamed("key", "item"), "item")
    return both.select("i", "t", "text", "doc_id").mapInArrow(_judged, kind)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_windows, coverage, changed)`` for each document with most of an item.

    A pair counts with at least half of the item's windows, or with six of them (13 words). ``changed``:
    a slot's value differs. Null and empty texts on either side match nothing. Items without a window of
    four plain words (also all of fewer than four tokens) are found by their words only, as they stand;
    so are those of at most eight words that have one, besides. Even an item of one word is looked for. Repeated rows give repeated rows; a
    repeated item id gives a row for each of its texts found. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t <> ''")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id long, n_windows long, coverage double, changed boolean"
    if size > SMALL:
        return _shuffled(rows, items, size, kind)
    index = spark.sparkContext.broadcast(Index(sorted((r.i, r.t) for r in items.collect())))
    return rows.mapInArrow(partial(_matches, index), kind)
