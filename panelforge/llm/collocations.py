"""Phrase collocations per language, counted in counting quotient filters.

One pass counts the words of each language; only words that occur often enough can be part of a
candidate (a phrase is no more frequent than its words), so only they get ids: the rank of their
64-bit hash. A second pass packs each pair and triple of ids that stand together in a piece into a
code and permutes it invertibly. A shard's codes are kept as a counting quotient filter: the code's
high bits pick the part, the next ones the quotient, told in unary (two bits an entry or so), and the rest
is the full remainder. Nothing is lost: a filter gives its codes and counts back. Filters of one
part are sorted alike, so the shards merge by part, in as many parts as the tokens ask for; a phrase
that is everywhere has one entry a shard. Scores, cuts and the test for longer phrases are joins of
what reaches the least count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.blocks import packed, unpacked
from panelforge.llm.store import partitions, written
from panelforge.llm.text import LOWER, U64, mix, slices, spans, word_hashes

PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS = PIECE_ENDS.copy()
SEPARATORS[[0x20, 0x09]] = True

#: Words up to which their hashes are broadcast (8 bytes each); beyond, the hashes themselves are the ids.
DICTIONARY = 4 << 20
#: Words a task holds before it sends its counts on, entries of a shard's filter, and tokens for each part of a merge.
KNOWN, SHARD, PART = 1 << 18, 1 << 20, 1 << 20
#: Bytes up to which a table of words or pairs is broadcast.
SMALL = 16 << 20

_MASK = (1 << 64) - 1
_ODD = 0xD6E8FEB86659FD93


# -- the invertible permutation ----------------------------------------------------------------------


def permuted(x: np.ndarray, width: int) -> np.ndarray:
    """A bijection of the ``width``-bit numbers: odd factors and shifts to the right, twice."""
    mask, half = U64((1 << width) - 1), U64((width + 1) // 2)
    for _ in range(2):
        x = (x * U64(_ODD)) & mask
        x = x ^ (x >> half)
    return x


def restored(x: np.ndarray, width: int) -> np.ndarray:
    """What ``permuted`` was given."""
    mask, half = U64((1 << width) - 1), U64((width + 1) // 2)
    inverse = U64(pow(_ODD, -1, 1 << width))
    for _ in range(2):
        x = x ^ (x >> half)  # a shift by half the width or more undoes itself
        x = (x * inverse) & mask
    return x


class Codes:
    """How three ids become the lanes of a code; ``bits`` an id, 64 if ids are hashes (then a lane each)."""

    def __init__(self, bits: int) -> None:
        self.bits, self.lanes = bits, 1 if 3 * bits <= 64 else 3
        self.width = 3 * bits if self.lanes == 1 else 64  # of the lane that deals out

    def lanes_of(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.lanes == 1:
            return permuted((a << U64(2 * self.bits)) | (b << U64(self.bits)) | c, self.width)[None]
        return np.stack([mix(a) ^ mix(b + mix(c)), b, c])

    def ids_of(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.lanes == 1:
            x, mask = restored(lanes[0], self.width), U64((1 << self.bits) - 1)
            return x >> U64(2 * self.bits), (x >> U64(self.bits)) & mask, x & mask
        return _unmixed(lanes[0] ^ mix(lanes[1] + mix(lanes[2]))), lanes[1], lanes[2]


def _unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of ``text.mix``."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


def summed(lanes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and the sum of each one's counts."""
    order = np.lexsort(lanes[::-1]) if len(lanes) > 1 else np.argsort(lanes[0], kind="stable")
    lanes, counts = lanes[:, order], counts[order]
    new = np.ones(lanes.shape[1], bool)
    new[1:] = (lanes[:, 1:] != lanes[:, :-1]).any(0)
    start = np.flatnonzero(new)
    return lanes[:, start], np.add.reduceat(counts, start) if len(start) else counts[:0]


# -- the filter ---------------------------------------------------------------------------------------


def filtered(lanes: np.ndarray, counts: np.ndarray, width: int) -> tuple[int, bytes, bytes, bytes, bytes]:
    """A filter of sorted distinct codes below ``2 ** width`` (first lane): quotient bits, unary runs, remainders, counts, large counts.

    With ``q`` quotient bits for n entries, bit ``quotient + i`` is set for the i-th entry: every zero ends a
    quotient's run. A remainder takes whole bytes, a count one byte; counts of 255 and more stand apart.
    """
    n = lanes.shape[1]
    q = min(width, max(0, n.bit_length() - 1))
    rest = width - q
    quotient = lanes[0] >> U64(rest) if rest < 64 else np.zeros(n, U64)
    bits = np.zeros(n + (1 << q), bool)
    bits[quotient.astype(np.int64) + np.arange(n)] = True
    low = lanes[0] & U64((1 << rest) - 1)
    remainders = packed(low, (rest + 7) // 8) + lanes[1:].astype("<u8").tobytes()
    large = counts[counts >= 255]
    return q, np.packbits(bits).tobytes(), remainders, np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype("<u8").tobytes()


def entries(q: int, runs: bytes, remainders: bytes, counts: bytes, large: bytes, width: int, n_lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes and counts that a filter holds, in order."""
    count = np.frombuffer(counts, np.uint8).astype(np.int64)
    n, rest = len(count), width - q
    at = np.flatnonzero(np.unpackbits(np.frombuffer(runs, np.uint8))[: n + (1 << q)])
    quotient = (at - np.arange(n)).astype(U64)
    wide = (rest + 7) // 8
    low = unpacked(remainders[: n * wide], wide) if wide else np.zeros(n, U64)
    first = (quotient << U64(rest)) | low if rest < 64 else low
    more = np.frombuffer(remainders[n * wide :], "<u8").reshape(n_lanes - 1, n)
    count[count == 255] = np.frombuffer(large, "<u8").astype(np.int64)
    return np.vstack([first[None], more]), count


# -- passes over the texts ---------------------------------------------------------------------------


def _keys(langs: list[str]) -> np.ndarray:
    """A hash for each language's name."""
    data = np.frombuffer("".join(langs).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) for x in langs], dtype=np.int64)
    return mix(word_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)) if langs else np.zeros(0, U64)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """For each slice: lower-cased bytes; start, end, document, piece and hash (word in its language) of every word; the documents' languages."""
    langs = [x if x is not None else "und" for x in batch["lang"].to_pylist()]
    key = _keys(langs)
    for a, b, data, offsets in slices(batch["text"]):
        data = LOWER[data]
        starts, ends, doc = spans(data, offsets, SEPARATORS)
        if len(starts):
            piece = np.cumsum(PIECE_ENDS[data])[starts] + doc  # grows by one at least with each piece and document
            yield data, starts, ends, doc, piece, mix(word_hashes(data, starts, ends) + key[a:b][doc]), langs[a:b]


_WORDS = "lang string, word string, n long"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's words by language, sent on when many are held; a null word is for the language's tokens."""
    known: dict[int, tuple[str, str]] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    totals: dict[str, int] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        if held:
            hashes, counts = summed(np.concatenate([h for h, _ in held])[None], np.concatenate([c for _, c in held]))
            names = [known[h] for h in hashes[0].tolist()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in names], pa.string()), "word": pa.array([x for _, x in names], pa.string()), "n": pa.array(counts)})
        known.clear()
        held.clear()

    for batch in batches:
        for data, starts, ends, doc, _, hashes, langs in _tokens(batch):
            found, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            whole = data.tobytes()
            for h, i in zip(found.tolist(), first.tolist()):
                if h not in known:
                    known[h] = langs[doc[i]], whole[starts[i] : ends[i]].decode("utf-8", "replace")
            held.append((found, counts))
            for x, n in zip(langs, np.bincount(doc, minlength=len(langs)).tolist()):
                totals[x] = totals.get(x, 0) + n
            if len(known) >= KNOWN:
                yield from rows()
            elif len(held) >= 64:
                lanes, sums = summed(np.concatenate([h for h, _ in held])[None], np.concatenate([c for _, c in held]))
                held[:] = [(lanes[0], sums)]
    yield from rows()
    yield pa.RecordBatch.from_pydict({"lang": pa.array(list(totals), pa.string()), "word": pa.nulls(len(totals), pa.string()), "n": pa.array(list(totals.values()), pa.int64())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each (lang, word), as the passes compute it."""
    for batch in batches:
        names = [x.encode() for x in batch["word"].to_pylist()]
        ends = np.cumsum([len(x) for x in names], dtype=np.int64)
        data = np.frombuffer(b"".join(names), np.uint8)
        hashes = word_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if names else np.zeros(0, U64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mix(hashes + _keys(batch["lang"].to_pylist())).view(np.int64))], [*batch.schema.names, "hash"])


_FILTER = "part long, q int, runs binary, remainders binary, counts binary, large binary"


def _blocks(lanes: np.ndarray, counts: np.ndarray, codes: Codes, part_bits: int) -> pa.RecordBatch:
    """A filter for each part of sorted distinct codes."""
    within = codes.width - part_bits
    part = lanes[0] >> U64(within) if within < 64 else np.zeros(lanes.shape[1], U64)
    names, cut = np.unique(part, return_index=True)
    rows = []
    for name, a, b in zip(names.tolist(), cut, np.append(cut[1:], lanes.shape[1])):
        own = lanes[:, a:b].copy()
        own[0] &= U64((1 << within) - 1)
        rows.append((name, *filtered(own, counts[a:b], within)))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["part", "q", "runs", "remainders", "counts", "large"])


def _gram_filters(bits: int, words, part_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of the pairs and triples of this task's pieces; ``words``: sorted hashes whose ranks are the ids (None: hashes are ids)."""
    codes = Codes(bits)
    known = None if words is None else np.frombuffer(words.value, "<u8")
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def together() -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([x for x, _ in held], axis=1), np.concatenate([n for _, n in held]))

    for batch in batches:
        for _, _, _, _, piece, hashes, _ in _tokens(batch):
            if known is None:
                ids, good, none = hashes, np.ones(len(hashes), bool), U64(0)
            else:
                if not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                ids, good, none = at.astype(U64), known[at] == hashes, U64(len(known))
            two = good[:-1] & good[1:] & (piece[:-1] == piece[1:])
            three = two[:-1] & two[1:]
            i, j = np.flatnonzero(two), np.flatnonzero(three)
            lanes = np.concatenate([codes.lanes_of(ids[i], ids[i + 1], np.full(len(i), none)), codes.lanes_of(ids[j], ids[j + 1], ids[j + 2])], axis=1)
            if lanes.shape[1]:
                held.append((lanes, np.ones(lanes.shape[1], np.int64)))
                size += lanes.shape[1]
            if size >= SHARD:
                held[:] = [together()]
                size = held[0][0].shape[1]
                if size >= SHARD // 2:
                    yield _blocks(*held[0], codes, part_bits)
                    held, size = [], 0
    if held:
        yield _blocks(*together(), codes, part_bits)


def _merged(bits: int, none: int, least: int, part_bits: int, table: pa.Table) -> pa.Table:
    """The filters of a part as one; what reaches ``least``, as ids."""
    codes = Codes(bits)
    within = codes.width - part_bits
    found = [entries(*row, within, codes.lanes) for row in zip(*(table[c].to_pylist() for c in ("q", "runs", "remainders", "counts", "large")))]
    lanes, counts = summed(np.concatenate([x for x, _ in found], axis=1), np.concatenate([n for _, n in found]))
    lanes, counts = lanes[:, counts >= least], counts[counts >= least]
    lanes[0] |= U64((table["part"][0].as_py() << within) & _MASK)
    a, b, c = (x.view(np.int64) for x in codes.ids_of(lanes))
    return pa.table({"a": a, "b": b, "c": pa.array(c, mask=c == none), "f": counts})


# -- scores ----------------------------------------------------------------------------------------------


def _near(df: DataFrame, rows: int, width: int) -> DataFrame:
    return F.broadcast(df) if rows * width <= SMALL else df


def _score(a: Column, left: Column, right: Column, scale: int) -> Column:
    """floor(scale * a * a / (left * right)), exact: the products are decimals of 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (big(a) * big(a)).cast("decimal(38,0)") * F.lit(scale), (big(left) * big(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, inside: int = 50, top: int | None = 2000, scale: int = 1_000_000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's phrases of two and three words that stand together more than chance has it.

    Words are lower-cased (A-Z) and split at blanks and tabs, pieces at ``.,;:!?`` and line ends; phrases
    lie within pieces. ``a`` counts a phrase's occurrences, ``n`` the language's words. A phrase with ``a >= least`` is a
    candidate; of its cuts the one with the smallest ``floor(scale * a^2 / (l * r))`` counts (ties: the first),
    ``l`` and ``r`` being the occurrences of its sides. Candidates within a longer candidate with at least
    ``inside`` percent of their occurrences go. ``rank`` is by score, then ``a``, both descending, then phrase
    (bytes); languages give their first ``top`` rows (None: all). Null languages are ``und``, as documents named so; null and
    empty texts have no words; repeated rows count as often as they stand there; an empty table gives no
    row. Other columns are ignored. Counts must stay below 10^16, or the exact products pass 38 digits and raise (null off ANSI mode).
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(_word_counts, _WORDS).groupBy("lang", "word").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | F.col("word").isNull())
    counted = written(counted)
    totals = counted.where("word is null").select("lang", F.col("f").alias("n"))
    sizes = counted.agg(F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("f"))), F.lit(0)), F.count("word"), F.count("*")).first()
    tokens, n_words, n_langs = int(sizes[0]), int(sizes[1]), int(sizes[2] - sizes[1])
    names = counted.where("word is not null").mapInArrow(_hashed, "lang string, word string, f long, hash long")
    if n_words <= DICTIONARY:
        hashes = np.sort(names.select("hash").toArrow()["hash"].to_numpy().view(U64))
        words, bits, none = spark.sparkContext.broadcast(hashes.astype("<u8").tobytes()), max(1, int(len(hashes)).bit_length()), len(hashes)
        names = names.mapInArrow(partial(_ranked, words), "lang string, word string, f long, id long")
    else:
        words, bits, none = None, 64, 0
        names = names.withColumnRenamed("hash", "id")
    names = written(names)
    part_bits = min(Codes(bits).width, 24, max(0, max(partitions(spark) - 1, tokens // PART).bit_length()))
    merged = rows.mapInArrow(partial(_gram_filters, bits, words, part_bits), _FILTER).groupBy("part").applyInArrow(lambda table: _merged(bits, none, least, part_bits, table), "a long, b long, c long, f long")
    grams = written(merged)
    pairs, triples = grams.where("c is null").select("a", "b", "f"), grams.where("c is not null")
    sizes = grams.agg(F.count(F.when(F.col("c").isNull(), 1)), F.count("c")).first()
    word = lambda on, f: _near(names.select(F.col("id").alias(on), F.col("word").alias(f"word_{on}"), F.col("f").alias(f)), n_words, 64)
    pair = lambda on, f: _near(pairs.select(F.col("a").alias(on[0]), F.col("b").alias(on[1]), F.col("f").alias(f)), sizes[0], 32)
    # a pair within a triple that is nearly as frequent
    within = triples.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("pair"), "f").groupBy("pair").agg(F.max("f").alias("longest"))
    within = within.select("pair.a", "pair.b", "longest")
    alone = pairs.join(within, ["a", "b"], "left").where(f"longest is null or 100 * cast(longest as decimal(20,0)) < {int(inside)} * cast(f as decimal(20,0))").drop("longest")
    first = names.select(F.col("id").alias("a"), "lang", F.col("word").alias("word_a"), F.col("f").alias("f_a"))
    first = _near(first, n_words, 96)
    two = alone.join(first, "a").join(word("b", "f_b"), "b")
    two = two.select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("f").alias("a"), F.col("f_a").alias("l"), F.col("f_b").alias("r"))
    three = triples.join(pair(("a", "b"), "f_ab"), ["a", "b"]).join(pair(("b", "c"), "f_bc"), ["b", "c"])
    three = three.join(first, "a").join(word("b", "f_b"), "b").join(word("c", "f_c"), "c")
    three = three.withColumns({"early": _score(F.col("f"), F.col("f_a"), F.col("f_bc"), scale), "late": _score(F.col("f"), F.col("f_ab"), F.col("f_c"), scale)})
    by = F.col("late") < F.col("early")
    three = three.select(
        "lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("f").alias("a"),
        F.when(by, F.col("f_ab")).otherwise(F.col("f_a")).alias("l"), F.when(by, F.col("f_c")).otherwise(F.col("f_bc")).alias("r"),
    )
    every = two.unionByName(three).join(_near(totals, n_langs, 64), "lang").withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"), scale))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = every.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _ranked(words, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = np.frombuffer(words.value, "<u8")
    for batch in batches:
        ids = np.searchsorted(known, batch["hash"].to_numpy().view(U64))
        yield pa.RecordBatch.from_arrays([batch["lang"], batch["word"], batch["f"], pa.array(ids.astype(np.int64))], ["lang", "word", "f", "id"])
