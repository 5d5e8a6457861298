"""Spelling variant grouping by dense prefix-suffix tiles.

Words that occur often enough are rows of padded code-point matrices, one aligned left and one
aligned right. Blocks of words meet in pairs (tiles), each pair of rows gives the lengths of
its common prefix and suffix, and two words are a single edit apart exactly if these reach the longer length minus one.
One of the two is then at least half the longer length, so only words that share such a
half meet: blocks are cut within the words of one half, and a half that very many words share makes several
blocks, each pair of which is a tile of bounded size. Only pairs that are near leave a tile.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.store import partitions, written
from panelforge.llm.text import slices

#: Words of a block, and distinct words a task holds before it sends its counts on.
BLOCK, HELD = 256, 1 << 19
#: Bytes up to which the list of halves that many words share is broadcast.
SMALL = 16 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def runs_of(doc_id: str, text: str, drop: int) -> Counter[str]:
    """A document's runs, lower-cased (A-Z), each with its slip of the pen, and how often each occurs."""
    out: Counter[str] = Counter()
    for run, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % drop == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def _word_counts(drop: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's words of at least ``least`` code points."""
    held: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        held.clear()
        return out

    for batch in batches:
        ids = batch["doc_id"].to_pylist()
        for a, b, data, offsets in slices(batch["text"]):
            for i in range(a, b):
                text = data[offsets[i - a] : offsets[i - a + 1]].tobytes().decode("utf-8", "replace")
                for word, n in runs_of("" if ids[i] is None else ids[i], text, drop).items():
                    if len(word) >= least:
                        held[word] += n
            if len(held) >= HELD:
                yield rows()
    if held:
        yield rows()


def words_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop: int = 199, least_length: int = 6, least: int = 5) -> DataFrame:
    """``(word, n)``: the words of all texts with at least ``least_length`` code points and ``least`` occurrences.

    ``drop``: a run whose crc32 of ``<doc_id>:<run>`` it divides loses the code point at crc32 modulo length. A null
    id counts as an empty one.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(partial(_word_counts, drop, least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# -- tiles -------------------------------------------------------------------------------------------------


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left, aligned right (both padded with zeros), and lengths."""
    length = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    points = points.astype(np.uint8) if points.max(initial=0) < 256 else points
    left = np.zeros((len(words), int(length.max(initial=1))), points.dtype)
    row = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
    left[row, at] = points
    right = np.zeros_like(left)
    right[row, at + left.shape[1] - length[row]] = points
    return left, right, length


def _shared(differ: np.ndarray) -> np.ndarray:
    """How many columns come before the first that differs."""
    return np.where(differ.any(1), differ.argmax(1), differ.shape[1])


def near_rows(x: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows ``i`` and ``j`` of the matrices are one edit apart, and the length of their common prefix."""
    left, right, length = x
    longer, shorter = np.maximum(length[i], length[j]), np.minimum(length[i], length[j])
    prefix = np.minimum(_shared(left[i] != left[j]), shorter)
    suffix = np.minimum(_shared((right[i] != right[j])[:, ::-1]), shorter)
    equal = (prefix == longer) & (longer == shorter)
    return ~equal & (prefix + suffix >= longer - 1) & (longer - shorter <= 1), prefix


#: Pairs of rows that are compared at a time, and rows of whole tiles that are.
_STEP, _ROWS = 1 << 16, 1 << 13


def near_in_tiles(words: list[str], tile: np.ndarray, block: np.ndarray, within: np.ndarray, side: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of rows of the same tile; a tile's rows stand together.

    A tile compares block 0 with block 1, or block 0 in itself (``within``). The longer word of a pair has ``long`` code
    points. Pairs whose common prefix is at least half of that are for the tile of that prefix (side 0), the others
    for that of their suffix, so none is found twice.
    """
    x = matrices(words)
    n = len(words)
    end = np.searchsorted(tile, tile, "right")
    after = end - np.arange(n) - 1
    upto = np.concatenate([[0], np.cumsum(after)])
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + _STEP, "right")) - 1)
        i = np.repeat(np.arange(a, b), after[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[a:b] - upto[a], after[a:b])
        keep = (within[i] | (block[i] != block[j])) & (np.maximum(x[2][i], x[2][j]) == long[i])
        i, j = i[keep], j[keep]
        near, prefix = near_rows(x, i, j)
        near &= (prefix >= long[i] // 2) == (side[i] == 0)
        out_i.append(i[near])
        out_j.append(j[near])
        a = b
    return np.concatenate(out_i), np.concatenate(out_j)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of the tiles of a sorted partition; tiles are compared many at a time, each as a whole."""
    key = ["half", "side", "long", "i", "j"]
    held: pa.Table | None = None

    def compared(table: pa.Table, tile: np.ndarray) -> pa.RecordBatch:
        column = lambda c: table[c].to_numpy()
        words, n = table["word"].to_pylist(), column("n")
        i, j = near_in_tiles(words, tile, column("block"), column("i") == column("j"), column("side"), column("long"))
        one, other = np.concatenate([i, j]), np.concatenate([j, i])
        pick = lambda at: pa.array([words[k] for k in at.tolist()], pa.string())
        return pa.RecordBatch.from_pydict({"word": pick(one), "n": pa.array(n[one]), "other": pick(other), "other_n": pa.array(n[other])})

    def tiles(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for c in key:
            v = table[c].combine_chunks()
            new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if len(held) < _ROWS:
            continue
        tile = tiles(held)
        last = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on
        if last:
            yield compared(held.slice(0, last), tile[:last])
            held = held.slice(last).combine_chunks()
    if held is not None and len(held):
        yield compared(held, tiles(held))


def _block_of(word: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(word), blocks).cast("int")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``, both ways, for the pairs of ``(word, n)`` rows (distinct, not empty) one edit apart.

    A word is in four groups: by its first and its last half, as the longer or equally long of a pair, and as the shorter one.
    Groups of more than ``BLOCK`` words are cut into blocks by the words' hashes, and a word goes to the tile of each pair its
    block is part of.
    """
    spark = words.sparkSession
    size = F.char_length("word")
    halves = [F.struct(F.lit(side).alias("side"), (size + more).alias("long"), (F.substring("word", F.lit(1), h) if side == 0 else F.substring("word", -h, h)).alias("half")) for side in (0, 1) for more in (0, 1) for h in [F.floor((size + more) / 2).cast("int")]]
    grouped = words.select("word", "n", F.explode(F.array(*halves)).alias("key")).select("word", "n", "key.*")
    large = written(grouped.groupBy("side", "long", "half").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK))
    near = F.broadcast(large) if large.count() * 64 <= SMALL else large
    blocks = F.ceil(F.coalesce("members", F.lit(1)) / BLOCK).cast("int")
    cut = grouped.join(near, ["side", "long", "half"], "left").withColumn("blocks", blocks).withColumn("own", _block_of(F.col("word"), F.col("blocks")))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") > k).cast("int").alias("block")))
    tiled = cut.select("word", "n", "side", "long", "half", F.explode(tiles).alias("tile")).select("word", "n", "side", "long", "half", "tile.*")
    key = ["half", "side", "long", "i", "j"]
    dealt = tiled.repartition(partitions(spark), *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(_pairs, "word string, n long, other string, other_n long")


# -- forms and roots -----------------------------------------------------------------------------------


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop: int = 199, least_length: int = 6, least: int = 5, factor: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of ``words_of``.

    ``n_near`` counts the words one edit away, ``form`` is the most frequent of them (ties: the smallest in code-point order) if it
    is ``factor`` times as frequent (at least 2), ``root`` the word at the end of the chain of forms, the word itself without one. Null and
    empty texts have no words; repeated rows count as often as they stand there; an empty table gives no row.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent than their words, or chains need not end")
    words = written(words_of(docs, doc_id, text, drop, least_length, least))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best")
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    form = F.when(-F.col("best.less") >= F.col("n") * factor, F.col("best.other"))
    rows = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"))
    rows = written(rows)
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    # a form is factor times as frequent as its word, so no chain is longer than this; every round doubles what is followed
    most = rows.agg(F.max("n")).first()[0] or 1
    chain = max(1, math.ceil(math.log(max(1.0, most / least), factor)))
    for _ in range(max(0, math.ceil(math.log2(chain)))):
        links = written(links.alias("a").join(links.alias("b"), F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root")))
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
