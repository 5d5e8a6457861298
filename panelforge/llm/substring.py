"""Substring dedup by seed and extend on winnowed anchors.

Each window of ``WINDOW`` words selects the smallest of its 16-word hashes as its anchor (winnowing:
what is selected depends on the window's words alone, so equal windows select equal anchors).
Documents are joined on anchors. Every occurrence of an anchor brings the run of windows that
selected it, that is its extensions to the left and to the right; where two occurrences have a window
in common, it is repeated. Consecutive repeated windows make up the maximal repeats, whose words are
removed. Extensions are matched by hash within an anchor, never pair by pair, so a passage that very
many documents share costs one entry for each of its occurrences, or one for each slice of text that
holds several.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import blocks
from panelforge.llm.store import partitions
from panelforge.llm.text import counts_of, mix, slices, spans, window_hashes, word_hashes

WINDOW, GRAM = 35, 16
#: Bytes of text for a part of the exchange.
PART = 6 << 20
_BLOCKS = "part int, keys binary, starts binary, lengths binary, anchors binary, tails binary, found binary"


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    step = 1
    while step * 2 <= width:
        x, step = np.minimum(x[:-step], x[step:]), step * 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def _ranges(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and length of each run of consecutive numbers."""
    if not len(at):
        return at, at
    new = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
    return at[new], np.diff(np.append(new, len(at)))


def _windows(window: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gram = min(GRAM, window)
    for batch in batches:
        ids = batch["key"].to_numpy()
        for a, b, data, offsets in slices(batch["text"]):
            starts, ends, doc = spans(data, offsets)
            if len(doc) < window:
                continue
            n_words = counts_of(doc, b - a)
            first = np.concatenate([[0], np.cumsum(n_words)])
            words = word_hashes(data, starts, ends)
            anchor = _least(window_hashes(words, gram), window - gram + 1)
            prints = window_hashes(words, window)
            at = np.flatnonzero(first[doc[: len(prints)] + 1] - np.arange(len(prints)) >= window)
            if not len(at):
                continue
            prints, anchor, owner = prints[at], anchor[at], doc[at]
            order = np.argsort(prints)
            start, length = blocks.runs(prints[order])
            many = np.repeat(length > 1, length)
            twice = np.sort(order[many])  # repeated within the slice: known already, one entry goes on
            drop = np.ones(len(order), bool)
            drop[start] = False
            keep = np.ones(len(order), bool)
            keep[order[drop]] = False
            known = np.stack([ids[a:b][owner[twice]], at[twice] - first[owner[twice]]], axis=1) if len(twice) else np.zeros((0, 2), np.int64)
            prints, anchor, owner, place = prints[keep], anchor[keep], owner[keep], (at - first[owner])[keep]
            part = blocks.parts_of(mix(anchor), parts)
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(place) != 1)])
            run = np.flatnonzero(new)
            length = np.diff(np.append(run, len(prints)))
            by = np.argsort(part[run], kind="stable")
            names, cut = np.unique(part[run][by], return_index=True)
            cuts = np.append(cut, len(run))
            order = np.argsort(part, kind="stable")
            cut_windows = np.append(np.searchsorted(part[order], names), len(prints))
            share = np.array_split(known, len(names))
            column = lambda x, kind: pa.array([x[by[i:j]].astype(kind).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(names.astype(np.int32)),
                "keys": column(ids[a:b][owner[run]], "<i8"),
                "starts": column(place[run], "<u4"),
                "lengths": column(length, "<u4"),
                "anchors": pa.array([blocks.packed(anchor[run][by[i:j]]) for i, j in zip(cuts, cuts[1:])], pa.binary()),
                "tails": pa.array([blocks.packed(prints[order[i:j]]) for i, j in zip(cut_windows, cut_windows[1:])], pa.binary()),
                "found": pa.array([x.astype("<i8").tobytes() for x in share], pa.binary()),
            })


def _repeats(table: pa.Table) -> pa.Table:
    """Runs of repeated windows by document: start and length pairs."""
    joined = lambda name: b"".join(table[name].to_pylist())
    lengths = np.frombuffer(joined("lengths"), "<u4").astype(np.int64)
    key = np.repeat(np.frombuffer(joined("keys"), "<i8"), lengths)
    inner = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.repeat(np.frombuffer(joined("starts"), "<u4").astype(np.int64), lengths) + inner
    prints = mix(np.repeat(mix(blocks.unpacked(joined("anchors"))), lengths) + blocks.unpacked(joined("tails")))
    order = np.argsort(prints)
    _, length = blocks.runs(prints[order])
    hit = order[np.repeat(length > 1, length)]
    known = np.frombuffer(joined("found"), "<i8").reshape(-1, 2)
    key, place = np.concatenate([key[hit], known[:, 0]]), np.concatenate([place[hit], known[:, 1]])
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    start, length = blocks.runs(key)
    out = [np.stack(_ranges(np.unique(place[s : s + n])), axis=1).astype("<u4").tobytes() for s, n in zip(start, length)]
    return pa.table({"key": pa.array(key[start], pa.int64()), "ranges": pa.array(out, pa.binary())})


def _kept(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch["ranges"]
        for a, b, data, offsets in slices(batch["text"]):
            starts, ends, doc = spans(data, offsets)
            n_words = counts_of(doc, b - a)
            first = np.concatenate([[0], np.cumsum(n_words)])
            cover = np.zeros(len(doc) + 1, np.int64)
            for i in range(a, b):
                if found[i].is_valid and (blob := b"".join(x.as_py() for x in found[i].values)):
                    at, n = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64).T
                    np.add.at(cover, first[i - a] + at, 1)
                    np.add.at(cover, first[i - a] + at + n + window - 1, -1)
            kept = np.cumsum(cover[:-1]) == 0
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts[kept]] += 1
            # a kept word takes along the separator behind it, but for the last one of its document
            index = np.flatnonzero(kept)
            final = np.ones(len(index), bool)
            final[:-1] = doc[index[1:]] != doc[index[:-1]]
            stop = ends[index] + ~final
            np.add.at(edge, stop, -1)
            keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
            text = data.copy()
            text[ends[index[~final]]] = 32
            out = text[keep]
            cut = np.concatenate([[0], np.cumsum(keep)])[offsets]
            pieces = [out[x:y].tobytes() for x, y in zip(cut, cut[1:])]
            n_kept = counts_of(doc[kept], b - a)
            columns = {
                "row": batch["row"].slice(a, b - a),
                "n_words": pa.array(n_words.astype(np.int64)),
                "n_removed": pa.array((n_words - n_kept).astype(np.int64)),
                "kept": pa.array(pieces, pa.binary()).cast(pa.string()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in pieces]),
            }
            yield pa.RecordBatch.from_pydict(columns)


def without_repeats(docs: DataFrame, text: str = "text", carry: list[str] | None = None, window: int = WINDOW, input_bytes: int | None = None) -> DataFrame:
    """``(row struct<carry>, n_words, n_removed, kept, kept_sha256)`` for each row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in this
    document or another; windows are judged on the input. Texts of fewer words than a window lose
    nothing. Null and empty texts have no words and keep the empty string. Equal rows count as
    different places, so a repeated row loses its windows. ``carry`` names the columns to pass on
    (default: all); their names can't clash with the result's, as they stand in ``row``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(c) for c in (carry or docs.columns)]).alias("row"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text", *([F.col("row.doc_id")] if "doc_id" in (carry or docs.columns) else [])))
    if input_bytes is None:
        input_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(4 * partitions(spark), input_bytes // PART + 1))
    found = (
        rows.select("key", "text").mapInArrow(partial(_windows, window, parts), _BLOCKS)
        .groupBy("part").applyInArrow(_repeats, "key long, ranges binary")
        .groupBy("key").agg(F.collect_list("ranges").alias("ranges"))
    )
    kind = rows.schema["row"].dataType.simpleString()
    return rows.join(found, "key", "left").select("row", "text", "ranges").mapInArrow(partial(_kept, window), f"row {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
