"""Hashes dealt out by value in packed blocks.

A row of the exchange is a block: for one slice of documents and one part of the hash space, the
owners (64-bit), how many hashes each has here, and the hashes' low 40 bits. The part fixes the
high bits, so a hash takes five bytes and about one for its owner, instead of a row of 28.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from panelforge.llm.text import U64

SCHEMA = "part int, owners binary, counts binary, tails binary"
TAIL = 5


def parts_of(values: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: its high 32 bits scaled to [0, parts)."""
    return (((values >> U64(32)) * U64(parts)) >> U64(32)).astype(np.uint16 if parts < 65536 else np.uint32)


def packed(values: np.ndarray, width: int = TAIL) -> bytes:
    return np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, width: int = TAIL) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def block_rows(values: np.ndarray, owner: np.ndarray, keys: np.ndarray, parts: int, extra: dict[str, tuple[np.ndarray, int]] | None = None, part: np.ndarray | None = None, width: int = TAIL) -> pa.RecordBatch:
    """Blocks of hashes whose ``owner`` indexes ``keys``; ``extra`` columns go along at a byte width. Values of another ``width`` bring their ``part``."""
    part = parts_of(values, parts) if part is None else part
    order = np.argsort(part, kind="stable")
    part, values, owner = part[order], values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(values))).astype("<u4")
    names = np.unique(part)
    cut, cut_run = np.searchsorted(part, names), np.searchsorted(part[run], names)
    ends, ends_run = np.append(cut[1:], len(values)), np.append(cut_run[1:], len(run))
    owners = keys[owner[run]].astype("<i8")
    columns = {
        "part": pa.array(names.astype(np.int32)),
        "owners": pa.array([owners[a:b].tobytes() for a, b in zip(cut_run, ends_run)], pa.binary()),
        "counts": pa.array([length[a:b].tobytes() for a, b in zip(cut_run, ends_run)], pa.binary()),
        "tails": pa.array([packed(values[a:b], width) for a, b in zip(cut, ends)], pa.binary()),
    }
    for name, (more, wide) in (extra or {}).items():
        more = more[order]
        columns[name] = pa.array([packed(more[a:b].astype(np.uint64), wide) for a, b in zip(cut, ends)], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def block_values(table: pa.Table, extra: dict[str, int] | None = None, width: int = TAIL) -> tuple[np.ndarray, ...]:
    """The hashes' tails, their owners' keys, and the extra columns of a group of blocks."""
    joined = lambda name: b"".join(x for x in table[name].to_pylist())
    keys = np.frombuffer(joined("owners"), "<i8")
    counts = np.frombuffer(joined("counts"), "<u4")
    out = [unpacked(joined("tails"), width), np.repeat(keys, counts)]
    for name, wide in (extra or {}).items():
        out.append(unpacked(joined(name), wide))
    return tuple(out)


def count_rows(keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray, parts: int) -> pa.RecordBatch:
    """Blocks without hashes: of each key only a count, dealt out by the key's hash."""
    part = parts_of(hashes, parts)
    order = np.argsort(part, kind="stable")
    part, keys, counts = part[order], keys[order].astype("<i8"), counts[order].astype("<u4")
    names, cut = np.unique(part, return_index=True)
    ends = np.append(cut[1:], len(part))
    packs = [pa.array([x[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()) for x in (keys, counts)]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *packs, pa.array([b""] * len(names), pa.binary())], ["part", "owners", "counts", "tails"])


def count_values(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of blocks without hashes."""
    keys, counts = (b"".join(table[name].to_pylist()) for name in ("owners", "counts"))
    return np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<u4")


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values in a sorted array."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return start, np.diff(np.append(start, len(values)))
