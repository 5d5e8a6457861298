"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters that aren't letters count as blanks; n-grams of one to three characters (none with two
blanks in a row) are hashed. Document frequencies cover all training documents. The weights are
learned by follow-the-regularised-leader with elastic-net penalties on a bounded sample
(``PER_LABEL`` documents of a label, about; chosen by hash), part of which calibrates the temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.store import checkpointed
from panelforge.llm.text import LOWER, U64, mix, slices

BITS, GRAMS = 15, 3
#: Training documents of one label that the weights are learned from, in expectation.
PER_LABEL = 600
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 2e-5, 1e-5, 4
SCALE = 30.0
#: Document frequencies go out in pieces, and are added up in two steps.
PIECES, FAN = 16, 64
SMALL = 16 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams, their documents, and which documents have a letter."""
    n_docs = len(offsets) - 1
    points = np.frombuffer(LOWER[data].tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letter = letters()[points]
    owner = np.repeat(np.arange(n_docs), np.diff(first))
    points = np.where(letter, points, 32).astype(U64)
    has = np.bincount(owner, letter, minlength=n_docs) > 0
    values, owners = [], []
    blank, code = points == 32, points
    for n in range(1, GRAMS + 1):
        if n == 1:
            ok = ~blank
        else:
            if len(points) < n:
                break
            code = code[:-1] * U64(0x110000 + 7) + points[n - 1 :]
            ok = (owner[: len(code)] == owner[n - 1 :])
            for j in range(n - 1):
                ok &= ~(blank[j : j + len(code)] & blank[j + 1 : j + 1 + len(code)])
        values.append((mix(code[ok] + U64(n << 56)) >> U64(64 - BITS)).astype(np.int64))
        owners.append(owner[: len(code)][ok])
    return np.concatenate(values) if values else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64), has


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``most`` documents."""
    for batch in batches:
        for a, b, data, offsets in slices(batch["text"], 1 << 18):
            for x in range(a, b, most):
                y = min(b, x + most)
                at = offsets[x - a : y - a + 1]
                yield batch.slice(x, y - x), data[at[0] : at[-1]], at - at[0]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(1 << BITS, np.int64), 0
    for batch, data, offsets in _pieces(batches):
        values, owner, has = grams(data, offsets)
        seen = np.zeros((len(has), 1 << BITS), bool)
        seen[owner, values] = True
        total += seen.sum(0)
        n += int(has.sum())
    if n:
        group = TaskContext.get().partitionId() % FAN
        rows = np.split(total, PIECES)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(PIECES), pa.int32()), "g": pa.array([group] * PIECES, pa.int32()), "data": pa.array([np.append(x, n).astype("<i8").tobytes() for x in rows], pa.binary())})


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8") for x in table["data"].to_pylist())
    return pa.table({"i": table["i"][:1], "g": table["g"][:1], "data": pa.array([total.tobytes()], pa.binary())})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in _pieces(batches):
        values, owner, has = grams(data, offsets)
        for i in np.flatnonzero(has):
            at, count = np.unique(values[owner == i], return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": batch["lang"].slice(int(i), 1), "order": batch["order"].slice(int(i), 1), "at": pa.array([at.astype("<u4").tobytes()], pa.binary()), "tf": pa.array([(count / count.sum()).astype("<f4").tobytes()], pa.binary())})


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader; the last row is the bias, which isn't penalised by L1."""
    dim = (1 << BITS) + 1
    z, n = np.zeros((dim, n_labels)), np.zeros((dim, n_labels))

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        l1 = np.where(at == dim - 1, 0.0, L1)[:, None]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, label = rows[i]
            at, x = np.append(at, dim - 1), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(dim))
    return w[:-1], w[-1]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm from -3 to 3; on separable data it ends below 1, where the loss no longer falls."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]))

    low, high, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _predicted(model: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, weights, bias, t = model.value
    for batch, data, offsets in _pieces(batches, 1 << 20):
        values, owner, has = grams(data, offsets)
        n = np.maximum(np.bincount(owner, minlength=len(has)), 1)
        s = np.stack([np.bincount(owner, weights[c][values], minlength=len(has)) / n for c in range(len(labels))], axis=1) + bias if labels else np.zeros((len(has), 1))
        s = s / t
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        ok = has & bool(labels)
        yield pa.RecordBatch.from_pydict({
            "row": batch["row"],
            "lang_pred": pa.array([labels[i] if k else "und" for i, k in zip(best, ok)], pa.string()),
            "score": pa.array(np.where(ok, p[np.arange(len(p)), best], 0.0)),
        })


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", learn: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """``(row struct<carry>, lang_pred, score)`` for each row of ``docs``.

    ``learn`` says which rows may be learned from (default: crc32(id as text) mod 5 is not 0), if they
    have a label. Null texts and texts without a letter are ``und`` with score 0; so is every text if
    there is nothing to learn from. Ties go to the first label in order. A prediction depends on the
    text alone, so repeated rows get the same. ``carry`` names the columns to pass on (default: all).
    """
    spark = docs.sparkSession
    learn = F.expr(f"crc32(cast({doc_id} as string)) % 5 <> 0") if learn is None else learn
    train = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id), F.col(text)).alias("order"))
    df, n = np.zeros(1 << BITS), 0
    kind = "i int, g int, data binary"
    sums = train.select("text").mapInArrow(_frequencies, kind).groupBy("i", "g").applyInArrow(_add, kind).groupBy("i").applyInArrow(_add, kind)
    for r in sums.collect():
        x = np.frombuffer(r.data, "<i8")
        df[r.i * len(x[:-1]) : (r.i + 1) * len(x[:-1])], n = x[:-1], int(x[-1])
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = checkpointed(train.groupBy("lang").count())
    near = F.broadcast(sizes) if (sizes.agg(F.sum(F.octet_length("lang") + 24)).first()[0] or 0) <= SMALL else sizes
    share = F.least(F.lit(1.0), F.lit(float(PER_LABEL)) / F.col("count"))
    sample = train.join(near, "lang").where((F.pmod("order", F.lit(1 << 30)) / float(1 << 30)) < share).select("text", "lang", "order")
    rows = sorted(sample.mapInArrow(_features, "lang string, order long, at binary, tf binary").collect(), key=lambda r: (r.order, r.lang, r.at))
    labels = sorted({r.lang for r in rows})
    known = [(at := np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r.tf, "<f4") * idf[at] * SCALE, labels.index(r.lang)) for r in rows]
    if labels:
        held = known[::8] if len(known) >= 80 else []
        w, bias = ftrl([x for i, x in enumerate(known) if i % 8 or not held], len(labels))
        t = temperature(np.array([x @ w[at] + bias for at, x, _ in held]), np.array([y for *_, y in held], int))
        fitted = labels, np.ascontiguousarray((w * idf[:, None] * SCALE).T.astype(np.float32)), bias, t
    else:
        fitted = [], np.zeros((0, 1)), np.zeros(0), 1.0
    model = spark.sparkContext.broadcast(fitted)
    every = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col(text).cast("string").alias("text"))
    return every.mapInArrow(partial(_predicted, model), f"row {every.schema['row'].dataType.simpleString()}, lang_pred string, score double")
