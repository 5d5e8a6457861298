"""Phrase collocations, spelling variants and exact top-k products against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelforge.llm import collocations, spelling, topk_search


def lowered(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


# -- collocations -------------------------------------------------------------------------------------


def phrases(rows, least=10, inside=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    longer = Counter()
    for (lang, *w), a in found.items():
        if len(w) == 3:
            for part in ((lang, *w[:2]), (lang, *w[1:])):
                longer[part] = max(longer[part], a)
    by = defaultdict(list)
    for key, a in found.items():
        lang, *w = key
        if len(w) == 2 and longer[key] and 100 * longer[key] >= inside * a:
            continue
        cuts = [(10**6 * a * a // (f[(lang, *w[:c])] * f[(lang, *w[c:])]), c, f[(lang, *w[:c])], f[(lang, *w[c:])]) for c in range(1, len(w))]
        score, _, left, right = min(cuts)
        by[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in by.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


def phrase_rows():
    r = random.Random(4)
    vocab = ["New", "york", "times", "é", "x" * 40, "es", "en", "de", "a\x00b", "日本"]
    rows = [(None, None), ("en", ""), ("", "a b a b " * 20), ("en", " . ,, \t"), ("und", "one two three " * 6), (None, "One two three! " * 7), ("es", "en de en de " * 15), ("en", "es de es de " * 15), ("de", "en es en es " * 15)]
    for _ in range(60):
        rows.append((r.choice(["en", "es", "de", None]), "".join(r.choice(vocab) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(r.randint(1, 120)))))
    rows += [("en", "same same same same same")] * 9
    return rows


def found_phrases(df, **more):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, **more).collect())


@pytest.mark.parametrize("dictionary", [collocations.DICTIONARY, 3])
def test_collocations(spark, monkeypatch, dictionary):
    """With ranks as ids, and with hashes as ids past the dictionary's limit; small shards flush and merge."""
    monkeypatch.setattr(collocations, "DICTIONARY", dictionary)
    rows = phrase_rows()
    df = spark.createDataFrame([(lang, text, 1, "x", "y") for lang, text in rows], "lang string, text string, n int, phrase string, word string").repartition(3)
    assert found_phrases(df) == phrases(rows)
    assert found_phrases(df, least=2, inside=80, top=7) == phrases(rows, 2, 80, 7)


def test_collocations_of_nothing(spark):
    kind = "lang string, text string"
    for rows in ([], [("en", None)], [("en", "a b. c"), (None, "")]):
        assert found_phrases(spark.createDataFrame(rows, kind)) == []


def test_shards_flush(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "SHARD", 50)
    r = random.Random(1)
    text = " ".join(r.choice("abcdefghij") for _ in range(900))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 12, "text": [text[i * 150 : i * 150 + 149] for i in range(12)]})
    monkeypatch.setattr(collocations, "slices", lambda t, limit=64, f=collocations.slices: f(t, limit))
    blocks = list(collocations._gram_filters(64, None, 2, iter([batch])))
    assert len(blocks) > 3
    codes, got = collocations.Codes(64), Counter()
    for b in blocks:
        for row in b.to_pylist():
            lanes, counts = collocations.entries(*(row[c] for c in ("q", "runs", "remainders", "counts", "large")), 62, 3)
            lanes[0] |= np.uint64(row["part"] << 62)
            for key, n in zip(zip(*(x.tolist() for x in codes.ids_of(lanes))), counts.tolist()):
                got[key] += n
    want = Counter()
    for t in batch["text"].to_pylist():
        w = t.split()
        want.update(list(zip(w, w[1:], [""] * len(w)))[: len(w) - 1] + list(zip(w, w[1:], w[2:])))
    assert sorted(got.values()) == sorted(want.values())


@pytest.mark.parametrize("width", [3, 6, 21, 36, 57, 63, 64])
def test_the_permutation_and_the_filter_lose_nothing(width):
    r = np.random.default_rng(width)
    x = np.unique(r.integers(0, 1 << min(width, 63), 5000, dtype=np.uint64))
    y = collocations.permuted(x, width)
    assert len(np.unique(y)) == len(x) and (collocations.restored(y, width) == x).all() and int(y.max()) < 1 << width
    lanes = np.sort(y)[None]
    counts = r.integers(1, 300, len(x)) ** r.integers(1, 4, len(x))
    got, n = collocations.entries(*collocations.filtered(lanes, counts, width), width, 1)
    assert (got == lanes).all() and (n == counts).all()
    wide = np.stack([lanes[0], r.integers(0, 1 << 63, len(x), dtype=np.uint64), lanes[0]])
    got, n = collocations.entries(*collocations.filtered(wide, counts, width), width, 3)
    assert (got == wide).all() and (n == counts).all()


@pytest.mark.parametrize("bits", [1, 7, 21, 22, 64])
def test_codes_give_their_ids_back(bits):
    r = np.random.default_rng(bits)
    ids = r.integers(0, 1 << min(bits, 63), (3, 1000), dtype=np.uint64)
    codes = collocations.Codes(bits)
    assert (np.stack(codes.ids_of(codes.lanes_of(*ids))) == ids).all()


def test_filters_are_compact():
    """About three bytes an entry for codes of 36 bits, counts included."""
    r = np.random.default_rng(0)
    lanes = np.unique(r.integers(0, 1 << 36, 1 << 18, dtype=np.uint64))[None]
    _, *parts = collocations.filtered(lanes, np.ones(lanes.shape[1], np.int64), 36)
    assert sum(map(len, parts)) < 4.5 * lanes.shape[1]


# -- spelling variants ----------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= least}
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), counts


def spelled(df):
    key = lambda x: tuple((v is None, v) for v in x)
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df).collect()), key=key)


def spelling_rows():
    r = random.Random(9)
    base = ["recommendation", "receive", "öffentlich", "garçonnière", "aaaaaa", "ababab", "Straßenbahn"]
    bag = []
    for w in base:
        bag += [w] * 700
        chain = w
        for n in (120, 20, 4):  # variants of variants: forms in a row
            at = r.randrange(len(chain))
            chain = r.choice([chain[:at] + chain[at + 1 :], chain[:at] + r.choice("aébÿ") + chain[at:], chain[:at] + r.choice("aéb") + chain[at + 1 :]])
            bag += [chain] * n
        for _ in range(25):
            at = r.randrange(len(w))
            bag += [w[:at] + r.choice("xyzß") + w[at + r.choice([0, 1]) :]] * r.randint(3, 9)
    for _ in range(120):  # many words that share a half
        bag += ["common" + "".join(r.choice("ab") for _ in range(r.randint(3, 6)))] * 6
    bag += ["tiefer", "ABCdef", "abcdeg"] * 6 + ["÷×–ab12cd"]
    r.shuffle(bag)
    rows = [(i, " ".join(bag[i * 40 : i * 40 + 40])) for i in range(len(bag) // 40 + 1)]
    return rows + [(None, None), (None, "receive receive"), (7, ""), (7, " 1 2 "), (8, "receive," * 3000), (8, "receive," * 3000)]


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_spelling_variants(spark, monkeypatch, block):
    """Whole groups, and groups cut into many tiles."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = spelling_rows()
    want, _ = variants(rows)
    df = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "doc_id long, text string, word string, n int, root string").repartition(3)
    got = spelled(df)
    key = lambda x: tuple((v is None, v) for v in x)
    assert got == sorted(want, key=key)
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] not in (w[0], w[1]) for w in want)


def test_spelling_of_nothing(spark):
    kind = "doc_id long, text string"
    for rows in ([], [(1, None), (2, ""), (3, "short words only here")], [(4, "elephant " * 4)]):
        assert spelled(spark.createDataFrame(rows, kind)) == []
    assert spelled(spark.createDataFrame([(3, "elephant " * 5)], kind)) == [("elephant", None, "elephant", 5, 0, None)]


def test_near_rows_are_single_edits():
    r = random.Random(3)
    words = sorted({"".join(r.choice("aab") for _ in range(r.randint(6, 9))) for _ in range(150)})
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(words)), np.arange(len(words)), indexing="ij"))
    near, _ = spelling.near_rows(spelling.matrices(words), i, j)
    assert near.tolist() == [one_edit(words[a], words[b]) for a, b in zip(i, j)]


# -- top-k products -----------------------------------------------------------------------------------


def best_products(rows, k=10, every=100):
    v = [(i, None if x is None else [np.float64(np.float64(y) * 1024) for y in x if y is not None] if None not in x else None) for i, x in rows]
    v = [(i, [int(np.floor(y)) for y in x]) for i, x in v if x is not None and np.isfinite(x).all()]
    out = []
    for a, (i, x) in enumerate(v):
        if i is not None and i % every == 0:
            scores = sorted((-sum(p * q for p, q in zip(x, y)), (j is None, j), j) for b, (j, y) in enumerate(v) if b != a and len(x) == len(y))
            out += [(i, n + 1, j, -s) for n, (s, _, j) in enumerate(scores[:k])]
    return sorted(out, key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3]))


def top(df, **more):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_products(df, **more).collect()), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3]))


def vector_rows():
    r = np.random.default_rng(6)
    rows = []
    for i in range(1200):  # lengths from 0.02 to 50, tight groups, many alike
        x = r.standard_normal(12) * np.exp(r.uniform(-4, 4))
        rows.append((i, x.tolist()))
    centre = r.standard_normal((5, 12)) * 3
    rows += [(2000 + i, (centre[i % 5] + 0.05 * r.standard_normal(12)).tolist()) for i in range(400)]
    rows += [(3000 + i, centre[0].tolist()) for i in range(60)]
    rows += [(4000, [0.0] * 12), (4100, [-1e-9] * 12), (4200, None), (4300, [float("nan")] * 12), (4400, [1.0, float("inf")]), (4500, [1.0, None]), (4600, []), (4601, []), (4700, [1.0, -2.0]), (4701, [3.0, 0.5]), (None, centre[1].tolist()), (None, [9.0, 9.0])]
    rows += [(2000, rows[1200][1]), (2000, (2 * centre[0]).tolist()), (-100, (-centre[0]).tolist())]
    return rows


@pytest.mark.parametrize("piece, first", [(topk_search.PIECE, topk_search.FIRST), (24 * 400, 1), (24 * 20, 2)])
def test_top_products(spark, monkeypatch, piece, first):
    """Whatever the pieces, the queries at a time and the first scores to beat."""
    monkeypatch.setattr(topk_search, "PIECE", piece)
    monkeypatch.setattr(topk_search, "FIRST", first)
    if first == 1:
        monkeypatch.setattr(topk_search, "CHUNK", 2000)
    rows = vector_rows()
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(3)
    assert top(df) == best_products(rows)


def test_top_products_of_few(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0])], [(100, [1.0])], [(100, None), (200, [2.0])], [(100, [1.0]), (5, [2.0]), (200, [-1.5]), (7, [1e17])]):
        df = spark.createDataFrame(rows, kind)
        assert top(df) == best_products([r for r in rows if r[0] != 7])


def test_products_beyond_doubles_are_exact(spark):
    rows = [(100, [3.0e5 + 1 / 1024, 2.0e5]), (1, [2.9e5 + 3 / 1024, 1.0]), (2, [2.9e5 + 2 / 1024, 1.0 + 1 / 1024]), (3, [1.0e6, 1.0e6 + 5 / 1024])]
    assert top(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == best_products(rows)


def test_regions_hold_all_vectors_of_that_cosine():
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in x[:20]:
        cosine = x @ q
        for t in (-0.9, -0.2, 0.0, 0.5, 0.95, 1.0):
            low, high = topk_search.regions(q, np.full(3, t))
            good = x[cosine >= t]
            assert ((good >= low) & (good <= high)).all()


def test_pieces_are_bought_by_coordinates_or_by_length(monkeypatch):
    """A high score to beat is met by coordinates, a low one by length; both find the same."""
    r = np.random.default_rng(1)
    y = np.floor(1024 * r.standard_normal((4000, 16))).astype(np.int64)
    y = y[np.argsort(-(y.astype(float) ** 2).sum(1), kind="stable")]

    def piece(x, start=0):
        return {"dim": 16, "band": 0, "n": len(x), "longest": float(np.sqrt((x.astype(float) ** 2).sum(1).max())), "width": 8, "rows": np.arange(start, start + len(x)).tobytes(), "ids": np.arange(start, start + len(x)).tobytes(), "data": x.tobytes()}

    q = np.floor(y[::400] * 0.9).astype(np.int64)
    want = np.sort(q @ y.T, axis=1)[:, -10:]
    for floors in ({}, {10_000 + i: int(want[i, 0]) for i in range(len(q))}):
        for picked in (0.0, 1e9):
            monkeypatch.setattr(topk_search, "PICKED", picked)
            found = topk_search.Queries([piece(q, 10_000)], floors, 10)
            topk_search.search_piece(found, piece(y))
            order = [int(v) - 10_000 for v in found.rows]
            assert all(sorted(found.found[k][0].tolist()) == want[i].tolist() for k, i in enumerate(order))
