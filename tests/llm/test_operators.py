"""Each operator against a brute-force version, on edge cases: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.llm import blocks, context_mixing, decontaminate, embedding_dedup, language_id, licenses, ngram_jaccard, source_mixing, substring, text, url_filter, warc_zip
from panelforge.llm.graph import components

rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8))) for _ in range(300)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCAB) for _ in range(n)]


def texts():
    base = words(120, 1)
    out = {1: None, 2: "", 3: " \t\n ", 4: "one two", 5: "ONE  two", 6: " ".join(base), 7: "\t".join(base), 8: " ".join([*base[:60], "CHANGED", *base[61:]])}
    out[9] = " ".join([*words(50, 2), *base[20:70], *words(50, 3)])
    out[10] = " ".join(words(6000, 4))
    for i in range(11, 40):  # a group of near copies, some of them only near each other
        w = list(base)
        for j in random.Random(i).sample(range(len(w)), i % 5 + 1):
            w[j] = f"x{i}{j}"
        out[i] = " ".join(w)
    for i in range(40, 60):
        out[i] = " ".join(words(30 + i, i))
    out[60] = " ".join([*words(40, 60)] * 3)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 9 == 0 else "en", f"s{i % 3}" if i % 7 else None, i, "k", 1.5, "r") for i, t in texts().items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, part int, key string, score double, row string").repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def split(t, lower=True):
    t = t or ""
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t)


def shingle_set(t):
    w = split(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_and_hashes_match_python():
    t = ["a  b\tc", "", None, "éé ñ", " x ", "word " * 2000]
    import pyarrow as pa

    got = []
    for _, _, data, offsets in text.slices(pa.array(t), 64):
        starts, ends, doc = text.spans(data, offsets)
        got += [(data[a:b].tobytes().decode()) for a, b in zip(starts, ends)]
    assert got == [w for x in t for w in (x or "").split()]
    h = text.word_hashes(np.frombuffer(b"ab cd ab", np.uint8), np.array([0, 3, 6]), np.array([2, 5, 8]))
    assert h[0] == h[2] != h[1]


def test_blocks_round_trip():
    v = text.mix(np.arange(1000, dtype=np.uint64))
    own = np.sort(np.random.default_rng(0).integers(0, 7, 1000))
    rows = blocks.block_rows(v, own, np.arange(7) * 100, 5)
    import pyarrow as pa

    tails, owner = blocks.block_values(pa.Table.from_batches([rows]))
    low = np.uint64((1 << 40) - 1)
    assert sorted(zip(tails.tolist(), owner.tolist())) == sorted(zip((v & low).tolist(), (own * 100).tolist()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 150)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_components(docs, none):
    t = texts()
    sets = {i: shingle_set(x) for i, x in t.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    twice = ngram_jaccard.jaccard_components(docs.unionAll(docs)).collect()
    assert len(twice) == 2 * len(sets) and {(r.doc_id, r.component_id) for r in twice} == {(i, want[i]) for i in sets}
    assert ngram_jaccard.jaccard_components(none).count() == 0


def test_jaccard_counts_hot_shingles_apart(spark):
    """Lines that most sets hold, copies of a set, and sets of hot shingles only: the rows are those without hot shingles."""
    line = " ".join(words(30, 90))
    t = {i: f"{line} {' '.join(words(8 + 3 * (i % 7), 200 + i // 3))}" + " more" * (i % 3 == 1) for i in range(60)}
    t |= {60: line, 61: line, 62: f"{line} end", 63: "", 64: t[5], 65: t[5], 66: "few words"}
    sets = {i: shingle_set(x) for i, x in t.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union(sets, links)
    for parts, hot in ((2, 2), (1, 10)):
        docs = spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(parts)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs, hot=hot).collect()}
        assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_hot_shingles_are_counted_once_a_set(monkeypatch):
    n, keys = np.array([2, 2, 1, 3]), np.array([7, 7, 8, 9])
    values = np.array([1, 5, 1, 5, 5, 2, 3, 5], np.uint64)
    seen = ngram_jaccard.Frequent()
    for _ in range(3):
        seen.add(values, n, keys)
    assert (seen.values.tolist(), seen.counts.tolist()) == ([5], [9])
    monkeypatch.setattr(ngram_jaccard, "COUNTED", 4)
    seen.add(np.tile(np.arange(10, 15, dtype=np.uint64), 2), np.array([5, 5]), np.array([1, 2]))
    assert len(seen.values) == 2 and 5 in seen.values  # the rarest are forgotten, the most frequent stays
    rows = ngram_jaccard._universe(5, 4, type("B", (), {"value": b""}), iter([]))
    assert list(rows) == []
    keys = np.array([3, -4, 9], np.int64)
    table = pa.Table.from_batches([blocks.count_rows(keys, np.array([1, 2, 3]), text.mix(keys.view(np.uint64)), 4)])
    assert sorted(zip(*(x.tolist() for x in blocks.count_values(table)))) == [(-4, 2), (3, 1), (9, 3)]


def test_jaccard_judges_rows_of_one_id_by_their_own_texts(spark):
    a, b, c = (" ".join(words(60, i)) for i in (70, 71, 72))
    rows = [(5, a), (5, b), (7, b + " tail"), (3, a + " tail"), (None, c), (9, c + " x"), (None, ""), (5, a)]
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.component) for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda r: r[:2])
    assert [r[:2] for r in got] == [(0, 0), (0, 9), (3, 3), (5, 3), (5, 3), (5, 5), (7, 5), (9, 9)]
    of = {}
    for d, c_, k in got:
        of.setdefault(k, set()).add(c_)
    assert {frozenset(v) for k, v in of.items() if k is not None} == {frozenset({3}), frozenset({5}), frozenset({9})}


@pytest.mark.parametrize("seed", range(3))
def test_units_cover_the_bound(seed):
    """Every linked pair shares a signature, whichever way the differing shingles fall."""
    r = np.random.default_rng(seed)
    for n in (1, 2, 3, 4, 5, 9, 17, 40, 150):
        base = r.integers(0, 1 << 63, n, dtype=np.uint64)
        drop = r.integers(0, n // 4 + 1)
        other = base[drop:]
        if 100 * len(other) < 75 * n:
            continue
        sides = []
        for values in (np.sort(base), np.sort(other)):
            n_, b = np.array([len(values)]), np.searchsorted(ngram_jaccard.BANDS, len(values))
            sides.append((values, n_, b))
        (big, nb, bb), (small, ns, bs) = sides
        mixed, seg, who, tag, content, length = ngram_jaccard._segments(small, ns, np.array([bs]))
        index = set(text.mix(content + tag).tolist()), set(text.mix(content[seg] - mixed + tag[seg]).tolist())
        out = []
        need = (nb + (nb if bs == bb else ngram_jaccard.BANDS[np.array([bs])])) * 25 // 175 + 1
        ngram_jaccard._probe(out, *ngram_jaccard._segments(big, nb, np.array([bs])), need, np.array([0]))
        exact, near, residue = (set(x[0].tolist()) for x in out)
        assert (exact | near | residue) & index[0] or near & index[1]


def test_sketch_bounds_the_difference():
    r = np.random.default_rng(1)
    for n in (3, 50, 400):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 5 :], r.integers(0, 1 << 63, n // 7, dtype=np.uint64)])
        x, y = (np.frombuffer(ngram_jaccard._sketch(v), "<u8") for v in (a, b))
        w = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, w), axis=0) for v in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_embedding_components(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((150, 16))
    rows = base.tolist() + (base[:40] + 0.1 * r.standard_normal((40, 16))).tolist() + base[:5].tolist() + (3 * base[:5]).tolist() + [[0.0] * 16, [float("nan")] * 16, [float("inf")] * 16]
    data = [(i, v, "x") for i, v in enumerate(rows)] + [(900, None, "x"), (901, [1.0, None], "x"), (902, [], "x")]
    got = {x.vec_id: x for x in embedding_dedup.embedding_components(spark.createDataFrame(data, "vec_id long, embedding array<double>, node string")).collect()}
    x = np.array(rows[:200])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    want = union(range(200), [(int(a), int(b)) for a, b in zip(*np.nonzero(s))])
    for i in range(200):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (s[i].sum(), want[i], want[i] == i)
    for i in (200, 201, 202, 900, 901, 902):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def cosines(rows):
    x = np.array(rows, float)
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_embedding_rows_keep_repeated_and_null_ids_and_extreme_norms(spark):
    r = np.random.default_rng(8)
    base = r.standard_normal((6, 8)).tolist()
    rows = [(1, base[0]), (1, base[1]), (1, base[0]), (2, base[1]), (None, base[1]), (None, base[2]), (3, [1e200, 0.0]), (4, [1e200, 1.0]), (5, [1e-200, 1e-210]), (6, [0.0, -1e-300]), (7, [1.0]), (8, [5.0]), (9, [-2.0])]
    got = embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(1, 1, 1, True), (1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 0, None, True), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("noise", [0.004, 0.03, 0.1])
def test_embedding_groups_of_near_copies(spark, monkeypatch, noise):
    """Tight balls, balls whose edges lie about the threshold, and loose groups; small pieces."""
    monkeypatch.setattr(embedding_dedup, "PIECE", 100)
    r = np.random.default_rng(4)
    base = r.standard_normal((3, 16))
    other = base + 0.48 * r.standard_normal((3, 16))  # next to the threshold
    rows = np.concatenate([np.repeat(base, 150, 0), np.repeat(other, 60, 0), r.standard_normal((300, 16))])
    rows = (rows + noise * r.standard_normal(rows.shape)).astype(np.float32)
    rows = np.concatenate([rows, rows[:80]]).tolist()
    s = cosines(rows) >= 0.9
    np.fill_diagonal(s, False)
    want = union(range(len(rows)), [(int(a), int(b)) for a, b in zip(*np.nonzero(s))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id int, embedding array<float>").repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.embedding_components(df).collect()}
    found, all_ = sum(x[0] for x in got.values()), int(s.sum())
    assert 0.999 * all_ <= found <= all_ and all(n <= s[i].sum() for i, (n, *_) in got.items())
    assert sum(got[i] == (s[i].sum(), want[i], want[i] == i) for i in got) >= 0.97 * len(got)


def test_collision_count_and_ends_are_calibrated():
    r = np.random.default_rng(6)
    for n in (2000, 100_000, 10_000_000):
        plan = embedding_dedup.Plan(n, math.acos(0.9))
        x, z = r.standard_normal((2, 600, 24))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = 0.9 * x + math.sqrt(0.19) * z
        met = [bool(set(a) & set(b)) for a, b in zip(plan.lists(x)[0].tolist(), plan.lists(y)[0].tolist())]
        near = np.abs(plan.sketch(x).astype(int) - plan.sketch(y)) <= embedding_dedup.STEPS + 1
        assert np.mean(met) >= 0.995 and np.mean(near.sum(1) >= plan.whole) >= 0.995 and np.mean(near[:, : embedding_dedup.FIRST].sum(1) >= plan.first) >= 0.995
        assert np.mean(np.abs(plan.sketch(x).astype(int) - plan.sketch(z)) <= embedding_dedup.STEPS + 1) < 0.5


def removed(t, window):
    w = {i: split(x, False) for i, x in t.items()}
    c = Counter(tuple(x[j : j + window]) for x in w.values() for j in range(len(x) - window + 1))
    out = {}
    for i, x in w.items():
        keep = [True] * len(x)
        for j in range(len(x) - window + 1):
            if c[tuple(x[j : j + window])] > 1:
                keep[j : j + window] = [False] * window
        kept = " ".join(y for y, k in zip(x, keep) if k)
        out[i] = (len(x), keep.count(False), kept, hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_without_repeats(docs, none):
    got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in substring.without_repeats(docs).collect()}
    assert got == removed(texts(), 35)
    assert all(r.n_removed == r.n_words or r.n_words < 35 for r in substring.without_repeats(docs.unionAll(docs), carry=["doc_id"]).collect())
    assert substring.without_repeats(none).count() == 0


def test_mixing_scores(docs, none):
    t = texts()
    w = {i: [*split(x), 0] for i, x in t.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in t}
    c = Counter(x for i in t if not held[i] for x in w[i])
    n, v = sum(c.values()), len(c)
    for times, df in ((1, docs), (2, docs.unionAll(docs))):
        for r in context_mixing.mixing_scores(df).collect():
            base = sum(math.log10((times * c[x] + 0.5) / (times * n + 0.5 * (v + 1))) for x in w[r.doc_id])
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w[r.doc_id]), sum(c[x] > 0 for x in w[r.doc_id]), times * n)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0
            assert r.n_bytes == len((t[r.doc_id] or "").encode())
    assert context_mixing.mixing_scores(none).count() == 0
    assert all(r.base_score == 0 and r.n_known == 0 for r in context_mixing.mixing_scores(docs, held_out=F.lit(True)).collect())


def test_model_learns(docs, spark):
    rows = [(i, "the cat sat on the mat and ate " * 20, i % 5 == 0) for i in range(30)] + [(99, "".join(chr(33 + (i * 37) % 90) for i in range(600)), True)]
    got = {r.doc_id: r.bits_per_byte for r in context_mixing.mixing_scores(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), held_out=F.col("held")).collect()}
    assert got[0] < 0.5 < 3 < got[99]


LICENCE = [
    ("Released UNDER the MIT License.", 1, "mit", "mit"),
    ("the Apache License, Version 2.0 and under the mit-license / CC BY-NC 4.0", 3, "apache-2,cc-by-nc,mit", None),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\nx", 0, "", "apache-2,gpl-2,mit"),
    ("licensed under CC BY-NC-SA 4.0, cc by 4.0", 1, "cc-by-nc", "cc-by,cc-by-nc,cc-by-nc-sa"), ("CC BY-NC-SA", 1, "cc-by-nc", "cc-by-nc,cc-by-nc-sa"),
    ("Apache License, Version 2.0\nSPDX-License-Identifier: Apache-2.0", 1, "apache-2", "apache-2"), ("SPDX-License-Identifier: whatever-you-like", 0, "", ""),
    (None, 0, "", ""), ("", 0, "", ""), ("summit licensee", 0, "", ""), ("é under the mit licensé", 0, "", ""),
    ("under the mit license under the mit license", 2, "mit", "mit"),
]


def test_license_scan(spark, none):
    df = spark.createDataFrame([(i, t, "c") for i, (t, *_) in enumerate(LICENCE)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    for i, (t, n, base, labels) in enumerate(LICENCE):
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [j for p in licenses.BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), n, min(at, default=None), max(at, default=None), base)
        assert len(at) == n and 0 <= r.score <= 1 and set(base.split(",")) - {""} <= set(r.labels.split(","))
        if labels is not None:
            assert r.labels == labels
    assert licenses.license_scan(none).count() == 0


def test_expressions_are_evaluated():
    value = lambda x: licenses.evaluate(licenses.postfix(x))
    level = lambda x: value(x)[3]
    assert level("MIT OR AGPL-3.0-only") == 0 and level("MIT AND AGPL-3.0-only") == 4 and level("MIT OR Apache-2.0 AND GPL-3.0+") == 0
    assert level("(MIT OR Apache-2.0) AND GPL-3.0-or-later") == 3 and level("GPL-2.0 WITH Classpath-exception-2.0") == 2
    assert level("MIT AND Mine-1.0") is None and level("MIT OR Mine-1.0") == 0 and value("MIT OR Mine-1.0")[1:3] == ({"Mine-1.0"}, True)
    assert {licenses.family(x)[0] for x in ("GPL-2.0", "GPL-2.0+", "gpl-2.0-only", "GPL-2.0-or-later")} == {"gpl-2"} and licenses.family("x") is None


def test_license_scan_is_linear_in_places():
    import time

    finder, took = licenses.automaton(), []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        row = licenses.scan(finder, b"x under the MIT license " * n)
        took.append(time.perf_counter() - start)
        assert row[1] == n and row[2] == 1 and row[3] == 5 * n - 4
    assert took[1] < 10 * took[0]


def test_expressions():
    assert licenses.postfix("MIT or Apache-2.0 and GPL-2.0 with X") == ["MIT", "Apache-2.0", "GPL-2.0", "X", "with", "and", "or"]
    assert licenses.postfix("(MIT or BSD) and X") == ["MIT", "BSD", "or", "X", "and"]
    assert licenses.postfix("MIT and") == ["MIT"] and licenses.postfix("and MIT") is None and licenses.postfix("") is None


def test_warc_round_trip(spark):
    html = ["<p>é</p>", "x" * 5000, None, "<p>é</p>", "", "a\r\n\r\nb", "<p>é</p>"]
    df = spark.createDataFrame([(i, f"http://h/{i}", h, "n") for i, h in enumerate(html)], "page_id long, url string, html string, name string").repartition(2)
    packages = warc_zip.write_packages(df, limit=200)
    assert packages.count() > 1
    got = {int(r.page_id): r for r in warc_zip.read_packages(packages, payloads=True).collect()}
    first: dict = {}
    for i, h in enumerate(html):
        body = (h or "").encode()
        r, to = got[i], first.setdefault(body, i)
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if to == i else ("revisit", str(to)))
        assert r.html == ((h or "") if to == i else None)
    assert all(r.error is None and r.url == f"http://h/{i}" for i, r in got.items())
    assert warc_zip.read_packages(warc_zip.write_packages(df.limit(0))).count() == 0
    twice = warc_zip.read_packages(warc_zip.write_packages(df.unionAll(df).withColumn("first", F.lit("clash")).withColumn("id", F.lit(0)))).collect()
    assert len(twice) == 2 * len(html) and all((r.record_type, r.refers_to) == (got[int(r.page_id)].record_type, got[int(r.page_id)].refers_to) for r in twice)


def test_warc_files_are_read_by_ranges_and_damage_is_told(spark, tmp_path):
    import gzip

    records = [(f"http://b.a/{i}?x y", gzip.compress(warc_zip.record(str(i), f"http://b.a/{i}?x y", b"p" * (i * 100), None))) for i in range(300)]
    good = warc_zip.package(records)
    at = good.index(records[7][1])
    (tmp_path / "good.wacz").write_bytes(good)
    (tmp_path / "bad.wacz").write_bytes(good[: at + 30] + bytes([good[at + 30] ^ 255]) + good[at + 31 :])
    (tmp_path / "none.wacz").write_bytes(b"no package")
    rows = warc_zip.read_packages(warc_zip.packages_at(spark, f"{tmp_path}/*.wacz")).collect()
    assert sorted(int(r.page_id) for r in rows if r.error is None) == sorted([*range(300), *(set(range(300)) - {7})])
    assert len([r for r in rows if r.error]) == 2 and all(r.payload_bytes == 100 * int(r.page_id) for r in rows if r.error is None)
    assert warc_zip.sort_key("http://www.B.com/x y?q#f") == "com,b,www)/x%20y?q#f"
    asked = []
    p = warc_zip.Package(lambda a, n: asked.append(n) or good[a : a + n], len(good))
    assert len(list(p.records())) == 300 and sorted(asked)[-3] < 1000  # beside the end of the file and the index, only records


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_reader_reads_ranges(tmp_path, zip64):
    import gzip
    import io
    import zipfile

    records = [("http://u", gzip.compress(warc_zip.record(str(i), "u", b"p" * i, None))) for i in range(5)]
    data = bytearray(warc_zip.package(records, zip64))
    asked = []

    def read_at(at, n):
        asked.append(n)
        return bytes(data[at : at + n])

    p = warc_zip.Package(read_at, len(data))
    assert sorted(len(x[2]) for x in p.records()) == list(range(5))
    assert zipfile.ZipFile(io.BytesIO(bytes(data))).testzip() is None
    if zip64:  # the end of the directory moved to its 64-bit form
        import struct

        at = data.rfind(b"PK\5\6")
        count, size, start = struct.unpack("<H2I", data[at + 10 : at + 20])
        end = b"PK\6\6" + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, count, count, size, start)
        whole = bytes(data[:at]) + end + b"PK\6\7" + struct.pack("<IQI", 0, at, 1) + b"PK\5\6" + b"\0\0\0\0" + struct.pack("<2H2IH", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        p = warc_zip.Package(lambda a, n: whole[a : a + n], len(whole))
        assert sorted(len(x[2]) for x in p.records()) == list(range(5))


def test_mix_sources(docs, none, spark):
    taken = source_mixing.mix_sources(docs, repeats=2.0, entropy=None)
    rows = taken.select("row.doc_id", "row.source", "n_tokens", "weight", "epoch", "block").collect()
    t = texts()
    assert {r.doc_id for r in rows} == set(t)  # every document at least once
    assert all(r.n_tokens == len(split(t[r.doc_id])) for r in rows)
    tokens: Counter = Counter()
    for i, x in t.items():
        tokens[f"s{i % 3}" if i % 7 else None] += len(split(x))
    weight = {r.source: r.weight for r in rows}
    assert sum(weight.values()) == pytest.approx(1)
    passes = {s: weight[s] / tokens[s] for s in tokens}
    assert max(passes.values()) / min(passes.values()) <= 2.0 + 1e-6
    logs = {s: (math.log(tokens[s] / sum(tokens.values())), math.log(weight[s])) for s in tokens}
    a, b = max(logs.values()), min(logs.values())
    slope = (a[1] - b[1]) / (a[0] - b[0])
    assert all(v[1] - b[1] == pytest.approx(slope * (v[0] - b[0]), abs=1e-6) for v in logs.values())  # one exponent
    for s in tokens:
        copies = Counter((r.doc_id, r.epoch) for r in rows if r.source == s)
        assert max(copies.values()) == 1
        spent = sum(r.n_tokens for r in rows if r.source == s)
        want = passes[s] / min(passes.values()) * tokens[s]
        assert want - 1e-6 <= spent <= want + max(len(split(x)) for x in t.values())
    assert source_mixing.mix_sources(none).count() == 0
    assert source_mixing.mix_sources(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).count() == 1


def test_bisection_meets_the_entropy(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "_source string, tokens long").withColumn("total", F.lit(1110.0))
    x = source_mixing.exponent_for(s, None, 0.8)
    assert source_mixing._states(s, [x])[0][0] == pytest.approx(0.8, abs=1e-5) and source_mixing._states(s, [x - 1e-4])[0][0] > 0.8


def test_language_id(spark, none):
    en, fr = ["the", "and", "with", "house", "there"], ["le", "été", "où", "maison", "français"]
    rows = [(i, " ".join(random.Random(i).choices(en if i % 2 else fr, k=12)) + " 123 *** ", "en" if i % 2 else "fr") for i in range(120)]
    rows += [(200, None, "en"), (201, "", None), (202, "123 *** 456", "fr"), (203, "the house and there", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), carry=["doc_id"]).select("row.doc_id", "lang_pred", "score").collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120]) and got[203].lang_pred == "en"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (200, 201, 202))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    s = r.standard_normal((4000, 3))
    y = np.array([r.choice(3, p=np.exp(x) / np.exp(x).sum()) for x in s])
    assert language_id.temperature(4 * s, y) == pytest.approx(4, rel=0.15)


URLS = [
    ("http://Example.NET/en/1?x", "example.net", "/en/1", "example.net/en/", "allow"), ("https://a.example.net/fr/", "a.example.net", "/fr/", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"), ("http://badexample.com/de/x", "badexample.com", "/de/x", None, "allow"), ("x.example.com/de/", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("http://www.Spam.com/a.html#f", "www.spam.com", "/a.html", None, "block"), ("ftp://spam.com/a/", "spam.com", "/a/", None, "block"),
    ("http://spam.com/b", "spam.com", "/b", None, "allow"), ("http://q.org/fr/http://x.net/", "q.org", "/fr/http://x.net/", "org/fr/", "allow"), ("http:///p", "", "/p", None, "allow"),
]


@pytest.mark.parametrize("small", [16 << 20, 300, 0])
def test_url_verdicts(spark, monkeypatch, small):
    monkeypatch.setattr(url_filter, "SMALL", small)
    pages = spark.createDataFrame([(i, u, "x") for i, (u, *_) in enumerate(URLS)], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("http://spam.com/a",), (None,), ("nothing",), ("http://spam.com/a",)], "url string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, listed).collect()}
    for i, (_, *want) in enumerate(URLS):
        assert [got[i].host, got[i].path, got[i].rule, got[i].verdict] == want
    twice = url_filter.url_verdicts(pages.unionAll(pages).withColumn("listed", F.lit("clash")).withColumn("_url", F.lit(1)), listed)
    assert twice.count() == 2 * len(URLS) and twice.columns == ["page_id", "host", "path", "rule", "verdict", "listed"]
    assert url_filter.url_verdicts(pages, listed.limit(0)).count() == len(URLS) and url_filter.url_verdicts(pages.limit(0), listed).count() == 0


def test_bloom_filter_has_no_false_negative(spark):
    entries = spark.range(3000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("_url"))
    table, n = url_filter.bloom_filter(entries, 3000)
    hit = lambda df: df.join(table, url_filter._block(F.col("_url"), n) == F.col("_block")).where(F.col("_word").bitwiseAND(url_filter._bits(F.col("_url"))) == url_filter._bits(F.col("_url"))).count()
    assert hit(entries) == 3000
    assert hit(spark.range(3000, 6000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("_url"))) < 900


ITEM = "A train leaves Paris at 9 and travels 120 km towards Lyon while another leaves Lyon at 11 so when do they meet on the way"


def test_leaks(spark, none):
    swap = ITEM.replace("Paris", "Rome").replace("Lyon", "Milan").replace("120", "3,450").replace(" 9 ", " 7 ")
    broken = ITEM.replace("towards Lyon while another leaves Lyon", "towards Rome while another leaves Milan").replace("Paris", "Paris")
    other = "He said that nobody knew when the old house by the river was built or by whom it was sold in the end"
    rows = [(1, f"Filler words. {ITEM.upper()}"), (2, f"xx {ITEM} yy"), (3, f"First. {swap}. Then."), (4, other), (5, None), (6, ""), (7, ITEM[:60]), (8, "1 2 3 4 5 6 7 8 9 10 " * 30), (2, f"xx {ITEM} yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(70, ITEM, 1), (71, None, 1), (72, "", 1), (73, "too short", 1)], "item_id long, text string, doc_id long")
    got = [(r.doc_id, r.item_id, r.changed) for r in decontaminate.leaks(df, bench).collect()]
    assert {(2, 70, False), (3, 70, True)} <= set(got) and got.count((2, 70, False)) == 2
    assert not {d for d, *_ in got} & {4, 5, 6, 8}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0
    assert not decontaminate._consistent(np.array([1, 1, 2]), np.array([5, 6, 7])) and decontaminate._consistent(np.array([1, 1, 2]), np.array([5, 5, 7]))
    assert broken != ITEM


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(0, " ".join(words(80, 50)[:30]))], "item_id long, text string")
    rows = texts()
    plain = spark.createDataFrame([(i, x, "en" if i % 2 else "fr", f"s{i % 3}", len(x or ""), "extra") for i, x in rows.items()], "doc_id long, text string, lang string, source string, n_chars long, weight string")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language_id"](spark, plain, str(tmp_path))
    assert {r.doc_id for r in known.collect()} == {i for i, x in rows.items() if (x or "").strip()} and known.columns == plain.columns
    one = stage["ngram_jaccard"](spark, known, str(tmp_path))
    sets = {r.doc_id: shingle_set(r.text) for r in known.collect()}
    comp = union(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert {r.doc_id for r in one.collect()} == {i for i in sets if comp[i] == i} and one.columns == plain.columns
    kept = {r.doc_id: r.text for r in stage["substring_dedup"](spark, one, str(tmp_path)).collect()}
    want = removed({r.doc_id: r.text for r in one.collect()}, 35)
    assert {i: split(x, False) for i, x in kept.items()} == {i: split(w[2], False) for i, w in want.items()}
    clean = stage["decontamination"](spark, one, str(tmp_path))
    assert {r.doc_id for r in one.collect()} - {r.doc_id for r in clean.collect()} == {50} and clean.columns == plain.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "doc_id" in out.columns
    twice = stage["ngram_jaccard"](spark, known.unionAll(known), str(tmp_path))
    assert twice.count() == one.count()


@pytest.mark.parametrize("small", [16 << 20, 0])
def test_leaks_match_brute_force_broadcast_and_shuffled(spark, monkeypatch, small):
    monkeypatch.setattr(decontaminate, "SMALL", small)
    r = random.Random(12)
    vocab = [v for v in VOCAB if len(v) > 2 and v not in decontaminate.UNITS][:120]
    items = {i: [r.choice(vocab) for _ in range(r.choice([1, 3, 7, 8, 9, 20, 45]))] for i in range(60)}
    docs = {}
    for d in range(150):
        w = [r.choice(vocab) for _ in range(r.choice([0, 5, 30, 80]))]
        for i in r.sample(sorted(items), r.randint(0, 2)):
            a = r.randrange(len(items[i]))
            cut = items[i][a : a + r.randint(1, 45)] if r.random() < 0.5 else items[i]
            at = r.randint(0, len(w))
            w[at:at] = cut
        docs[d] = w
    docs[150] = docs[3] * 400  # a long text
    want = set()
    for d, w in docs.items():
        for i, x in items.items():
            k = min(8, len(x))
            mine = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            n, total = sum(tuple(x[j : j + k]) in mine for j in range(len(x) - k + 1)), len(x) - k + 1
            if n >= decontaminate.ENOUGH or n and n >= decontaminate.COVER * total:
                want.add((d, i, n, round(n / total, 9), False))
    df = spark.createDataFrame([(d, " ".join(w), "x") for d, w in docs.items()] + [(3, " ".join(docs[3]), "x"), (500, None, "x")], "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(x), 1) for i, x in items.items()] + [(900, None, 1), (None, "abc", 1)], "item_id long, text string, key int")
    got = [(x.doc_id, x.item_id, x.n_windows, round(x.coverage, 9), x.changed) for x in decontaminate.leaks(df, bench).collect()]
    assert set(got) == want and len(want) > 60
    assert len(got) == len(want) + sum(d == 3 for d, *_ in want)  # the repeated row repeats its pairs
    swap = ITEM.replace("Paris", "Rome").replace("Lyon", "Milan").replace("120", "3,450")
    x = decontaminate.leaks(spark.createDataFrame([(1, f"So. {swap}.")], "doc_id long, text string"), spark.createDataFrame([(70, ITEM)], "item_id long, text string")).collect()
    assert [(y.doc_id, y.item_id, y.changed) for y in x] == [(1, 70, True)]


def test_leaks_in_capitals(spark):
    plain = "He said that nobody knew when the old été house by the river was built or by whom it was sold in the end"
    df = spark.createDataFrame([(1, f"x. {plain.upper()}!! y"), (2, plain.upper()[:40]), (3, plain.replace("é", "e"))], "doc_id long, text string")
    got = {r.doc_id for r in decontaminate.leaks(df, spark.createDataFrame([(5, plain)], "item_id long, text string")).collect()}
    assert 1 in got and 2 not in got


def test_leaks_judges_slots_by_window_and_finds_items_without_template(spark):
    ask = "a farmer has 3 red apples in the first of 3 baskets and then 4 boys come to take all of them away before the evening"
    other = {1: ask.replace("of 3", "of 5"), 2: ask.replace("has 3", "has 5").replace("of 3", "of 7"), 3: ask.replace("3", "5").replace("4", "5")}
    tail = "and then we all went home after it"
    exact = {5: f"he wrote 12. 3 km 5 kg 7 on it {tail}", 6: f"Then they saw What Now? {tail}", 7: f"first 31 41 59 26 53 58 97 93 23 84 {tail}", 8: f"first 31 41 59 26 {tail}", 9: f"he wrote 3 km 5 kg 8 {tail}"}
    df = spark.createDataFrame([*other.items(), *exact.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(70, ask), (71, "3 km 5 kg 7"), (72, "what now"), (73, "31 41 59 26 53 58 97 93 23 84")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.coverage, r.changed) for r in decontaminate.leaks(df, bench).collect()}
    assert {(d, 70) for d in (1, 2, 3)} | {(5, 71), (6, 72), (7, 73)} == set(got)
    assert all(got[d, 70][2] for d in (1, 2, 3)) and all(got[d, 70][1] == 1 for d in (1, 2, 3))
    assert got[5, 71] == (1, 1.0, False) and got[6, 72] == (1, 1.0, False) and got[7, 73] == (3, 1.0, False)
    crossed = decontaminate._counted(np.array([0, 10, 20, 30]), np.array([1, 1, 2, 2], np.uint64), np.array([5, 6, 6, 5], np.uint64), np.arange(31), 8)
    assert 0 < len(crossed[0]) < 31


def test_mixing_counts_every_context():
    r = np.random.default_rng(3)
    data = r.integers(97, 101, 4000).astype(np.uint8)
    keys, n = context_mixing.merged(context_mixing.sextuples(data, np.array([0, 4000])), np.full(4000, 1 << 25))  # past what float32 adds by ones
    single = np.zeros(1 << 16, np.int64)
    np.add.at(single, (keys & np.uint64(0xFFFF)).astype(int), n)
    paths = context_mixing.Counts(single, keys, n).paths(keys)
    every = list(zip(keys.tolist(), n.tolist()))
    for i in range(0, len(keys), 97):
        for o, order in enumerate(context_mixing.ORDERS):
            for d in range(9):
                same = lambda k: (k & ((1 << 8 * (order + 1)) - 1)) >> (8 - d)  # noqa: B023, E731
                assert paths[o, d, i] == sum(c for k, c in every if same(k) == same(int(keys[i])))


def brute_mixing(t, held):
    """The whole score again: dictionaries of counts, one sextuple after the other."""
    m = context_mixing
    grams = {i: [int.from_bytes(bytes(reversed((b"\0" * 5 + x)[j : j + 6])), "little") for j in range(len(x))] for i, x in t.items()}
    train = Counter(g for i, x in grams.items() if not held[i] for g in x)
    counts = [Counter() for _ in m.ORDERS]
    for g, c in train.items():
        for o, order in enumerate(m.ORDERS):
            own = g & ((1 << 8 * (order + 1)) - 1)
            for d in range(9):
                counts[o][d, own >> (8 - d)] += c

    def inputs(g, d, without):
        bit, node, x, seen = (g & 255) >> (7 - d) & 1, (1 << d) | ((g & 255) >> (8 - d)), [], 0
        for o, order in enumerate(m.ORDERS):
            own = g & ((1 << 8 * (order + 1)) - 1)
            same, every = counts[o][d + 1, own >> (7 - d)], counts[o][d, own >> (8 - d)]
            other, same = every - same, max(same - 1, 0) if without else same
            x.append(math.log((same + 0.4) / (other + 0.4)) * (2 * bit - 1))
            seen = same + other
        return np.array([*x, 0.3]), node * m.GATES + (seen > 0) + (seen > 8), node, bit

    squash = lambda v: 1 / (1 + math.exp(-min(max(v, -12), 12)))
    place = lambda v: min(max(int((v + 8) * (m.STEPS / 16)), 0), m.STEPS - 1)
    weights = np.full((256 * m.GATES, len(m.ORDERS) + 1), 0.3)
    order = [g for _, g in sorted((int(text.mix(np.array([g], np.uint64))[0]), g) for g in train)]
    for t_ in range(m.PASSES):
        for a in range(0, len(order), m.TOGETHER):
            for d in range(8):
                step, mass = np.zeros_like(weights), np.zeros(len(weights))
                for g in order[a : a + m.TOGETHER]:
                    x, gate, _, bit = inputs(g, d, True)
                    step[gate] += (bit - squash(weights[gate] @ x)) * train[g] * x
                    mass[gate] += train[g]
                weights += m.RATE / (1 + t_) * step / np.sqrt(mass + 1)[:, None]
    hits = np.zeros((256 * m.STEPS, 2))
    for g, c in train.items():
        for d in range(8):
            x, gate, node, bit = inputs(g, d, True)
            hits[node * m.STEPS + place(weights[gate] @ x), bit] += c
    prior = np.array([squash((k + 0.5) * (16 / m.STEPS) - 8) for k in range(m.STEPS)] * 256)
    refined = (hits[:, 1] + 20 * prior) / (hits.sum(1) + 20)
    logs = {}
    for g in {g for x in grams.values() for g in x}:
        logs[g] = 0.0
        for d in range(8):
            x, gate, node, bit = inputs(g, d, False)
            v = min(max(weights[gate] @ x, -8), 8)
            p = 0.5 * (squash(v) + refined[node * m.STEPS + place(v)])
            logs[g] += math.log10(p if bit else 1 - p)
    return {i: sum(logs[g] for g in x) for i, x in grams.items()}


def test_mixing_score_matches_brute_force_whatever_the_partitions(spark):
    rows = [(i, " ".join(words(12 + i, i % 9)), i % 5 == 1) for i in range(24)] + [(30, None, True), (31, "", False), (32, "é", True)]
    want = brute_mixing({i: (x or "").encode() for i, x, _ in rows}, {i: h for i, _, h in rows})
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = {r.doc_id: r.score for r in context_mixing.mixing_scores(df.repartition(n, "text"), held_out=F.col("held")).collect()}
            assert got.keys() == want.keys()
            assert [got[i] for i in want] == pytest.approx([want[i] for i in want], rel=1e-6, abs=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_mixing_draws_by_full_count():
    keys = np.array([ord("a") | ord("b") << 8, ord("c") | ord("b") << 8], np.uint64)
    n = np.array([64_000_000, 64_000])
    single = np.zeros(1 << 16, np.int64)
    single[keys.astype(int)] = n
    batch = context_mixing.pa.RecordBatch.from_pydict({"vals": [keys.astype("<u8").tobytes()], "counts": [n.astype("<i8").tobytes()]})
    row, = context_mixing._drawn(single, 1e-3, 1, iter([batch]))
    assert np.frombuffer(row["times"][0].as_py(), "<i8").tolist() == pytest.approx([64_000, 64], abs=1)


def test_mixing_streams_learn_all_that_is_drawn_and_grow_with_the_corpus(spark, monkeypatch):
    """Many short streams against the mean of their twins; more text changes the weights' part in a score, the base score aside."""
    m = context_mixing
    monkeypatch.setattr(m, "LEARN", 200)
    rows = [(i, " ".join(words(60, i)), False) for i in range(30)] + [(99, " ".join(words(40, 3)), True)]
    seen = []
    real = m.learned
    monkeypatch.setattr(m, "learned", lambda keys, times, paths: seen.append((keys, times, paths)) or real(keys, times, paths))
    data = np.frombuffer("".join(t for _, t, h in rows if not h).encode(), np.uint8)
    keys, n = m.merged(m.sextuples(data, np.array([0, len(data)])), np.ones(len(data), np.int64))
    single = np.zeros(1 << 16, np.int64)
    pair, c = m.merged(keys & np.uint64(0xFFFF), n)
    single[pair.astype(int)] = c
    batch = m.pa.RecordBatch.from_pydict({"vals": [keys.tobytes()], "counts": [n.tobytes()]})
    found = m.pa.Table.from_batches(list(m._drawn(single, 1.0, 9, iter([batch]))))
    assert sorted(found["stream"].to_pylist()) == list(range(9))
    assert sum(np.frombuffer(x, "<i8").sum() for x in found["times"].to_pylist()) == len(data)  # a share of 1 takes every occurrence
    total = np.zeros(256 * m.GATES * (len(m.ORDERS) + 1) + 1)
    for i in range(9):
        out = m._stream_weights(found.slice(i, 1))
        total += np.frombuffer(out["data"][0].as_py(), "<f8")
    want = sum(real(k, t, p) * t.sum() for k, t, p in seen) / len(data)
    assert np.allclose((total[:-1] / total[-1]).reshape(want.shape), want) and total[-1] == len(data)
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    score = lambda d, s: {r.doc_id: r.score for r in m.mixing_scores(d, held_out=F.col("held"), share=s).collect()}
    few, every = score(df, 0.05), score(df, 1.0)
    assert few[99] != every[99] and abs(few[99] - every[99]) < 0.2 * abs(few[99])
    assert score(df.repartition(5), 1.0)[99] == pytest.approx(every[99], rel=1e-9)


def test_mixing_join_of_rare_sextuples_gives_the_scores_of_the_table(spark, monkeypatch):
    rows = [(i, " ".join(words(60, i)), i % 5 == 0) for i in range(40)] + [(40, None, True), (41, "", False)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, held boolean")
    score = lambda: sorted((r.doc_id, r.score) for r in context_mixing.mixing_scores(df, held_out=F.col("held")).collect())
    table = score()
    monkeypatch.setattr(context_mixing, "GRAM_HEAD", 0)
    joined = score()
    assert [i for i, _ in table] == [i for i, _ in joined] and [x for _, x in table] == pytest.approx([x for _, x in joined], rel=1e-9)
    assert all(x < 0 for i, x in table if i < 40)


LONG = " ".join(words(30_000, 99)) + " SPDX-License-Identifier: MIT"


@pytest.fixture(scope="module")
def odd(spark):
    """A very long text, empty ones, nulls in every column, rows that repeat, columns with clashing names."""
    clash = ["key", "row", "part", "component", "list", "score", "labels", "n_words", "block", "weight", "item_id", "listed", "host", "first", "_source"]
    base = [(1, LONG, "en", "a"), (2, "", "en", "a"), (3, None, "fr", None), (None, "the house and the tree", None, "b"), (4, "the house and the tree", "en", "b"), (4, "the house and the tree", "en", "b"), (5, " \n\t ", None, None), (None, None, None, None)]
    rows = [(*r, *[f"x{i}"] * len(clash)) for i, r in enumerate(base)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in clash)).repartition(3)


def _tied(rows, place):
    """Results of the repeated row are equal."""
    same = [tuple(v for k, v in r.asDict().items() if k not in place) for r in rows if r.doc_id == 4]
    assert len(same) == 2 and same[0] == same[1]


def test_odd_rows_for_each_operator(spark, odd):
    n_long = len(split(LONG))
    r = ngram_jaccard.jaccard_components(odd).collect()
    assert len(r) == 8 and {x.doc_id: x.component_id for x in r if x.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert max(x.n_shingles for x in r) == len(shingle_set(LONG))
    _tied(r, ())
    r = substring.without_repeats(odd, carry=["doc_id"]).select("row.doc_id", "n_words", "n_removed").collect()
    assert len(r) == 8 and max(x.n_words for x in r) == n_long and sum(x.n_removed for x in r) == 0
    _tied(r, ())
    r = context_mixing.mixing_scores(odd).collect()
    assert len(r) == 8 and max(x.n_tokens for x in r) == n_long + 1 and all(x.score <= 0 for x in r) and sum(x.doc_id is None for x in r) == 2
    _tied(r, ())
    r = licenses.license_scan(odd).collect()
    assert len(r) == 8 and [x.labels for x in r if x.doc_id == 1] == ["mit"] and [x.score for x in r if x.doc_id == 3] == [0.0]
    _tied(r, ())
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "host", "first", "listed", "key")
    r = warc_zip.read_packages(warc_zip.write_packages(pages)).collect()
    assert len(r) == 8 and sum(x.record_type == "revisit" for x in r) == 3 and max(x.payload_bytes for x in r) == len(LONG.encode()) and not any(x.error for x in r)
    r = source_mixing.mix_sources(odd).select("row.doc_id", "n_tokens", "weight", "epoch").collect()
    assert len([x for x in r if x.epoch == 0]) == 8 and max(x.n_tokens for x in r) == n_long
    r = language_id.identify(odd, carry=["doc_id", "score"]).select("row.doc_id", "lang_pred", "score").collect()
    assert len(r) == 8 and {x.lang_pred for x in r if x.doc_id in (2, 3, 5)} == {"und"} and {x.lang_pred for x in r if x.doc_id in (1, 4)} == {"en"}
    _tied(r, ())
    r = url_filter.url_verdicts(pages, pages).collect()
    assert len(r) == 8 and {(x.host, x.path, x.rule, x.verdict) for x in r} == {("", "", None, "allow")}
    bench = spark.createDataFrame([(7, "the house and the tree", "c"), (8, " ".join(split(LONG, False)[500:560]), "c"), (None, None, None)], "item_id long, text string, doc_id string")
    r = decontaminate.leaks(odd, bench).collect()
    assert sorted((x.doc_id or 0, x.item_id) for x in r) == [(0, 7), (1, 8), (4, 7), (4, 7)]


def test_pipeline_of_nothing_and_of_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    keep = ["doc_id", "text", "lang", "source", "weight", "key", "row"]
    for name, df in (("none", odd.limit(0)), ("odd", odd)):
        df.select(*keep).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(7, "nothing of the kind is here at all today")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    out = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()}
    assert out == {1, 4}


def test_rows_of_one_id_keep_their_other_texts_in_the_pipeline(spark):
    import corpus_pipeline

    a, b = " ".join(words(40, 80)), " ".join(words(40, 81))
    df = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (1, a, "x"), (2, a + " z", "y")], "doc_id long, text string, lang string")
    got = corpus_pipeline.one_of_each_group(spark, df, "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(1, a), (1, b)]) and got.columns == df.columns


def test_temperature_stays_within_its_bounds():
    """On separable data the likelihood grows without end: the temperature stops within its bounds."""
    s = np.array([[5.0, 0.0], [0.0, 5.0]] * 20)
    assert math.exp(-3) <= language_id.temperature(s, np.array([0, 1] * 20)) < 1
    assert language_id.temperature(s, np.array([1, 0] * 20)) == pytest.approx(math.exp(3), rel=1e-3)


def test_language_id_predicts_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs, carry=["doc_id", "lang"]).where(F.expr("crc32(cast(row.doc_id as string)) % 5 = 0") & F.col("row.lang").isNotNull())
    n, right = found.agg(F.count("*"), F.avg((F.col("lang_pred") == F.col("row.lang")).cast("double"))).first()
    assert n > 100 and right >= 0.97


def test_mixing_learns_from_every_training_byte_whatever_the_partitions(spark, monkeypatch):
    """Past one stream, too: visits keep all occurrences, none weighs more than 1, and by default nothing is drawn."""
    m = context_mixing
    monkeypatch.setattr(m, "LEARN", 500)
    monkeypatch.setattr(m, "_drawn_weights", lambda *a: pytest.fail("weights come from a draw"))
    keys, n = np.arange(300, dtype=np.uint64) << np.uint64(8), np.r_[np.ones(280, np.int64), np.full(20, 900)]
    total, streams = np.zeros(300), list(m._visits(keys, n))
    for at, _, weight in streams:
        assert weight.max() <= 1
        total += np.bincount(at, weight, minlength=300)
    assert len(streams) > 1 or sum(len(x) for x, *_ in streams) <= 750
    assert total * n.sum() / 300 == pytest.approx(n)
    data = np.frombuffer(" ".join(words(2000, 1)).encode(), np.uint8)
    every, count = m.merged(m.sextuples(data, np.array([0, len(data)])), np.ones(len(data), np.int64))
    single = np.zeros(1 << 16, np.int64)
    np.add.at(single, (every & np.uint64(0xFFFF)).astype(int), count)
    batch = m.pa.RecordBatch.from_pydict({"vals": [every.tobytes()], "counts": [count.tobytes()]})
    out, = m._part_weights(single, np.full((256 * m.GATES, len(m.ORDERS) + 1), 0.3), iter([batch]))
    assert np.frombuffer(out["data"][0].as_py(), "<f8").reshape(256 * m.GATES, -1)[:, -1].sum() == pytest.approx(8 * len(data))
    rows = [(i, " ".join(words(60, i)), False) for i in range(30)] + [(99, " ".join(words(40, 3)), True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got.append([x for _, x in sorted((r.doc_id, r.score) for r in m.mixing_scores(df.repartition(parts), held_out=F.col("held")).collect())])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == pytest.approx(got[1], rel=1e-9)
