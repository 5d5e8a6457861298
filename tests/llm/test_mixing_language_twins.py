"""Source mixing and language ID against plain loops over rows, characters and coordinates."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.llm import language_id, source_mixing, text


def exponent(tokens, repeats, entropy):
    """The smallest exponent that keeps both limits, by plain bisection."""
    total = sum(tokens.values())

    def state(x):
        w = {s: (n / total) ** x for s, n in tokens.items()}
        z = sum(w.values())
        per = [w[s] / tokens[s] for s in tokens]
        return max(per) / min(per), -sum(v / z * math.log(v / z) for v in w.values()) / math.log(len(w))

    found = 0.0
    for place, limit in ((0, repeats), (1, entropy)):
        if limit is None or state(found)[place] <= limit:
            continue
        low, high = found, 1.0
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (low, middle) if state(middle)[place] <= limit else (middle, high)
        found = high
    return found


@pytest.mark.parametrize("repeats, entropy", [(3.0, None), (None, 0.9), (4.0, 0.95)])
def test_the_blocks_that_are_taken(spark, repeats, entropy):
    r = random.Random(9)
    rows = [(i, " ".join("w" * r.randint(1, 9) for _ in range(r.choice([0, 3, 40, 200]))), r.choice(["big"] * 12 + ["mid"] * 3 + ["small", None])) for i in range(900)]
    rows += [(i, None, "empty") for i in range(900, 905)] + rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), "null" if s is None else "=" + s) for i, t, s in rows]
    tokens = defaultdict(int)
    for _, n, s in size:
        tokens[s] += n
    real = {s: n for s, n in tokens.items() if n}
    x = exponent(real, repeats, entropy)
    weight = {s: (n / sum(real.values())) ** x for s, n in real.items()}
    least = min(weight[s] / real[s] for s in real)
    block = {h.doc_id: h.h % 64 for h in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).distinct().collect()}
    grid = [(s, b, e) for s in tokens for b in range(64) for e in range(8)]
    grid = spark.createDataFrame(grid, "s string, b int, e int").select("*", F.xxhash64("s", "b", "e", F.lit(17)).alias("h")).collect()
    turn = {(g.s, g.b, g.e): g.h for g in grid}
    want = Counter()
    for s in tokens:
        own = defaultdict(list)
        for i, n, of in size:
            if of == s:
                own[block[i]].append((i, n))
        passes = weight[s] / real[s] / least if s in real else 1.0
        passes = round(passes, 4) if abs(passes - round(passes)) < 1e-4 else passes  # a whole pass, but for rounding
        for e in range(math.ceil(passes)):
            before = 0
            for place, b in enumerate(sorted(own, key=lambda b: (turn[s, b, e], b)), 1):
                if passes - e >= 1 or before < (passes - e) * tokens[s]:
                    want.update((i, e, place) for i, _ in own[b])
                before += sum(n for _, n in own[b])
    taken = source_mixing.mix_sources(docs, repeats=repeats, entropy=entropy).select("row.doc_id", "epoch", "block", "row.source", "weight").collect()
    assert Counter((t.doc_id, t.epoch, t.block) for t in taken) == want
    z = sum(weight.values())
    for t in taken:
        assert t.weight == pytest.approx(weight.get("null" if t.source is None else "=" + t.source, 0.0) / z, abs=1e-6)


def hashed(gram):
    code = 0
    for c in gram:
        code = (code * (0x110000 + 7) + ord(c)) % (1 << 64)
    return int(text.mix(np.array([(code + (len(gram) << 56)) % (1 << 64)], np.uint64))[0] >> np.uint64(64 - language_id.BITS))


def test_grams_match_a_loop_over_characters():
    docs = ["", "a", "42", "The  cat, sat.", "Été où — ça", "x1y 2z", "ÀB\nc" * 5, "日本 語", " lead", "trail "]
    data = np.frombuffer("".join(docs).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(d.encode()) for d in docs])])
    values, owner, has = language_id.grams(data, offsets)
    for i, d in enumerate(docs):
        line = "".join((c.lower() if "A" <= c <= "Z" else c) if c.isalpha() else " " for c in d)
        want = Counter(hashed(line[j : j + n]) for n in (1, 2, 3) for j in range(len(line) - n + 1) if "  " not in line[j : j + n] and line[j : j + n] != " ")
        assert Counter(values[owner == i].tolist()) == want
        assert bool(has[i]) == any(c.isalpha() for c in d)


def test_ftrl_matches_a_loop_over_coordinates():
    r = np.random.default_rng(4)
    rows = []
    for i in range(40):
        at = np.sort(r.choice(30, r.integers(1, 6), replace=False))
        rows.append((at, r.random(len(at)) * 3, int(i % 3)))
    w, bias = language_id.ftrl(rows, 3)
    bias_at = 1 << language_id.BITS
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        l1 = 0.0 if i == bias_at else language_id.L1
        if abs(z[i, c]) <= l1:
            return 0.0
        return -(z[i, c] - math.copysign(l1, z[i, c])) / ((language_id.BETA + math.sqrt(n[i, c])) / language_id.ALPHA + language_id.L2)

    for epoch in range(language_id.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            at, x, label = rows[k]
            features = [*zip(at.tolist(), x.tolist()), (bias_at, 1.0)]
            scores = [sum(v * weight(i, c) for i, v in features) for c in range(3)]
            e = [math.exp(s - max(scores)) for s in scores]
            now = {(i, c): weight(i, c) for i, _ in features for c in range(3)}
            for i, v in features:
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == label))
                    sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / language_id.ALPHA
                    z[i, c] += g - sigma * now[i, c]
                    n[i, c] += g * g
    for i in range(30):
        assert w[i].tolist() == pytest.approx([weight(i, c) for c in range(3)], abs=1e-9)
    assert bias.tolist() == pytest.approx([weight(bias_at, c) for c in range(3)], abs=1e-9)
    assert not w[30:].any()  # features that never occurred have no weight


def test_equal_scores_go_to_the_first_label():
    model = SimpleNamespace(value=(["a", "b", "c"], np.zeros((3, 1 << language_id.BITS), np.float32), np.array([0.0, 1.0, 1.0]), 1.0))
    batch = pa.RecordBatch.from_pydict({"row": [1, 2, 3, 4], "text": ["some words", "some words", "42", None]})
    found = next(language_id._predicted(model, iter([batch]))).to_pylist()
    assert [r["lang_pred"] for r in found] == ["b", "b", "und", "und"]
    assert [r["score"] for r in found] == pytest.approx([math.e / (1 + 2 * math.e)] * 2 + [0.0] * 2)
