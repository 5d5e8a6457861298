"""Axes against anchors: numpy twins, planted signals, nulls, ties, constants and empty tables."""

from __future__ import annotations

import numpy as np
import pytest

from panelforge.operators import resample
from panelforge.operators.bijection import partners


def rank(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def measure(kind, z, y):
    if z.min() == z.max() or y.min() == y.max():
        return None
    if kind == "r":
        return float(np.corrcoef(z, y)[0, 1])
    one, zero = y.sum(), (1 - y).sum()
    return float(((rank(z) * y).sum() - one * (one + 1) / 2) / (one * zero))


def test_anchored_matches_loops(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(150):
        a, b = round(float(r.standard_normal()), 1), float(r.standard_normal())
        size = a + 0.3 * float(r.standard_normal()) if i % 4 else None
        late = int(b + float(r.standard_normal()) > 0) if i % 3 else None
        noise = float("nan") if i % 10 == 0 else float(r.standard_normal())
        rows.append((i, None if i == 7 else a, float("nan") if i == 8 else b, 2.5, size, late, noise, 1, None))
    df = spark.createDataFrame(rows, "id long, a double, b double, flat double, size double, late int, noise double, same int, nothing double")
    kinds = {"size": "r", "late": "auc", "noise": "r", "same": "auc", "nothing": "r"}
    got = {(x.axis, x.anchor): (x.metric, x.value, x.p, x.n) for x in resample.anchored(df, "id", ["a", "b", "flat"], kinds, 60).collect()}
    at = dict(zip(("a", "b", "flat", "size", "late", "noise", "same"), range(1, 8)))
    assert {k[1] for k in got} == {"size", "late", "noise", "same"}  # an anchor without rows gives none
    for (axis, anchor), (metric, value, p, n) in got.items():
        own = [x for x in rows if x[0] not in (7, 8) and x[at[anchor]] is not None and x[at[anchor]] == x[at[anchor]]]
        z, y = (np.array([x[at[c]] for x in own], float) for c in (axis, anchor))
        want = measure(kinds[anchor], z, y)
        assert (metric, n) == (kinds[anchor], len(own))
        if want is None:
            assert value is None and p is None
            continue
        assert value == pytest.approx(want, abs=1e-9)
        middle, size = 0.5 * (metric == "auc"), np.full(len(own), len(own))
        null = [measure(metric, z, y[partners(np.arange(1, len(own) + 1), size, np.full(len(own), k)) - 1]) for k in range(1, 61)]
        assert p == pytest.approx((1 + sum(abs(v - middle) >= abs(want - middle) - 1e-9 for v in null)) / 61)
    assert got["a", "size"][2] == got["b", "late"][2] == pytest.approx(1 / 61)  # planted
    assert got["b", "size"][2] > 1 / 61 or got["a", "late"][2] > 1 / 61


def test_anchored_of_nothing_and_of_unknown_kinds(spark):
    df = spark.createDataFrame([], "id long, a double, y double")
    assert resample.anchored(df, "id", ["a"], {"y": "r"}, 5).count() == 0
    with pytest.raises(ValueError):
        resample.anchored(df, "id", ["a"], {"y": "rho"}, 5)
