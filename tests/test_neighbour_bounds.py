"""Exact neighbours where products of single precision don't tell rows apart, over several batches and groups."""

from __future__ import annotations

import numpy as np
import pytest

from panelforge.operators import geometry, neighbours


def frame(spark, v):
    return spark.createDataFrame([(i, [None if np.isnan(c) else float(c) for c in row]) for i, row in enumerate(v)], "id long, v array<double>").repartition(3)


def brute(v, k, least=None):
    out = set()
    for i, a in enumerate(v):
        gap = v - a
        common = (~np.isnan(gap)).sum(1)
        d = np.sqrt(np.nansum(gap * gap, axis=1) * (v.shape[1] / np.maximum(common, 1) if least else 1))
        d[(common < (least or v.shape[1])) | (np.arange(len(v)) == i)] = np.inf
        for rank, j in enumerate(np.lexsort((np.arange(len(v)), np.round(d, 9)))[:k], 1):
            if np.isfinite(d[j]):
                out.add((i, int(j), rank, round(float(d[j]), 7)))
    return out


@pytest.mark.parametrize("scale, shift", [(1, 0), (1, 3e4), (1e-3, 0), (1e12, 0)])
def test_copies_and_offsets(spark, scale, shift):
    r = np.random.default_rng(4)
    v = r.standard_normal((900, 6)) + shift
    v[300:330] = v[0]  # a group of copies: distance exactly zero, by id
    v[400:500] += 1e3  # norms that differ
    v *= scale
    digits = 7 if scale < 10 else -6
    got = {(x.src, x.dst, x["rank"], round(x.dist, digits)) for x in geometry.nearest(frame(spark, v), "id", "v", 5, blocks=7).collect()}
    assert got == {(a, b, c, round(d, digits)) for a, b, c, d in brute(v, 5)}
    assert {d for a, _, _, d in got if 300 <= a < 330} == {0.0}


def test_masked_against_all_pairs(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal((500, 8))
    v[r.random(v.shape) < 0.5] = np.nan
    v[7] = np.nan
    got = {(x.src, x.dst, x["rank"], round(x.dist, 7)) for x in geometry.nearest(frame(spark, v), "id", "v", 4, geometry.masked(3), blocks=5).collect()}
    assert got == brute(v, 4, 3)


def test_only_pairs_that_may_enter_a_list_go_on():
    r = np.random.default_rng(6)
    ids, v = r.permutation(60), r.standard_normal((60, 4))
    every = geometry.euclidean(v, v)
    limit, fresh = np.full(60, 1.2), r.random(60) < 0.3
    src, dst, d = neighbours._met(ids, v, 5, geometry.euclidean, limit, fresh)
    at = {int(i): n for n, i in enumerate(ids)}
    want = set()
    for i in range(60):
        ok = [j for j in range(60) if j != i and every[i, j] <= 1.2 and (fresh[i] or fresh[j])]
        want |= {(int(ids[i]), int(ids[j])) for j in sorted(ok, key=lambda j: (round(every[i, j], 9), ids[j]))[:5]}
    assert {(int(a), int(b)) for a, b in zip(src, dst)} == want
    assert all(abs(x - every[at[int(a)], at[int(b)]]) < 1e-8 for a, b, x in zip(src, dst, d))
