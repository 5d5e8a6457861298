"""Queries that SQL can't express against numpy on the whole table, each by another road than the query's."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from panelforge.catalog.fixtures import FRAMES
from panelforge.catalog.linear import _FOLD
from panelforge.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames():
    """Columns of the frames table, with folds, as numpy arrays."""
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    x = con.sql(f"WITH {FRAMES}, {_FOLD} SELECT * FROM fr ORDER BY frame").fetchnumpy()
    return {k: np.stack(v).astype(float) if k == "emb" else np.asarray(v) for k, v in x.items()}


def rows_of(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, DATA).collect()]


def axes_of(x, k):
    """Variances and axes by the rows' singular values; the largest loading of each axis is positive."""
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = vt[:k].T
    return s**2 / (len(x) - 1), axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])


def pair_auc(label, score):
    one, zero = score[label == 1], score[label == 0]
    return float(((one[:, None] > zero[None, :]) + 0.5 * (one[:, None] == zero[None, :])).mean())


def test_greedy_decorrelation(spark, frames):
    x = frames["emb"]
    z = (x - x.mean(0)) / x.std(0)
    kept = []
    for c in range(x.shape[1]):
        s = np.linalg.svd(z[:, [*kept, c]], compute_uv=False)
        if s[-1] ** 2 / len(x) > 0.2:
            kept.append(c)
    assert [r["dim"] for r in sorted(rows_of(spark, "g13_greedy_decorrelation"), key=lambda r: r["position"])] == kept


def test_principal_components_and_scores(spark, frames):
    x = frames["emb"]
    for r in rows_of(spark, "i13_pca"):
        variance = axes_of(x, 10)[0]
        assert r["variance"] == pytest.approx(variance[r["axis"]], rel=1e-5, abs=1e-6)
        assert r["retained"] == pytest.approx(variance[: r["axis"] + 1].sum() / variance.sum(), abs=2e-6)
    got = rows_of(spark, "i13_pca_by_stratum")
    assert {r["stratum"] for r in got} == set(frames["stratum"].tolist())
    for r in got:
        variance = axes_of(x[frames["stratum"] == r["stratum"]], 5)[0]
        assert r["retained"] == pytest.approx(variance[: r["axis"] + 1].sum() / variance.sum(), abs=2e-6)
    pool = {e: x[frames["entity"] == e].mean(0) for e in set(frames["entity"].tolist())}
    both = np.hstack([x, np.stack([pool[e] for e in frames["entity"].tolist()])])
    want = (both - both.mean(0)) @ axes_of(both, 2)[1]
    got = {r["frame"]: (r["s0"], r["s1"]) for r in rows_of(spark, "i13_scores")}
    assert len(got) == len(x)
    assert np.allclose([got[f] for f in frames["frame"].tolist()], want, atol=1e-5)


def test_spectrum_and_information(spark, frames):
    variance = axes_of(frames["emb"], 1)[0]
    share = variance.cumsum() / variance.sum()
    got = {r["metric"]: r["value"] for r in rows_of(spark, "i21_stability")}
    assert got["participation"] == pytest.approx(variance.sum() ** 2 / (variance**2).sum(), abs=1e-4)
    assert (got["axes_90"], got["axes_95"]) == (np.searchsorted(share, 0.9) + 1, np.searchsorted(share, 0.95) + 1)
    assert 0 <= got["angle"] <= got["largest_angle"] <= 90
    z = np.stack([frames[c] for c in ("x1", "x2", "x3", "y")], axis=1)
    z = (z - z.mean(0)) / z.std(0)
    left = [1 - np.linalg.lstsq(np.delete(z, i, 1), z[:, i], rcond=None)[0] @ np.delete(z, i, 1).T @ z[:, i] / len(z) for i in range(4)]
    whole = np.log(np.linalg.svd(z, compute_uv=False) ** 2 / len(z)).sum()  # joint entropy, doubled, but for constants
    total, dual = -0.5 * whole, 0.5 * (whole - np.log(left).sum())
    got = next(r for r in rows_of(spark, "i19_o_information") if r["stratum"] == "all")
    assert (got["total"], got["dual"], got["omega"]) == pytest.approx((total, dual, total - dual), abs=1e-5)


def logistic(x, y, w, penalty):
    """Weighted logistic regression by Newton's method; the penalty is on standardised weights."""
    mean, sd = np.average(x, axis=0, weights=w), np.sqrt(np.cov(x.T, aweights=w)).reshape(x.shape[1], -1)
    sd = sd.diagonal() if x.shape[1] > 1 else sd[:, 0]
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    ridge = penalty * np.diag([0.0] + [1.0] * x.shape[1])
    b = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + ridge, z.T @ (w * (p - y)) / w.sum() + ridge @ b)
    return lambda new: 1 / (1 + np.exp(-np.column_stack([np.ones(len(new)), (new - mean) / sd]) @ b))


def test_logistic_folds_and_fusion(spark, frames):
    label = (frames["y"] > 22.5).astype(int)
    share = label.mean()
    w = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))

    def held_out(*columns):
        x = np.stack([frames[c] for c in columns], axis=1)
        p = np.zeros(len(x))
        for k in range(3):
            own = frames["fold"] % 3 == k
            p[own] = logistic(x[~own], label[~own], w[~own], 0.01)(x[own])
        return p

    got = rows_of(spark, "i11_logistic_folds")[0]
    assert (got["n1"], got["n0"]) == (label.sum(), (1 - label).sum())
    assert got["auc"] == pytest.approx(pair_auc(label, held_out("x1", "x2", "x3")), abs=2e-3)
    a, b = held_out("x1"), held_out("x2")
    want = {"a": a, "b": b, "fused": np.log(a / (1 - a)) + np.log(b / (1 - b)), "joint": held_out("x1", "x2")}
    want = {k: pair_auc(label, v) for k, v in want.items()}
    got = {r["metric"]: r["value"] for r in rows_of(spark, "i12_decision_fusion")}
    assert got == pytest.approx(want | {"best_single": max(want["a"], want["b"])}, abs=2e-3)


def test_axis_labels_after_rotation(spark, frames):
    """Varimax by rotating two axes at a time (Kaiser's angle) until none moves; axes may change places."""
    load = axes_of(frames["emb"], 3)[1].copy()
    for _ in range(500):
        turned = 0.0
        for i, j in ((0, 1), (0, 2), (1, 2)):
            u, v = load[:, i] ** 2 - load[:, j] ** 2, 2 * load[:, i] * load[:, j]
            angle = np.arctan2(2 * (u @ v - u.sum() * v.sum() / len(u)), (u @ u - v @ v) - (u.sum() ** 2 - v.sum() ** 2) / len(u)) / 4
            c, s = np.cos(angle), np.sin(angle)
            load[:, [i, j]] = load[:, [i, j]] @ np.array([[c, -s], [s, c]])
            turned = max(turned, abs(angle))
        if turned < 1e-12:
            break
    want = [np.abs(load[:, k]).reshape(4, 16).mean(1) for k in range(3)]
    got = np.zeros((3, 4))
    for r in rows_of(spark, "i22_axis_labels"):
        got[r["axis"], r["block"]] = r["loading"]
    for own in got:
        assert min(np.abs(own - w).max() for w in want) < 1e-3
