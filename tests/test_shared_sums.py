"""Screens on shared sums, bounded Gram sums, approximate neighbours, and empty tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import geometry, inference, linear, neighbours, screens, vectors


def ridge_r2(x, y, fold, alpha):
    """Out-of-fold R2 of a ridge on features standardised on the training rows."""
    rss = 0.0
    for f in np.unique(fold):
        a, b = x[fold != f], y[fold != f]
        m, s = a.mean(0), a.std(0)
        z = (a - m) / s
        w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (b - b.mean()))
        rss += ((y[fold == f] - b.mean() - (x[fold == f] - m) / s @ w) ** 2).sum()
    return 1 - rss / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("held, part", [(screens.HELD, screens.PART), (2000, 40)])
def test_screen_equals_a_ridge_of_each_variable(spark, monkeypatch, held, part):
    """Variables that most rows have, few rows have, some have twice; small limits flush and split."""
    monkeypatch.setattr(screens, "HELD", held)
    monkeypatch.setattr(screens, "PART", part)
    r = np.random.default_rng(5)
    x = r.standard_normal((300, 6))
    fold = np.arange(300) % 4
    long, want = [], {}
    for name, share in (("most", 0.95), ("half", 0.5), ("few", 0.2), ("all", 1.0), ("rare", 0.02), ("twice", 0.9)):
        y = x @ r.standard_normal(6) + r.standard_normal(300)
        at = np.flatnonzero(r.random(300) < share)
        if name == "twice":
            at = np.concatenate([at, at[:30]])
        long += [(int(i), name, float(y[i])) for i in at]
        if len(at) >= 40:
            want[name] = len(at), ridge_r2(x[at], y[at], fold[at], 3.0)
    long += [(1, "most", None), (2, "few", float("nan")), (999, "most", 1.0), (5, "constant", 2.0)] + [(i, "constant", 2.0) for i in range(6, 60)]
    vectors_ = [(i, int(fold[i]), [float(v) for v in x[i]]) for i in range(300)] + [(500, 1, None), (501, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    a = spark.createDataFrame(long, "row long, name string, value double").repartition(3)
    b = spark.createDataFrame(vectors_, "row long, fold int, x array<double>").repartition(3)
    got = {v["name"]: (v.n, v.r2) for v in screens.screen(a, b, "name", "row", "value", "x", "fold", 3.0, 40).collect()}
    assert got.pop("constant") == (55, None)
    assert set(got) == set(want)
    for name, (n, r2) in want.items():
        assert got[name][0] == n and got[name][1] == pytest.approx(r2, abs=1e-9)
    assert screens.screen(a.limit(0), b, "name", "row", "value", "x", "fold").count() == 0
    assert screens.screen(a, b.limit(0), "name", "row", "value", "x", "fold").count() == 0


def test_gram_sums_are_sent_on_within_a_batch(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.standard_normal((500, 4))
    key = r.integers(0, 60, 500)
    df = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in zip(key, x)], "k long, x array<double>").coalesce(1)
    monkeypatch.setattr(linear, "HELD", 5 * 8 * 25)
    got = {v.k: linear._square(v.gram) for v in linear.gram_table(linear.design(df, "x", keep=["k"]), ["k"]).collect()}
    for k in set(key.tolist()):
        a = np.column_stack([np.ones((key == k).sum()), x[key == k]])
        assert np.allclose(got[k], a.T @ a)


def test_sums_by_key_are_sent_on_within_a_task(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.standard_normal((900, 5))
    key = r.integers(0, 70, 900)
    df = spark.createDataFrame([(int(k) if k else None, None if i % 50 == 0 else [float(v) for v in row], float(i % 3)) for i, (k, row) in enumerate(zip(key, x))], "k long, x array<double>, w double").repartition(3)
    for held in (vectors.HELD, 700):
        monkeypatch.setattr(vectors, "HELD", held)
        got = {v.k: (v.n, v["mean"]) for v in vectors.mean_by(df, ["k"], "x", "w").collect()}
        for k in set(key.tolist()):
            at = np.array([i for i in np.flatnonzero(key == k) if i % 50])
            w = np.array([i % 3 for i in at])
            want = (x[at] * w[:, None]).sum(0) / w.sum() if w.sum() else x[at].mean(0)
            assert got[k or None][0] == len(at) and np.allclose(got[k or None][1], want)


@pytest.mark.parametrize("group", [vectors.GROUP, 25])
def test_medians_of_small_and_large_groups(spark, monkeypatch, group):
    monkeypatch.setattr(vectors, "GROUP", group)
    r = np.random.default_rng(9)
    x = np.round(r.standard_normal((200, 4)), 1)
    x[r.random(x.shape) < 0.2] = np.nan
    key = np.minimum(r.integers(0, 9, 200), 4)
    x[key == 2, 1] = np.nan
    rows = [(int(k) if k else None, None if i % 40 == 0 else [None if np.isnan(v) else float(v) for v in row]) for i, (k, row) in enumerate(zip(key, x))]
    df = spark.createDataFrame([*rows, (77, None)], "k long, x array<double>").repartition(3)
    got = {v.k: v["median"] for v in vectors.median_by(df, ["k"], "x").collect()}
    assert got.pop(77) is None and len(got) == 5
    for k in range(5):
        own = x[[i for i in range(200) if key[i] == k and i % 40]]
        want = [None if np.isnan(c).all() else float(np.nanmedian(c)) for c in own.T]
        assert got[k or None] == [None if v is None else pytest.approx(v) for v in want]
    assert vectors.median_by(df.limit(0), ["k"], "x").count() == 0


@pytest.fixture(scope="module")
def clusters(spark):
    r = np.random.default_rng(11)
    centre = r.standard_normal((40, 16)) * 2
    rows = [(i, [float(v) for v in centre[i % 40] + r.standard_normal(16) * (0.2 + i % 5)]) for i in range(1500)]
    rows += [(5000 + i, rows[7][1]) for i in range(20)] + [(6000, None)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(4).cache()


def test_approximate_neighbours_recall(clusters):
    exact, found = geometry.nearest(clusters, "id", "v", 10), neighbours.approximate_nearest(clusters, "id", "v", 10)
    got = neighbours.recall(exact, found).first()
    assert got.recall >= 0.95 and got.entries == 1520 * 10
    rows = {(r.src, r.dst): (r["rank"], round(r.dist, 9)) for r in found.collect()}
    assert {k[0] for k in rows} == set(range(1500)) | set(range(5000, 5020)) and all(a != b for a, b in rows)
    distances = {(r.src, r.dst): round(r.dist, 9) for r in exact.collect()}
    assert all(rows[k][1] == d for k, d in distances.items() if k in rows)


def test_few_rows_have_exact_neighbours(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(v) for v in r.standard_normal(3)]) for i in range(60)], "id long, v array<float>")
    a, b = ({(r.src, r.dst, r["rank"]) for r in f(df, "id", "v", 4).collect()} for f in (geometry.nearest, neighbours.approximate_nearest))
    assert a == b
    for n in (0, 1):
        assert neighbours.approximate_nearest(df.limit(n), "id", "v", 4).count() == 0


def test_trust_and_continuity(spark):
    """Against their definition, on whole rankings."""
    r = np.random.default_rng(4)
    x, low = r.standard_normal((40, 5)), None
    low = x[:, :2]
    n, k = 40, 5

    def ranks(v):
        d = ((v[:, None] - v[None]) ** 2).sum(2)
        np.fill_diagonal(d, -1)
        return np.argsort(np.argsort(d, axis=1), axis=1)

    a, b = ranks(x), ranks(low)
    scale = 2 / (n * k * (2 * n - 3 * k - 1))
    trust = 1 - scale * sum(a[i, j] - k for i in range(n) for j in range(n) if 0 < b[i, j] <= k and a[i, j] > k)
    cont = 1 - scale * sum(b[i, j] - k for i in range(n) for j in range(n) if 0 < a[i, j] <= k and b[i, j] > k)
    near = lambda v: geometry.nearest(spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(v)], "id long, v array<double>"), "id", "v", n - 1)
    got = neighbours.trustworthiness(near(x), near(low), k, n).first()
    assert (got.trustworthiness, got.continuity) == (pytest.approx(trust), pytest.approx(cont))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "fold int, x array<double>, y double, row long")
    assert linear.cross_validated(df, "x", "y").weights == {} and math.isnan(linear.held_out_r2(df, "x", "y"))
    one = spark.createDataFrame([(1, [1.0], 2.0, 3)], df.schema)
    assert [r.pred for r in linear.cross_validated(df, "x", "y").predict(one).collect()] == [None]
    assert inference.nested_selection(df, "x", "y", "row")[0] == [] and inference.calibrated(df, "x", "y", 0, 1, 4).weights == {}
    assert vectors.moments(df, "x")[0] == 0
    centres, _, _ = geometry.codebook(df, "x", 3)
    assert centres.shape == (0, 0)
    assert vectors.mean_by(df, ["fold"], "x").count() == 0
    assert vectors.fused(df.withColumn("z", F.col("x")), ["x", "z"]).count() == 0
