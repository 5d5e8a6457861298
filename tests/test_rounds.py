"""Iterative models against numpy twins, exact bootstraps, tails, information sums, and stream state that doesn't grow."""

from __future__ import annotations

import math
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import aggregate, factors, geometry, resample, windows
from panelforge.sources import tables
from panelforge.streaming import incremental


@pytest.fixture(scope="module")
def holes():
    r = np.random.default_rng(3)
    x = r.standard_normal((160, 2)) @ r.standard_normal((2, 6)) + 0.4 * r.standard_normal((160, 6)) + 3
    x[r.random(x.shape) < 0.3] = np.nan
    x[5] = np.nan
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "i long, v array<double>").repartition(3)


@pytest.mark.parametrize("ard", [False, True])
def test_rows_and_patterns_give_one_model(spark, holes, ard):
    """The same model with as many patterns as allowed and with none allowed."""
    df = frame(spark, holes)
    a = factors.factor_analysis(df, "v", 2, 6, 0, ard)
    b = factors.factor_analysis(df, "v", 2, 6, 0, ard, most_patterns=0)
    assert len({tuple(np.isnan(r)) for r in holes}) > 40
    for u, v in zip(a, b):
        assert np.abs(u - v).max() < 1e-8


def test_rows_follow_the_definition(holes):
    """Sums and likelihood of rows against one row at a time, with the whole covariance."""
    r = np.random.default_rng(0)
    mean, load, psi = r.standard_normal(6), r.standard_normal((6, 2)), r.random(6) + 0.5
    x = holes[~np.isnan(holes).all(1)]
    top, low, like = np.zeros((6, 2)), np.zeros((6, 2, 2)), 0.0
    for row in x:
        o = np.isfinite(row)
        w, c = load[o], row[o] - mean[o]
        sigma = w @ w.T + np.diag(psi[o])
        cov = np.linalg.inv(np.eye(2) + w.T @ (w / psi[o][:, None]))
        z = cov @ w.T @ (c / psi[o])
        top[o] += np.outer(c, z)
        low[o] += cov + np.outer(z, z)
        like -= 0.5 * (np.linalg.slogdet(sigma)[1] + c @ np.linalg.solve(sigma, c))
    got = factors.row_sums(x, mean, load, psi)
    assert np.allclose(got, np.concatenate([top.ravel(), low.ravel(), [like]]))


def test_no_rows_no_model(spark):
    df = spark.createDataFrame([], "i long, v array<double>")
    for most in (0, 10):
        assert [len(v) for v in factors.factor_analysis(df, "v", 2, most_patterns=most)] == [0, 0, 0]
    assert factors.topics(df, "v", 2)[0].shape == (0, 0)


def test_topics_equal_their_twin_and_find_what_was_planted(spark):
    r = np.random.default_rng(8)
    planted = np.array([[5, 3, 0, 0, 0, 0, 1, 0], [0, 0, 4, 4, 0, 0, 0, 1], [0, 0, 0, 0, 6, 2, 0, 0]], float)
    x = np.maximum(r.gamma(0.6, 1, (150, 3)), 0) @ planted
    df = frame(spark, x)
    h, explained = factors.topics(df, "v", 3)
    # the twin: the same alternation on the whole matrix
    t, last = factors.first_topics(x.T @ x, 3), np.inf
    for _ in range(200):
        w = factors.nonnegative(t @ t.T, x @ t.T)
        t = factors.nonnegative(w.T @ w, (w.T @ x).T, t.T).T
        rest = ((x - w @ t) ** 2).sum()
        if last - rest < 1e-7 * (x**2).sum():
            break
        last = rest
    assert np.abs(h - t / t.sum(1, keepdims=True)).max() < 1e-6 and explained == pytest.approx(1 - rest / (x**2).sum(), abs=1e-7)
    assert explained > 0.99
    best = [max(float(np.corrcoef(p, q)[0, 1]) for q in h) for p in planted]
    assert min(best) > 0.95
    w = {v.i: v.topics for v in factors.with_topics(df, "v", h).collect()}
    assert min(min(v) for v in w.values()) >= 0 and np.allclose(np.array([w[i] for i in range(150)]) @ h, x, atol=0.6 * x.max())
    ranks = factors.rank_sweep(df, "i", "v", (1, 3))
    assert ranks[0][1] < ranks[1][1] and ranks[1][1] > ranks[1][2] + 0.05


def test_nonnegative_least_squares_meet_their_conditions():
    r = np.random.default_rng(2)
    h, x = r.random((4, 9)), r.standard_normal((30, 9))
    w = factors.nonnegative(h @ h.T, x @ h.T)
    slope = w @ (h @ h.T) - x @ h.T
    assert (w >= 0).all() and (slope > -1e-6).all() and np.abs(slope * w).max() < 1e-6


def test_shuffled_columns_keep_each_column(spark):
    r = np.random.default_rng(2)
    x = r.random((40, 3))
    got = np.array([v.v for v in factors.shuffled_columns(frame(spark, x), "i", "v").collect()])
    assert all(np.allclose(np.sort(got[:, j]), np.sort(x[:, j])) for j in range(3)) and len({tuple(v) for v in got.tolist()} & {tuple(v) for v in x.tolist()}) < 10


def test_multinomial_weights(spark, monkeypatch):
    """Sums are exact, moments are the multinomial's, and partitions don't matter."""
    monkeypatch.setattr(resample, "LEAF", 8)
    df = spark.createDataFrame([(i, f"x{i}") for i in range(50)], "k long, name string")
    got = [{(r.replicate, r.k): r.weight for r in resample.multinomial_weights(df.repartition(p), "k", 600).collect()} for p in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 50 * 600
    w = np.array([[got[0][r, k] for k in range(50)] for r in range(1, 601)])
    assert (w.sum(1) == 50).all()
    assert abs(w.var(0).mean() - 50 * (1 / 50) * (49 / 50)) < 0.04
    cov = np.cov(w.T)
    assert abs(cov[np.triu_indices(50, 1)].mean() + 50 / 50**2) < 0.005
    share = [(w == v).mean() for v in range(4)]
    want = [math.comb(50, v) * (1 / 50) ** v * (49 / 50) ** (50 - v) for v in range(4)]
    assert np.allclose(share, want, atol=0.01)
    assert resample.multinomial_weights(df.limit(0), "k", 3).count() == 0


def test_tails(spark):
    """Against closed forms: an even number of degrees has a finite sum, one degree the normal tail, Kolmogorov both series."""
    rows = [(x, k) for x in (0.0, 0.01, 0.5, 2.0, 7.7, 25.0, 80.0, 240.0) for k in (1, 2, 4, 10, 30, 100, 200)]
    df = spark.createDataFrame(rows, "x double, k int").select("x", "k", aggregate.chi_square_p(F.col("x"), F.col("k")).alias("p"))
    for r in df.collect():
        if r.k % 2 == 0:
            want = math.exp(-r.x / 2) * sum((r.x / 2) ** i / math.factorial(i) for i in range(r.k // 2))
        else:
            want = math.erfc(math.sqrt(r.x / 2))
        assert r.p == pytest.approx(want, rel=1e-8, abs=1e-14), (r.x, r.k)
    df = spark.createDataFrame([(d,) for d in (0.0, 0.05, 0.1, 0.2, 0.4)], "d double").select("d", aggregate.kolmogorov_p(F.col("d"), F.lit(60), F.lit(80)).alias("p"))
    for r in df.collect():
        lam = r.d * math.sqrt(60 * 80 / 140)
        want = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 2000)) if lam > 0.04 else 1.0
        assert r.p == pytest.approx(want, abs=1e-9)
    g = spark.createDataFrame([(x / 7.3,) for x in range(1, 200)], "x double").select("x", aggregate.log_gamma(F.col("x")).alias("g"))
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-10, abs=1e-10) for r in g.collect())


def test_expected_information():
    """Against the sum over all terms, and on sizes that a loop over rows can't do."""
    r = np.random.default_rng(1)

    def loop(c):
        n, total = int(c.sum()), 0.0
        for a in c.sum(1).astype(int):
            for b in c.sum(0).astype(int):
                for k in range(max(1, a + b - n), min(a, b) + 1):
                    f = lambda x: math.lgamma(x + 1)
                    p = math.exp(f(a) + f(b) + f(n - a) + f(n - b) - f(n) - f(k) - f(a - k) - f(b - k) - f(n - a - b + k))
                    total += k / n * math.log(n * k / (a * b)) * p
        return total

    for shape in ((2, 2), (3, 5), (6, 4)):
        c = r.integers(0, 40, shape)
        assert geometry.expected_information(c) == pytest.approx(loop(c), abs=1e-9)
    assert geometry.expected_information(np.array([[3, 0], [0, 0]])) == pytest.approx(0)
    import time

    began = time.time()
    big = geometry.expected_information(np.outer(np.arange(1, 17), np.arange(16, 0, -1)) * (10**9 // (136 * 136)))
    assert time.time() - began < 5 and big == pytest.approx(15 * 15 / (2 * 10**9), rel=0.02)


def test_running_sums_stay_small_over_many_batches(spark, tmp_path):
    source, path, check = (str(tmp_path / x) for x in ("in", "sums", "state"))
    schema = "g string, v double"
    total = {}
    for i in range(12):
        rows = [("ab"[j % 2], float(i * j)) for j in range(6)] + [("c", None)]
        for g, v in rows:
            n, s = total.get(g, (0, 0.0))
            total[g] = (n + (v is not None), s + (v or 0.0))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    incremental.merge_sums(stream, "g", "v", path, check).awaitTermination()
    epochs = [x for x in os.listdir(path) if x.startswith("epoch=")]
    assert sorted(epochs) == ["epoch=10", "epoch=11"]
    got = {r.g: (r.n, r.s or 0.0) for r in incremental.latest_sums(spark, path, "g string, n long, s double, ss double").collect()}
    assert got == {k: (n, pytest.approx(s)) for k, (n, s) in total.items()}
    # the last batch run again, as after a lost commit
    commits = sorted((int(x) for x in os.listdir(f"{check}/commits") if x.isdigit()))
    for x in (str(commits[-1]), f".{commits[-1]}.crc"):
        if os.path.exists(f"{check}/commits/{x}"):
            os.remove(f"{check}/commits/{x}")
    incremental.merge_sums(stream, "g", "v", path, check).awaitTermination()
    again = {r.g: (r.n, r.s or 0.0) for r in incremental.latest_sums(spark, path, "g string, n long, s double, ss double").collect()}
    assert again == got
    shutil.rmtree(source)


def test_tied_ranks_of_millions_of_rows(spark):
    """Cubes of 2,200,000 rows pass 64 bits."""
    x = spark.range(0, 2_200_000, 1, 4).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).alias("g"))
    low = 550_000.5
    r = aggregate.kruskal(x.withColumn("r", F.when(F.col("y") == 0, low).otherwise(low + 1_100_000)), "g", "r").first()
    assert r.n == 2_200_000 and r.df == 2 and 0 <= r.h < 1e-3
    m = aggregate.mann_whitney(x.withColumn("s", F.lit(1)), "y", "s").first()
    assert m.auc == 0.5


def test_a_large_value_is_written_by_several_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        x = spark.range(0, 100_000, 1, 8).select(F.xxhash64("id").alias("k"), F.when(F.col("id") < 10, "few").otherwise("many").alias("g"))
        tables.write_by(x, f"{tmp_path}/e", "g")
    finally:
        spark.conf.set(size, old)
    files = {g: len([f for f in os.listdir(f"{tmp_path}/e/g={g}") if f.endswith(".parquet")]) for g in ("few", "many")}
    assert files["many"] > 4 and files["few"] == 1
    got = {r.g: r["count"] for r in spark.read.parquet(f"{tmp_path}/e").groupBy("g").count().collect()}
    assert got == {"few": 10, "many": 99_990}


def test_rows_are_computed_once(spark):
    """A robust z and a permutation test read their input's rows once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    x = spark.range(0, 50, 1, 2).select("id", (F.col("id") * 7 % 11).cast("double").alias("a"), (F.col("id") * 5 % 13).cast("double").alias("b"))
    once = lambda: x.mapInArrow(count, "id long, a double, b double")
    windows.robust_z(once(), "a").collect()
    assert seen.value == 50
    windows.debiased(once(), "a", "b").collect()
    assert seen.value == 100
    resample.permutation_test(once(), "id", "a", lambda t: F.corr("b", t), 3).collect()
    assert seen.value == 150
