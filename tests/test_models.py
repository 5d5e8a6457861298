"""Numpy twins of the linear jobs, planted signals, and properties."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators.bijection import partners
from panelforge.operators import aggregate, factors, geometry, inference, linear, resample, sampling, vectors, windows


@pytest.fixture(scope="module")
def planted(spark):
    """60 entities of 6 frames: x of 8 numbers, y with signal, group sizes uneven."""
    r = np.random.default_rng(0)
    rows = []
    for e in range(60):
        for k in range(6 if e % 7 else 2):
            x = r.standard_normal(8)
            rows.append((e * 10 + k, e, [float(v) for v in x], float(3 + 2 * x[0] - x[3] + 0.3 * r.standard_normal())))
    return rows, spark.createDataFrame(rows, "frame long, entity long, x array<double>, y double").repartition(5)


def test_folds_keep_entities_together_and_even(planted):
    rows, df = planted
    f = {r.entity: r.fold for r in linear.dealt_folds(df, "entity", 5).collect()}
    sizes = [sum(f[e] == k for _, e, *_ in rows) for k in range(5)]
    assert set(f) == {e for _, e, *_ in rows} and max(sizes) - min(sizes) <= 6
    h = df.select("entity", linear.hashed_fold("entity", 5).alias("fold")).distinct()
    assert h.count() == h.select("entity").distinct().count()


def _ridge(x, y, alpha):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda q: (q - m) / s @ w + y.mean()


def test_cross_validated_ridge_matches_numpy(planted):
    rows, df = planted
    f = df.join(linear.dealt_folds(df, "entity", 5), "entity")
    got = {r.frame: (r.fold, r.pred) for r in linear.cross_validated(f, "x", "y", alpha=3.0).predict(f).collect()}
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    fold = np.array([got[r[0]][0] for r in rows])
    want = np.zeros(len(y))
    for k in range(5):
        want[fold == k] = _ridge(x[fold != k], y[fold != k], 3.0)(x[fold == k])
    assert np.allclose([got[r[0]][1] for r in rows], want)
    assert linear.held_out_r2(f, "x", "y", alpha=3.0) == pytest.approx(1 - ((y - want) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert linear.held_out_r2(f, "x", "y", alpha=3.0) > 0.9


def test_same_result_for_any_partitioning(planted):
    _, df = planted
    a, b = (linear.total_gram(linear.design(df.repartition(n), "x", ["y"])) for n in (1, 8))
    assert np.allclose(a, b)
    one, two = ({r.entity: r["mean"] for r in vectors.mean_by(df.repartition(n), ["entity"], "x").collect()} for n in (1, 8))
    assert all(np.allclose(one[k], two[k]) for k in one)


def test_residuals_refuse_a_covariate_as_target(planted):
    with pytest.raises(ValueError):
        linear.residuals(planted[1], ["y"], ["y"])


def test_canonical_correlation_finds_a_shared_axis():
    r = np.random.default_rng(1)
    t = r.standard_normal(3000)
    x, y = np.column_stack([t + r.standard_normal(3000), r.standard_normal(3000)]), np.column_stack([r.standard_normal(3000), t + r.standard_normal(3000)])
    assert linear.canonical(np.cov(np.hstack([x, y]).T), 2)[0][0] == pytest.approx(0.5, abs=0.05)
    conditioned = linear.conditional(np.cov(np.column_stack([x, y, t]).T), [0, 1, 2, 3], [4])
    assert linear.canonical(conditioned, 2)[0][0] < 0.1


def test_o_information_signs():
    r = np.random.default_rng(2)
    f, e = r.standard_normal((2000, 1)), r.standard_normal((2000, 4))
    s = r.standard_normal((2000, 3))
    omega = lambda a: linear.o_information(np.cov(a.T))[2]
    assert abs(omega(e)) < 0.02 and omega(0.8 * f + 0.6 * e) > 0.1
    assert omega(np.column_stack([s, s.sum(1) + 0.3 * r.standard_normal(2000)])) < -0.1


def test_factor_analysis_with_missing_cells(spark):
    r = np.random.default_rng(3)
    w = np.array([1.0, 0.8, -0.6, 0.5, 0.0])
    x = np.outer(r.standard_normal(1500), w) + 0.4 * r.standard_normal((1500, 5)) + 2
    x[r.random(x.shape) < 0.15] = np.nan
    mean, load, psi = factors.factor_analysis(spark.createDataFrame([([None if np.isnan(v) else float(v) for v in row],) for row in x], "v array<double>"), "v", 1)
    load = load[:, 0] * np.sign(load[0, 0])
    assert np.allclose(mean, 2, atol=0.15) and np.allclose(load, w, atol=0.12) and np.allclose(psi, 0.16, atol=0.08)


@pytest.mark.parametrize("true", [0.3, 0.05])
def test_icc_recovers_a_planted_value(spark, true):
    r = np.random.default_rng(4)
    rows = [(e, float(np.sqrt(true) * b + np.sqrt(1 - true) * r.standard_normal())) for e in range(800) for b in [r.standard_normal()] for _ in range(1 + e % 7)]
    assert aggregate.icc(spark.createDataFrame(rows, "e int, v double"), "e", "v").first().icc == pytest.approx(true, abs=0.06)


def test_nearest_matches_numpy(planted):
    rows, df = planted
    x, ids = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.argsort(d[i])[:4]}
    for n in (1, 3):
        assert {(r.src, r.dst) for r in geometry.nearest(df, "frame", "x", 4, blocks=n).collect()} == want


def test_components_and_matching(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 10)], "src long, dst long")
    assert {r.node: r.component for r in geometry.connected(e).collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 8: 8, 9: 8}
    assert geometry.best_match(np.array([[1.0, 5, 2], [4, 6, 1]])) == [(0, 1), (1, 0)]
    score = np.random.default_rng(0).random((5, 5))
    from itertools import permutations

    best = max(sum(score[i, p[i]] for i in range(5)) for p in permutations(range(5)))
    assert sum(score[i, j] for i, j in geometry.best_match(score)) == pytest.approx(best)
    assert geometry.adjusted_information(np.diag([5.0, 7, 9])) == pytest.approx(1)
    assert abs(geometry.adjusted_information(np.full((3, 3), 20.0))) < 0.02


def test_permutation_p_is_even_under_the_null(spark):
    """Over many independent tables the p values are even: 300 draws against the 40 grid values of 39 replicates."""
    r = np.random.default_rng(6)
    ps = []
    for _ in range(300):
        a, b = r.standard_normal((2, 25))
        i = np.arange(1, 26)
        null = [abs(np.corrcoef(a, b[partners(i, np.full(25, 25), np.full(25, k)) - 1])[0, 1]) for k in range(1, 40)]
        ps.append((1 + sum(v >= abs(np.corrcoef(a, b)[0, 1]) - 1e-9 for v in null)) / 40)
    ps = np.sort(ps)
    assert np.abs(ps - np.arange(1, 301) / 300).max() < 1.63 / np.sqrt(300) + 1 / 40  # Kolmogorov's 1 % bound, and a grid step
    strong = spark.createDataFrame([(i, float(i), float(i)) for i in range(40)], "k long, a double, b double")
    assert resample.permutation_test(strong, "k", "b", lambda t: F.corr("a", t), 50).first().p == pytest.approx(1 / 51)


@pytest.mark.parametrize("n", [1, 2, 5, 10, 101, 997])
def test_partners_are_even_bijections(n):
    i, draws = np.arange(1, n + 1), 4000 if n <= 10 else 60
    at = np.stack([partners(i, np.full(n, n), np.full(n, r)) for r in range(draws)])
    assert (np.sort(at, axis=1) == i).all()
    assert (partners(i, np.full(n, n), np.full(n, 3), seed=1) != at[3]).any() or n <= 2
    if n == 10:  # each place takes each number equally often, and each pair of places each pair of numbers: chi-square within 5 deviations
        for cells, code in ((10, at[:, 0] - 1), (10, at[:, 7] - 1), (90, (at[:, 2] - 1) * 10 + at[:, 6] - 1)):
            seen = np.bincount(code, minlength=int(code.max()) + 1)
            seen = seen[seen > 0]
            assert len(seen) == cells
            chi = ((seen - draws / cells) ** 2).sum() / (draws / cells)
            assert abs(chi - (cells - 1)) < 5 * np.sqrt(2 * (cells - 1))


def test_permutations_beside_the_rows(spark):
    df = spark.createDataFrame([(i, float(i * i), [float(i)]) for i in range(50)], "k long, v double, x array<double>").repartition(3)
    rows = resample.with_permutations(df, "k", "v", 7).collect()
    assert len(rows) == 50 and all(len(r.perms) == 7 and r.v == r.k**2 and r.x == [float(r.k)] for r in rows)
    for r in range(7):
        assert sorted(x.perms[r] for x in rows) == sorted(x.v for x in rows)
    long = {(r.k, r.replicate): r.v_perm for r in resample.permuted(df, "k", "v", 7).collect()}
    assert long == {(r.k, i + 1): v for r in rows for i, v in enumerate(r.perms)}


def test_ranges_and_one_task_agree(spark, monkeypatch):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(int(g), float(np.round(v, 1)), int(i)) for i, (g, v) in enumerate(zip(r.integers(0, 3, 400), r.standard_normal(400)))], "g long, v double, i long").repartition(5)
    out = []
    for limit in (200_000, 10):
        monkeypatch.setattr(windows, "ONE_TASK", limit)
        out.append((
            sorted((x.i, x.number) for x in windows.numbered(df, ["v", "i"], ["g"]).collect()), sorted((x.i, x["rank"]) for x in windows.ranked(df, "v", by=["g"]).collect()),
            sorted((x.g, x.q0, x.q1, x.q2) for x in windows.quantiles(df, "v", [0.1, 0.5, 0.77], ["g"]).collect()), sorted((x.i, round(x.q, 12)) for x in windows.adjust_p(df.withColumn("p", F.abs("v") / 9)).collect()),
        ))
    assert out[0] == out[1]
    for g, *q in out[0][2]:
        v = [x.v for x in df.where(F.col("g") == g).collect()]
        assert q == pytest.approx(list(np.quantile(v, [0.1, 0.5, 0.77])))


def test_permutation_keeps_the_values(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "k long, s int, v double")
    p = resample.permuted(df, "k", "v", 3, strata=["s"]).groupBy("replicate", "s").agg(F.sum("v").alias("a"), F.sum("v_perm").alias("b"))
    assert all(r.a == r.b for r in p.collect())


def test_exact_budget_and_cap(planted):
    _, df = planted
    n = {r.entity: r["count"] for r in sampling.exactly(df, ["entity"], sampling.hash_key("frame"), "frame", 5).groupBy("entity").count().collect()}
    assert set(n.values()) == {5}
    assert sampling.capped(df, ["entity"], sampling.hash_key("frame"), "frame", 2).groupBy("entity").count().agg(F.max("count")).first()[0] == 2


def test_global_ranks_need_no_single_partition(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 1, 2, 3, 3)], "v double")
    assert sorted((r.v, r.rank) for r in windows.ranked(df, "v").collect()) == [(1, 1.5), (1, 1.5), (2, 3), (3, 5), (3, 5), (3, 5)]


def test_manifest_needs_a_root(spark):
    from panelforge.sources.tables import frame_manifest

    with pytest.raises(ValueError):
        frame_manifest(spark.range(1).toDF("frame"), spark.range(1).toDF("frame"), {}, ["x"])


def test_csv_round_trip(spark, tmp_path):
    from panelforge.sources import tables

    rows = [(1, "20s", 1.0, "ac", 2.5), (1, "zz", 2.0, "ac", None)]
    spark.createDataFrame(rows, tables.VISITS).write.csv(f"{tmp_path}/v", header=True)
    assert [tuple(r) for r in tables.read_visits(spark, f"{tmp_path}/v", ["20s"]).collect()] == rows[:1]
    tables.write_by(spark.createDataFrame([(1, "a"), (2, "b")], "k long, layer string"), f"{tmp_path}/e", "layer")
    assert tables.read_embeddings(spark, f"{tmp_path}/e", "b", ["k"]).collect()[0].k == 2
    found = tables.discover_files(spark, f"{tmp_path}/e", "*.parquet").collect()
    assert {r.subfolder for r in found} == {"layer=a", "layer=b"}


def test_normal_tail_matches_erfc(spark):
    import math

    z = [0.0, 0.3, 1.0, 1.96, 2.7, 2.9, 4.0, -5.5, 8.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(aggregate.normal_p(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in z], rel=1e-7, abs=1e-12)


def test_null_vectors_have_a_defined_result(spark):
    rows = [(1, "a", [1.0, 2.0]), (2, "a", None), (3, "a", [3.0, 4.0]), (4, "b", None), (5, "b", [0.0, 0.0]), (6, "c", None)]
    df = spark.createDataFrame(rows, "i long, k string, v array<double>").repartition(3)
    assert {r.k: (r.n, r["mean"]) for r in vectors.mean_by(df, ["k"], "v").collect()} == {"a": (2, [2.0, 3.0]), "b": (1, [0.0, 0.0])}
    assert {r.i: r.code for r in vectors.assign(df, "v", np.array([[0.0, 0.0], [3.0, 4.0]])).collect()} == {1: 0, 2: None, 3: 1, 4: None, 5: 0, 6: None}
    assert {r.i: r.p for r in vectors.with_pooled(df, "v", {"p": lambda t: t.sum((1, 2))[:, None]}, 1).collect()} == {1: [3.0], 2: None, 3: [7.0], 4: None, 5: [0.0], 6: None}
    assert {(r.src, r.dst) for r in geometry.nearest(df, "i", "v", 1).collect()} == {(1, 5), (3, 1), (5, 1)}
    with pytest.raises(Exception, match="different lengths"):
        vectors.mean_by(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k int, v array<double>").coalesce(1), ["k"], "v").collect()


def test_numbers_sums_quantiles_and_adjusted_p_by_ranges(spark):
    r = np.random.default_rng(9)
    p = np.round(r.random(400) ** 2, 2)
    fam = r.integers(0, 3, 400)
    df = spark.createDataFrame([(i, int(f), float(v)) for i, (f, v) in enumerate(zip(fam, p))], "i long, f int, p double").repartition(5)
    got = {x.i: x.number for x in windows.numbered(df, [-F.col("p"), "i"], ["f"]).collect()}
    for f in range(3):
        order = sorted(np.flatnonzero(fam == f), key=lambda i: (-p[i], i))
        assert [got[i] for i in order] == list(range(1, len(order) + 1))
    q = windows.quantiles(df, "p", [0.0, 0.33, 0.5, 1.0]).first()
    assert list(q) == pytest.approx(np.quantile(p, [0, 0.33, 0.5, 1]).tolist())
    for method in ("bh", "by"):
        got = {x.i: x.q for x in windows.adjust_p(df, "p", ["f"], method).collect()}
        for f in range(3):
            at = np.flatnonzero(fam == f)
            order = at[np.argsort(-p[at], kind="stable")]
            m, low = len(at), 1.0
            for i in order:
                rank = (p[at] <= p[i]).sum()
                low = min(low, p[i] * m / rank * (sum(1 / k for k in range(1, m + 1)) if method == "by" else 1))
                assert got[i] == pytest.approx(low)


def _planted_frames(spark, n=240):
    r = np.random.default_rng(12)
    x = r.standard_normal((n, 4))
    y = 24 + 3 * x[:, 0] - 2 * x[:, 1] + r.standard_normal(n)
    fold = r.integers(0, 4, n)
    df = spark.createDataFrame([(i, i % 40, int(f), [float(v) for v in a], float(b)) for i, (f, a, b) in enumerate(zip(fold, x, y))], "frame long, entity long, fold int, x array<double>, y double").repartition(4)
    return x, y, fold, df


def _weighted_ridge(x, y, w, alpha):
    n = w.sum()
    mx, my = (w[:, None] * x).sum(0) / n, (w * y).sum() / n
    sd = np.sqrt((w[:, None] * (x - mx) ** 2).sum(0) / n)
    z = (x - mx) / sd
    b = np.linalg.solve((w[:, None] * z).T @ z + alpha * np.eye(x.shape[1]), (w[:, None] * z).T @ (y - my)) / sd
    return my - mx @ b, b


def test_nested_calibration_matches_loops(spark):
    x, y, fold, df = _planted_frames(spark)
    low, high, bins = 16.0, 32.0, 6
    bin_ = np.clip(np.floor((y - low) / (high - low) * bins), 0, bins - 1).astype(int)

    def fit(train):
        counts = np.bincount(bin_[train], minlength=bins)
        w = 1 / counts[bin_[train]]
        return _weighted_ridge(x[train], y[train], w / w.mean(), 1.0)

    want = np.zeros(len(y))
    for f in range(4):
        ps, ys = [], []
        for g in set(range(4)) - {f}:
            a, b = fit((fold != f) & (fold != g))
            ps.append(a + x[fold == g] @ b)
            ys.append(y[fold == g])
        slope, cut = np.polyfit(np.concatenate(ps), np.concatenate(ys), 1)
        a, b = fit(fold != f)
        want[fold == f] = cut + slope * (a + x[fold == f] @ b)
    got = {r.frame: r.pred for r in inference.calibrated(df, "x", "y", low, high, bins).predict(df).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(want.tolist(), rel=1e-8)


def test_selection_spectra_and_posteriors(spark):
    x, y, fold, df = _planted_frames(spark)
    counts, r2, null = inference.nested_selection(df, "x", "y", "frame", shuffles=5)
    assert {i for i, n in counts if n == 4} >= {0, 1} and r2 > 0.8 > 0.2 > max(null)
    null = inference.null_spectra(df, "frame", "x", 30, 4, block=64).groupBy("axis").agg(F.avg("value").alias("m")).orderBy("axis").collect()
    direct = []
    for s in range(30):
        z = np.column_stack([np.random.default_rng([s, j]).permutation(x[:, j]) for j in range(4)])
        direct.append(np.linalg.eigvalsh(np.corrcoef(z.T))[::-1])
    assert [r.m for r in null] == pytest.approx(np.mean(direct, 0).tolist(), abs=0.04)
    boot = inference.bootstrap_spectra(df, "entity", "x", 20, 1).agg(F.avg("value")).first()[0]
    assert boot == pytest.approx(np.linalg.eigvalsh(np.corrcoef(x.T))[-1], abs=0.25)
    assert inference.half_angles(df, "entity", "x", 3).count() == 3
    load, psi, mean = np.array([[1.0], [0.5], [0.0]]), np.array([0.5, 1.0, 1.0]), np.array([1.0, 0.0, 0.0])
    rows = spark.createDataFrame([(1, [3.0, 1.0, 9.0]), (2, [None, 1.0, 9.0]), (3, [None, None, None])], "i int, v array<double>")
    got = {r.i: r.factors[0] for r in inference.posterior_means(rows, "v", mean, load, psi).collect()}
    assert got == pytest.approx({1: (4 + 0.5) / (1 + 2 + 0.25), 2: 0.5 / 1.25, 3: 0.0})


def test_ard_leaves_unneeded_factors_out(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((400, 1)) @ np.array([[1.0, 0.8, -0.7, 0.9, 0.6]]) + 0.5 * r.standard_normal((400, 5))
    df = spark.createDataFrame([([float(a) if r.random() > 0.1 else None for a in row],) for row in v], "v array<double>")
    _, load, _ = factors.factor_analysis(df, "v", 3, 300, 1e-9, ard=True)
    size = np.sort((load**2).sum(0))[::-1]
    assert size[0] > 1.5 and size[1] < 0.05 * size[0]


def test_increments_and_clocks_match_loops(spark):
    x, y, fold, df = _planted_frames(spark)
    got = inference.clocks(df.withColumn("g", F.lit(1)), ["g"], "x", "y", alpha=2.0, least=10).first()
    pred = np.zeros(len(y))
    for f in range(4):
        a, b = _weighted_ridge(x[fold != f], y[fold != f], np.ones((fold != f).sum()), 2.0)
        pred[fold == f] = a + x[fold == f] @ b
    assert got.n == len(y) and got.r2 == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert inference.clocks(df.withColumn("g", F.lit(1)), ["g"], "x", "y").count() == 0  # fewer than 500 rows
    wide = df.select("entity", "y", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    s = inference.spread(inference.increments(wide, ["a"], ["b"], "y", "entity", 6), "increment").first()
    assert 0.1 < s["mean"] < 0.6 and s.low <= s["mean"] <= s.high and s.not_above == 0 and s.seeds == 6


def test_spline_z_is_free_of_time(spark):
    r = np.random.default_rng(2)
    t = r.uniform(6, 40, 600)
    v = np.exp(0.02 * t + 0.3 * np.sin(t / 8) + 0.5 * r.standard_normal(600))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, v))] + [(700, 9.0, -1.0), (701, 9.0, None)], "i long, t double, v double")
    rows = inference.spline_z(df, "v", "t").collect()
    assert len(rows) == 602 and abs(rows[0].with_time) < 0.15 and rows[0].with_raw > 0.8 and rows[0].valid
    z = [x.z for x in rows if x.z is not None]
    assert len(z) == 600 and abs(np.median(z)) < 1e-9 and np.median(np.abs(z)) == pytest.approx(1 / 1.4826)


def test_held_out_mask_must_be_there(spark):
    from panelforge.operators import panel

    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "e int, v double")
    assert panel.held_out_only(df, df.where("e = 2"), "e").count() == 1
    for mask in (None, df.limit(0), df.select("v")):
        with pytest.raises(ValueError):
            panel.held_out_only(df, mask, "e")
