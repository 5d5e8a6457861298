"""I: linear-model and geometry jobs."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.catalog.aggregates import sparse_codes
from panelforge.catalog.fixtures import ENTITY_LAG, FRAMES, VISITS, WIDE, codes, entity_lag, frames, wide
from panelforge.operators import aggregate, factors, geometry, inference, lineage, linear, neighbours, resample, screens, vectors, windows
from panelforge.registry import q6, query, r6

FOLDS = 5


def _folded(spark, d):
    f = frames(spark, d)
    return f.join(linear.dealt_folds(f, "entity", FOLDS), "entity")


_FOLD = "n AS (SELECT entity, count(*) AS c FROM frames GROUP BY entity), i AS (SELECT entity, row_number() OVER (ORDER BY c DESC, entity) - 1 AS i FROM n), folds AS (SELECT entity, CAST(CASE WHEN i % 10 < 5 THEN i % 10 ELSE 9 - i % 10 END AS INTEGER) AS fold FROM i), fr AS (SELECT * FROM frames JOIN folds USING (entity))"


def _result(spark, rows: dict):
    return spark.createDataFrame([(k, float(v)) for k, v in rows.items()], "metric string, value double").select("metric", r6("value").alias("value"))


@query(f"WITH {FRAMES}, {_FOLD} SELECT fold, count(*) AS n, {q6('sum(x1)')} AS sx1, {q6('sum(x1 * x2)')} AS sx1x2, {q6('sum(x2 * x2)')} AS sx2x2, {q6('sum(x1 * y)')} AS sx1y FROM fr GROUP BY fold")
def i01_fold_gram(spark, d):
    g = linear.grams(linear.design(_folded(spark, d), ["x1", "x2"], ["y"], keep=["fold"]), "fold")
    rows = [(int(f), int(round(m[0, 0])), *[float(m[i]) for i in ((0, 1), (1, 2), (2, 2), (1, 3))]) for f, m in g.items()]
    x = spark.createDataFrame(rows, "fold int, n long, sx1 double, sx1x2 double, sx2x2 double, sx1y double")
    return x.select("fold", "n", *[r6(c).alias(c) for c in ("sx1", "sx1x2", "sx2x2", "sx1y")])


@query(f"""WITH {FRAMES}, {_FOLD}, s AS (SELECT f.fold, count(*) AS n, avg(x1) AS mx, avg(y) AS my, var_pop(x1) AS vx, covar_pop(x1, y) AS c FROM fr JOIN (SELECT DISTINCT fold FROM folds) f ON fr.fold <> f.fold GROUP BY f.fold),
 w AS (SELECT fold, mx, my, n * c / (n * vx + 5 * vx) AS b FROM s) SELECT frame, fr.fold, {q6('my + (x1 - mx) * b')} AS pred FROM fr JOIN w USING (fold)""")
def i02_grouped_ridge(spark, d):
    f = _folded(spark, d)
    p = linear.cross_validated(f, ["x1"], "y", alpha=5.0).predict(f.select("frame", "fold", "x1"))
    return p.select("frame", "fold", r6("pred").alias("pred"))


@query(f"""WITH {FRAMES}, {_FOLD}, s AS (SELECT f.fold, count(*) AS n, avg(x1) AS mx, avg(y) AS my, var_pop(x1) AS vx, covar_pop(x1, y) AS c FROM fr JOIN (SELECT DISTINCT fold FROM folds) f ON fr.fold <> f.fold GROUP BY f.fold),
 a AS (SELECT unnest([0.5, 5.0, 500.0])::DOUBLE AS alpha), p AS (SELECT alpha, y, my + (x1 - mx) * n * c / (n * vx + alpha * vx) AS pred FROM fr JOIN s USING (fold), a) SELECT alpha, {q6('1 - sum(pow(y - pred, 2)) / (var_pop(y) * count(*))')} AS r2 FROM p GROUP BY alpha""")
def i02_alpha_path(spark, d):
    found = linear.alpha_path(_folded(spark, d), ["x1"], "y", (0.5, 5.0, 500.0))
    return spark.createDataFrame(list(found.items()), "alpha double, r2 double").select("alpha", r6("r2").alias("r2"))


@query(f"WITH {FRAMES}, s AS (SELECT count(*) AS n, avg(x1) AS mx, avg(y) AS my, var_pop(x1) AS vx, covar_pop(x1, y) AS c FROM frames) SELECT frame, {q6('my + (x1 - mx) * n * c / (n * vx + 5 * vx)')} AS pred FROM frames, s")
def i02_in_sample(spark, d):
    f = _folded(spark, d)
    return linear.in_sample(f, ["x1"], "y", alpha=5.0).predict(f.select("frame", "fold", "x1")).select("frame", r6("pred").alias("pred"))


@query(f"WITH {FRAMES} SELECT frame, {q6('y - avg(y) OVER (PARTITION BY stratum)')} AS y_res FROM frames")
def i03_levels(spark, d):
    """Residuals on the levels of a category: what is left beside its group's mean."""
    return linear.residuals(frames(spark, d), ["y"], [], levels=["stratum"]).select("frame", r6("y_res").alias("y_res"))


@query(f"WITH {FRAMES} SELECT frame, {q6('y - regr_slope(y, x1) OVER () * x1 - regr_intercept(y, x1) OVER ()')} AS y_res FROM frames")
def i03_residualise(spark, d):
    return linear.residuals(frames(spark, d), ["y"], ["x1"]).select("frame", r6("y_res").alias("y_res"))


@query(f"WITH {FRAMES} SELECT count(*) AS n, {q6('var_pop(y)')} AS raw, {q6('var_pop(y) * (1 - pow(corr(y, x1), 2))')} AS time, {q6('var_pop(y) * (1 - (pow(corr(y, x1), 2) + pow(corr(y, x2), 2) - 2 * corr(y, x1) * corr(y, x2) * corr(x1, x2)) / (1 - pow(corr(x1, x2), 2)))')} AS both FROM frames")
def i04_three_versions(spark, d):
    f = frames(spark, d)
    one = linear.residuals(f, ["y"], ["x1"], suffix="_t")
    two = linear.residuals(one, ["y"], ["x1", "x2"], suffix="_ts")
    return two.agg(F.count("*").alias("n"), r6(F.var_pop("y")).alias("raw"), r6(F.var_pop("y_t")).alias("time"), r6(F.var_pop("y_ts")).alias("both"))


@query(f"WITH {ENTITY_LAG}, c AS (SELECT corr(lag, size) AS ab, corr(lag, weeks) AS az, corr(size, weeks) AS bz FROM entity_lag), k AS (SELECT rank() OVER (ORDER BY lag) + (count(*) OVER (PARTITION BY lag) - 1) / 2.0 AS a, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0 AS b, rank() OVER (ORDER BY weeks) + (count(*) OVER (PARTITION BY weeks) - 1) / 2.0 AS z FROM entity_lag), r AS (SELECT corr(a, b) AS ab, corr(a, z) AS az, corr(b, z) AS bz FROM k) SELECT {q6('(c.ab - c.az * c.bz) / sqrt((1 - c.az * c.az) * (1 - c.bz * c.bz))')} AS pearson, {q6('(r.ab - r.az * r.bz) / sqrt((1 - r.az * r.az) * (1 - r.bz * r.bz))')} AS spearman FROM c, r")
def i05_partial_correlation(spark, d):
    e = entity_lag(spark, d)
    for c in ("lag", "size", "weeks"):
        e = windows.ranked(e, c, f"r_{c}")
    return e.agg(r6(linear.partial_correlation("lag", "size", "weeks")).alias("pearson"), r6(linear.partial_correlation("r_lag", "r_size", "r_weeks")).alias("spearman"))


@query()
def i05_train_fold(spark, d):
    """Partial rank correlation given a cubic in time and a group, the nuisance fitted on the other folds only."""
    e = entity_lag(spark, d)
    for c in ("lag", "size"):
        e = windows.ranked(e, c, f"r_{c}")
    e = e.withColumns({"t": F.col("weeks").cast("double"), "sex": (F.col("entity") % 2).cast("double"), "fold": linear.hashed_fold("entity", FOLDS)})
    e = e.withColumns({"t2": F.col("t") * F.col("t") / 100, "t3": F.col("t") * F.col("t") * F.col("t") / 10000})
    x = linear.residuals(e, ["r_lag", "r_size"], ["t", "t2", "t3", "sex"], fold="fold")
    return x.agg(r6(F.corr("r_lag_res", "r_size_res")).alias("r"), F.count("*").alias("n"))


@query(f"WITH {FRAMES}, {_FOLD} SELECT entity, fold FROM folds")
def i06_dealt_folds(spark, d):
    return linear.dealt_folds(frames(spark, d), "entity", FOLDS)


_EQUAL = "f AS (SELECT *, entity * 7919 % 10007 % 5 AS fold FROM frames)"
_RIDGE1 = "s AS (SELECT g.{k}, g.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS c FROM {t} f JOIN (SELECT DISTINCT {k}, fold FROM {t}) g ON f.{k} = g.{k} AND f.fold <> g.fold GROUP BY ALL)"


def _equal(spark, d):
    """Frames with folds that SQL can state."""
    return frames(spark, d).withColumn("fold", (F.col("entity") * 7919 % 10007 % 5).cast("int"))


@query(f"""WITH {FRAMES}, {_EQUAL}, l AS (SELECT unnest(['stratum', 'pooled']) AS level, unnest([stratum, -1]) AS stratum, x1 AS x, y, fold FROM f), k AS (SELECT level || stratum AS k, * FROM l), {_RIDGE1.format(k='k', t='k')}
SELECT level, stratum, count(*) AS n, {q6('1 - sum(pow(y - my - (x - mx) * (n * c / (n * vx + vx)), 2)) / (var_pop(y) * count(*))')} AS r2 FROM k JOIN s ON k.k = s.k AND k.fold = s.fold GROUP BY ALL HAVING count(*) >= 10""")
def i07_clock_by_stratum(spark, d):
    """A clock for each stratum of enough rows, and the pooled one."""
    f = _equal(spark, d)
    both = f.select(F.lit("stratum").alias("level"), F.col("stratum"), "x1", "y", "fold").union(f.select(F.lit("pooled"), F.lit(-1), "x1", "y", "fold"))
    return inference.clocks(both, ["level", "stratum"], ["x1"], "y", alpha=1.0, least=10).withColumn("r2", r6("r2"))


@query()
def i07_clock_by_layer(spark, d):
    """A clock for each layer (eighths of the vector) and stratum, from 40 rows."""
    f = _folded(spark, d).select("stratum", "fold", "y", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("emb", i * 8 + 1, 8))).alias("layer", "v"))
    return inference.clocks(f, ["layer", "stratum"], "v", "y", least=40).withColumn("r2", r6("r2"))


@query()
def i08_appearance_lag(spark, d):
    """Lag of the mean of two encoders' predictions (the halves of the vector), per entity."""
    f = _folded(spark, d).withColumns({"first": F.slice("emb", 1, 32), "second": F.slice("emb", 33, 32)})
    for name in ("first", "second"):
        f = linear.cross_validated(f, name, "y", alpha=50.0).predict(f, name=f"p_{name}")
    lag = lambda p: r6(F.avg(p - F.col("y")))
    return f.groupBy("entity").agg(lag((F.col("p_first") + F.col("p_second")) / 2).alias("lag"), lag(F.col("p_first")).alias("first"), lag(F.col("p_second")).alias("second"), F.count("*").alias("n"))


@query()
def i09_weighted_ridge(spark, d):
    """Balance weights of the training rows, predictions calibrated by nested folds."""
    f = _folded(spark, d)
    p = inference.calibrated(f, "emb", "y", 18, 28, 8, alpha=50.0).predict(f)
    return p.agg(r6(F.corr("pred", "y")).alias("r"), r6(F.regr_slope("y", "pred")).alias("slope"), F.count("*").alias("n"))


@query(f"""WITH {FRAMES}, {_EQUAL}, l AS (SELECT 'x1' AS k, x1 AS x, y, fold FROM f UNION ALL SELECT 'x2', x2, y, fold FROM f), {_RIDGE1.format(k='k', t='l')}
SELECT l.k AS metric, {q6('1 - sum(pow(y - my - (x - mx) * (n * c / (n * vx + vx)), 2)) / (var_pop(y) * count(*))')} AS value FROM l JOIN s ON l.k = s.k AND l.fold = s.fold GROUP BY l.k""")
def i10_feature_sets(spark, d):
    """Out-of-fold R2 of single features (what more features add, over seeds, is k09)."""
    f = _equal(spark, d)
    return _result(spark, {c: linear.held_out_r2(f, [c], "y", alpha=1.0) for c in ("x1", "x2")})


@query()
def i10_increment(spark, d):
    """What the whole vector adds to its first three components, with the spread over fold seeds."""
    f = frames(spark, d).select("entity", "y", *[F.col("emb")[i].cast("double").alias(f"e{i}") for i in range(64)])
    names = [f"e{i}" for i in range(64)]
    x = inference.increments(f, names[:3], names[3:], "y", "entity", 10, alpha=50.0)
    return inference.spread(x, "increment").select(*[r6(c).alias(c) for c in ("mean", "low", "high", "not_above")], "seeds")


def _logistic(f, columns, name):
    """Out-of-fold probabilities of a class-balanced logistic regression."""
    share = f.agg(F.avg("label").alias("s")).first()["s"]
    x = f.withColumn("features", array_to_vector(F.array(*columns))).withColumn("w", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    out = None
    for k in range(3):
        model = LogisticRegression(weightCol="w", maxIter=20, regParam=0.01).fit(x.where(F.col("fold") % 3 != k))
        p = model.transform(x.where(F.col("fold") % 3 == k)).select("frame", vector_to_array("probability")[1].alias(name))
        out = p if out is None else out.unionAll(p)
    return out


def _labelled(spark, d):
    return _folded(spark, d).withColumn("label", (F.col("y") > 22.5).cast("int"))


@query()
def i11_logistic_folds(spark, d):
    f = _labelled(spark, d)
    p = _logistic(f, ["x1", "x2", "x3"], "p").join(f.select("frame", "label"), "frame")
    return aggregate.auc(p, "label", "p").select(r6("auc").alias("auc"), "n1", "n0")


@query()
def i12_decision_fusion(spark, d):
    """Sum of the blocks' log odds, the joint model, and the best single block."""
    f = _labelled(spark, d)
    odds = lambda c: F.ln(F.greatest(F.col(c), F.lit(1e-6)) / F.greatest(1 - F.col(c), F.lit(1e-6)))
    p = _logistic(f, ["x1"], "a").join(_logistic(f, ["x2"], "b"), "frame").join(_logistic(f, ["x1", "x2"], "joint"), "frame").join(f.select("frame", "label"), "frame").withColumn("fused", odds("a") + odds("b"))
    rows = {n: aggregate.auc(p, "label", n).first()["auc"] for n in ("a", "b", "fused", "joint")}
    return _result(spark, rows | {"best_single": max(rows["a"], rows["b"])})


@query()
def i13_pca(spark, d):
    _, cov = linear.covariance(frames(spark, d), "emb")
    values, _ = linear.principal(cov, 10)
    share = values / np.trace(cov)
    return spark.createDataFrame([(i, float(v), float(s)) for i, (v, s) in enumerate(zip(values, share.cumsum()))], "axis int, variance double, retained double").select("axis", r6("variance").alias("variance"), r6("retained").alias("retained"))


@query()
def i13_pca_by_stratum(spark, d):
    return inference.pca_by(frames(spark, d), "stratum", "emb", 5).select("stratum", "axis", r6("variance").alias("variance"), r6("retained").alias("retained"))


@query()
def i13_scores(spark, d):
    """Entity means beside the vector's own components (complete cases), on their two main axes."""
    f = frames(spark, d)
    m = vectors.mean_by(f, ["entity"], "emb").select("entity", F.col("mean").alias("pool"))
    x = f.join(m, "entity").select("frame", F.concat(F.transform("emb", lambda v: v.cast("double")), "pool").alias("v"))
    _, mean, cov = linear.moments_of(linear.total_gram(linear.design(x, "v")))
    s = inference.scores(x, "v", mean, linear.principal(cov, 2)[1])
    return s.select("frame", *[r6(F.col("scores")[i]).alias(f"s{i}") for i in range(2)])


@query()
def i14_velocity_jacobian(spark, d):
    """Per transition: velocity regressed on position, ridge on the intercept too."""
    w = wide(spark, d)
    names = ["click", "view"]
    v = [windows.velocity(w, "entity", "visit", "t", c).withColumnRenamed("velocity", f"v_{c}").drop("mid_time") for c in names]
    x = w.join(v[0], ["entity", "visit"]).join(v[1], ["entity", "visit"])
    rows = []
    for k, g in sorted(linear.grams(linear.design(x, names, ["v_click", "v_view"], keep=["visit"]), "visit").items()):
        trace, largest, fixed, axis = linear.flow(g, 2)
        rows.append((int(k), trace, largest, *fixed, *axis, int(round(g[0, 0]))))
    columns = ["trace", "largest", "fixed_click", "fixed_view", "axis_click", "axis_view"]
    x = spark.createDataFrame(rows, "visit int, " + ", ".join(f"{c} double" for c in columns) + ", n long")
    return x.select("visit", *[r6(c).alias(c) for c in columns], "n")


@query()
def i15_canonical_correlation(spark, d):
    """Of the halves of the vector."""
    g = linear.grams(linear.design(_folded(spark, d), "emb", keep=["fold"]), "fold")
    return _result(spark, {"in_sample": linear.canonical(linear.moments_of(sum(g.values()))[2], 32)[0][0], "held_out": linear.held_out_canonical(g, 32)})


@query()
def i16_adjustment_ladder(spark, d):
    f = frames(spark, d).select(F.concat(F.transform(F.slice("emb", 4, 61), lambda v: v.cast("double")), F.array("y", "x1", "x2", F.col("stratum").cast("double"))).alias("v"))
    _, cov = linear.covariance(f, "v")
    return _result(spark, linear.ladder(cov, range(61), [61], {"raw": [], "time": [62], "time+size": [62, 63], "time+size+block": [62, 63, 64]}))


def _variables(spark, d):
    f = frames(spark, d)
    return f.select("frame", "y", "x1", F.when(F.col("frame") % 4 > 0, F.col("x2") + F.col("stratum")).alias("gap")).unpivot(["frame"], ["y", "x1", "gap"], "variable", "value")


@query()
def i17_screen(spark, d):
    f = _folded(spark, d).select("frame", "fold", "emb")
    return screens.screen(_variables(spark, d), f, "variable", "frame", "value", "emb", "fold").withColumn("r2", r6("r2"))


@query()
def i18_split_screen(spark, d):
    """Rank variables on one half, test the best on the other."""
    f = _folded(spark, d).select("frame", "fold", "emb")
    long = _variables(spark, d)
    half = F.pmod(F.xxhash64("frame"), F.lit(2))
    first = screens.screen(long.where(half == 0), f, "variable", "frame", "value", "emb", "fold", least=50)
    second = screens.screen(long.where(half == 1), f, "variable", "frame", "value", "emb", "fold", least=50)
    best = first.orderBy(F.desc("r2"), "variable").limit(2).withColumnRenamed("r2", "ranked").drop("n")
    return best.join(second, "variable").select("variable", r6("ranked").alias("ranked"), "n", r6("r2").alias("tested"))


@query()
def i19_o_information(spark, d):
    """Over all rows and per tertile of y, with the conditioning of the correlations."""
    f = windows.percentile_cut(frames(spark, d), "y", [1 / 3, 2 / 3], "tertile")
    g = linear.grams(linear.design(f, ["x1", "x2", "x3", "y"], keep=["tertile"]), "tertile")
    rows = []
    for name, m in [("all", sum(g.values())), *((f"tertile {k}", v) for k, v in sorted(g.items()))]:
        tc, dtc, omega, low = linear.o_information(linear.moments_of(m)[2])
        high = float(np.linalg.eigvalsh(inference.correlation(m))[-1])
        rows.append((name, int(round(m[0, 0])), *map(float, (tc, dtc, omega, low, high / low))))
    columns = ["total", "dual", "omega", "least_eigenvalue", "condition"]
    x = spark.createDataFrame(rows, "stratum string, n long, " + ", ".join(f"{c} double" for c in columns))
    return x.select("stratum", "n", *[r6(c).alias(c) for c in columns])


@query()
def i20_factor_analysis(spark, d):
    w = wide(spark, d).select(F.array("click", "error", "purchase", "signup", "view").alias("v"))
    mean, load, psi = factors.factor_analysis(w, "v", 1, 60)
    return spark.createDataFrame([(i, float(m), float(abs(l[0])), float(p)) for i, (m, l, p) in enumerate(zip(mean, load, psi))], "column int, mean double, loading double, noise double")


@query()
def i20_posterior_means(spark, d):
    """Expected factors of every visit, from a model that leaves out the factors it doesn't need."""
    w = wide(spark, d).select("entity", "visit", F.array("click", "error", "purchase", "signup", "view").alias("v"))
    s = w.select(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(5)], *[F.stddev_pop(F.col("v")[i]).alias(f"s{i}") for i in range(5)])
    w = w.crossJoin(F.broadcast(s)).select("entity", "visit", F.array(*[(F.col("v")[i] - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(5)]).alias("v"))
    mean, load, psi = factors.factor_analysis(w, "v", 2, 60, ard=True)
    x = inference.posterior_means(w, "v", mean, load, psi)
    return x.select("entity", "visit", *[r6(F.abs(F.col("factors")[i])).alias(f"f{i}") for i in range(2)])


@query()
def i21_spectrum(spark, d):
    """Leading eigenvalues with bootstrap intervals beside those of permuted columns: mean and 95th percentile."""
    f = frames(spark, d)
    g = linear.total_gram(linear.design(f, "emb"))
    values = np.linalg.eigvalsh(inference.correlation(g))[::-1][:5]
    real = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "axis int, value double")
    null = inference.null_spectra(f, "frame", "emb", 20).groupBy("axis").agg(F.avg("value").alias("null_mean"), F.percentile("value", F.lit(0.95)).alias("null_p95"))
    boot = inference.bootstrap_spectra(f, "entity", "emb", 20).groupBy("axis").agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))
    x = real.join(null, "axis").join(boot, "axis")
    return x.select("axis", *[r6(c).alias(c) for c in ("value", "low", "high", "null_mean", "null_p95")], (F.col("value") > F.col("null_p95")).alias("above"))


@query()
def i21_stability(spark, d):
    """Participation ratio, axes up to 90 and 95 % of the variance, and the angle between halves of the entities over splits."""
    f = frames(spark, d)
    values = np.linalg.eigvalsh(linear.covariance(f, "emb")[1])[::-1]
    share = values.cumsum() / values.sum()
    a = inference.half_angles(f, "entity", "emb", 20).agg(F.avg("angle").alias("m"), F.max("angle").alias("x")).first()
    return _result(spark, {"participation": linear.participation(values), "axes_90": int((share < 0.9).sum()) + 1, "axes_95": int((share < 0.95).sum()) + 1, "angle": a.m, "largest_angle": a.x})


@query()
def i22_axis_labels(spark, d):
    _, cov = linear.covariance(frames(spark, d), "emb")
    load = linear.varimax(linear.principal(cov, 3)[1])
    rows = [(k, b, float(np.abs(load[b * 16 : b * 16 + 16, k]).mean())) for k in range(3) for b in range(4)]
    return spark.createDataFrame(rows, "axis int, block int, loading double").withColumn("loading", r6("loading"))


_KNN = "p AS (SELECT a.frame AS src, b.frame AS dst, list_distance(a.v, b.v) AS dist FROM v8 a, v8 b WHERE a.frame <> b.frame), knn AS (SELECT src, dst, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round_even(dist, 9), dst) AS rank FROM p) WHERE rank <= 10)"
_V8 = "v8 AS (SELECT frame, list_transform(emb, lambda x: CAST(x AS DOUBLE)) AS v FROM frames)"
_HALVES = "h1 AS (SELECT frame, v[1:32] AS v FROM v8), h2 AS (SELECT frame, v[33:64] AS v FROM v8)"


def _knn(spark, d, k=10, vector="emb"):
    f = frames(spark, d).withColumns({"first": F.slice("emb", 1, 32), "second": F.slice("emb", 33, 32)})
    return geometry.nearest(f.select("frame", vector), "frame", vector, k)


@query(f"WITH {FRAMES}, {_V8}, {_KNN} SELECT src, dst, CAST(rank AS INTEGER) AS rank, {q6('dist')} AS dist FROM knn")
def i23_nearest(spark, d):
    return _knn(spark, d).select("src", "dst", "rank", r6("dist").alias("dist"))


@query(f"WITH {FRAMES}, {_V8}, {_KNN}, s AS (SELECT src AS node, dist AS s FROM knn WHERE rank = 7) SELECT least(src, dst) AS a, greatest(src, dst) AS b, {q6('max(exp(-dist * dist / (s1.s * s2.s)))')} AS w FROM knn JOIN s s1 ON s1.node = src JOIN s s2 ON s2.node = dst GROUP BY ALL")
def i23_affinity(spark, d):
    return geometry.affinity(_knn(spark, d), 7).withColumn("w", r6("w"))


@query(f"""WITH {FRAMES}, m AS (SELECT frame, i, CASE WHEN (frame + i) % 4 > 0 THEN CAST(emb[i + 1] AS DOUBLE) END AS v FROM frames, range(64) r(i)), p AS (SELECT a.frame AS src, b.frame AS dst, sqrt(sum(pow(a.v - b.v, 2)) * 64 / count(*)) AS dist FROM m a JOIN m b ON a.i = b.i AND a.frame <> b.frame WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL HAVING count(*) >= 4)
SELECT src, dst, CAST(rank AS INTEGER) AS rank, {q6('dist')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round_even(dist, 9), dst) AS rank FROM p) WHERE rank <= 3""")
def i24_masked_nearest(spark, d):
    f = frames(spark, d).select("frame", F.transform("emb", lambda v, i: F.when((F.col("frame") + i) % 4 > 0, v)).alias("v"))
    return geometry.nearest(f, "frame", "v", 3, geometry.masked(4)).select("src", "dst", "rank", r6("dist").alias("dist"))


_NEAR = "SELECT src, dst FROM (SELECT a.frame AS src, b.frame AS dst, row_number() OVER (PARTITION BY a.frame ORDER BY round_even(list_distance(a.v, b.v), 9), b.frame) AS rank FROM {0} a, {0} b WHERE a.frame <> b.frame) WHERE rank <= 10"


@query(f"WITH {FRAMES}, {_V8}, {_HALVES}, k1 AS ({_NEAR.format('h1')}), k2 AS ({_NEAR.format('h2')}) SELECT k.src, {q6('count(k2.dst) / 10.0')} AS overlap FROM k1 k LEFT JOIN k2 ON k.src = k2.src AND k.dst = k2.dst GROUP BY k.src")
def i25_neighbour_overlap(spark, d):
    """Two spaces: the halves of the vector."""
    return geometry.overlap(_knn(spark, d, vector="first"), _knn(spark, d, vector="second"), 10).select("src", r6("overlap").alias("overlap"))


@query(f"WITH {FRAMES}, {_V8}, {_KNN}, r AS (SELECT src, ln(max(dist) FILTER (rank = 2) / max(dist) FILTER (rank = 1)) AS m FROM knn WHERE rank <= 2 GROUP BY src HAVING max(dist) FILTER (rank = 1) > 0), e AS (SELECT m, -ln(1 - row_number() OVER (ORDER BY m, src) / (count(*) OVER () + 1.0)) AS y FROM r) SELECT {q6('count(*) / sum(m)')} AS mle, {q6('sum(m * y) / sum(m * m)')} AS regression FROM e")
def i26_two_nn(spark, d):
    return geometry.two_nn(_knn(spark, d)).select(r6("mle").alias("mle"), r6("regression").alias("regression"))


@query(f"WITH {FRAMES}, {_V8}, {_KNN}, t AS (SELECT src, dist AS t FROM knn WHERE rank = 10), q AS (SELECT src, count(*) / sum(ln(t / dist)) AS d FROM knn JOIN t USING (src) WHERE rank < 10 AND dist > 0 GROUP BY src) SELECT {q6('avg(d)')} AS dimension, {q6('count(*) / sum(1 / d)')} AS harmonic FROM q")
def i26_levina_bickel(spark, d):
    return geometry.levina_bickel(_knn(spark, d), 10).select(r6("dimension").alias("dimension"), r6("harmonic").alias("harmonic"))


DRAWS = 20_000
_PAIRS = f"""nr AS (SELECT frame, row_number() OVER (ORDER BY frame) AS i, count(*) OVER () AS n FROM frames), dr AS (SELECT d, (d * 7919 + d * d % 10007 * 31) % n + 1 AS i, (d * 104729 + d * d % 9973 * 17) % n + 1 AS j FROM range(1, {DRAWS + 1}) r(d), (SELECT max(n) AS n FROM nr)),
 pr AS (SELECT DISTINCT least(x.frame, y.frame) AS a, greatest(x.frame, y.frame) AS b FROM dr JOIN nr x ON x.i = dr.i JOIN nr y ON y.i = dr.j WHERE x.frame <> y.frame)"""


def _pairs(spark, d):
    """A bounded sample of pairs, drawn in a way that SQL can state too."""
    k = F.col("_d")
    draw = {1: k * 7919 + k * k % 10007 * 31, 2: k * 104729 + k * k % 9973 * 17}
    return geometry.sampled_pairs(frames(spark, d), "frame", DRAWS, draw.get)


@query(f"WITH {FRAMES}, {_V8}, {_PAIRS}, x AS (SELECT list_distance(p.v, q.v) AS d FROM pr JOIN v8 p ON p.frame = a JOIN v8 q ON q.frame = b), e AS (SELECT unnest([0.05, 0.1, 0.2, 0.3])::DOUBLE AS share), r AS (SELECT share, (SELECT quantile_cont(d, 0.05) FROM x) AS r5, (SELECT quantile_cont(d, 0.1) FROM x) AS r10, (SELECT quantile_cont(d, 0.2) FROM x) AS r20, (SELECT quantile_cont(d, 0.3) FROM x) AS r30 FROM e) SELECT {q6('regr_slope(ln(share), ln(CASE share WHEN 0.05 THEN r5 WHEN 0.1 THEN r10 WHEN 0.2 THEN r20 ELSE r30 END))')} AS dimension FROM r")
def i27_correlation_dimension(spark, d):
    x = geometry.pair_distances(frames(spark, d), "frame", "emb", _pairs(spark, d))
    shares = (0.05, 0.1, 0.2, 0.3)
    q = x.agg(*[F.percentile("dist", F.lit(s)).alias(f"r{i}") for i, s in enumerate(shares)])
    rows = q.select(F.inline(F.array(*[F.struct(F.ln(F.lit(s)).alias("y"), F.ln(F.col(f"r{i}")).alias("x")) for i, s in enumerate(shares)])))
    return rows.agg(r6(F.regr_slope("y", "x")).alias("dimension"))


@query(f"WITH {FRAMES}, {_V8}, {_KNN}, e AS (SELECT f.stratum AS a, g.stratum AS b, count(*) AS observed FROM knn JOIN frames f ON f.frame = src JOIN frames g ON g.frame = dst GROUP BY ALL) SELECT a, b, observed, {q6('observed * sum(observed) OVER () / (sum(observed) OVER (PARTITION BY a) * sum(observed) OVER (PARTITION BY b))')} AS ratio FROM e")
def i28_cluster_links(spark, d):
    return geometry.cluster_links(_knn(spark, d), frames(spark, d), "frame", "stratum").withColumn("ratio", r6("ratio"))


@query(f"""WITH RECURSIVE {FRAMES}, {_V8}, {_KNN}, e AS (SELECT f.stratum AS a, g.stratum AS b, count(*) AS observed FROM knn JOIN frames f ON f.frame = src JOIN frames g ON g.frame = dst GROUP BY ALL), q AS (SELECT a, b, observed * sum(observed) OVER () / (sum(observed) OVER (PARTITION BY a) * sum(observed) OVER (PARTITION BY b)) AS ratio FROM e),
 l AS (SELECT DISTINCT least(a, b) AS s, greatest(a, b) AS t FROM q WHERE a <> b AND ratio > 0.5), u AS (SELECT s AS a, t AS b FROM l UNION SELECT t, s FROM l), c AS (SELECT DISTINCT a AS cluster FROM e UNION SELECT DISTINCT b FROM e), g AS (SELECT cluster, (SELECT count(*) FROM u WHERE u.a = cluster) AS degree FROM c),
 r AS (SELECT cluster AS a, cluster AS b FROM c UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a), m AS (SELECT a AS cluster, min(b) AS component FROM r GROUP BY a)
SELECT g.cluster, degree, component, count(*) OVER (PARTITION BY component) AS clusters, CAST(sum(degree) OVER (PARTITION BY component) // 2 AS BIGINT) AS links, degree >= 3 AS branch, sum(degree) OVER (PARTITION BY component) // 2 = count(*) OVER (PARTITION BY component) - 1 AS tree FROM g JOIN m USING (cluster)""")
def i28_cluster_graph(spark, d):
    """The graph of strata that are neighbours at least half as often as chance has it: degrees, components, branches, trees."""
    links = geometry.cluster_links(_knn(spark, d), frames(spark, d), "frame", "stratum")
    return geometry.cluster_graph(links, 0.5)


def _found(spark, d, k=10):
    return neighbours.approximate_nearest(frames(spark, d).select("frame", "emb"), "frame", "emb", k)


@query()
def i23_approximate(spark, d):
    """Neighbours by descent against the exact ones: recall, and how many there are."""
    return neighbours.recall(_knn(spark, d), _found(spark, d)).select(F.bround("recall", 4).alias("recall"), "entries")


@query()
def i26_approximate(spark, d):
    """Intrinsic dimensions over the neighbours that descent found."""
    found = lineage.cut(_found(spark, d))
    return geometry.two_nn(found).crossJoin(geometry.levina_bickel(found, 10)).select(*[F.bround(c, 4).alias(c) for c in ("mle", "regression", "dimension", "harmonic")])


@query()
def i29_approximate(spark, d):
    return geometry.connected(_found(spark, d, 2)).groupBy("component").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {FRAMES}, {_V8}, {_KNN}, e AS (SELECT src AS a, dst AS b FROM knn WHERE rank <= 2 UNION SELECT dst, src FROM knn WHERE rank <= 2), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT component, count(*) AS n FROM (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a) GROUP BY component""")
def i29_components(spark, d):
    return geometry.connected(_knn(spark, d, 2)).groupBy("component").agg(F.count("*").alias("n"))


@query()
def i30_codebook(spark, d):
    """Codebooks of two sizes over standardised tokens: rows and mean squared distance of each code."""
    t = vectors.to_tokens(frames(spark, d).select("frame", "emb"), "emb", 8).select("frame", "patch", "tok")
    out = None
    for k in (8, 16):
        book, mean, sd = geometry.codebook(t, "tok", k, seed=7)
        x = vectors.assign(t, "tok", book, mean=mean, sd=sd).groupBy(F.lit(k).alias("k"), "code").agg(F.count("*").alias("n"), r6(F.avg("distance")).alias("distance"))
        out = x if out is None else out.union(x)
    return out


@query()
def i31_agreement(spark, d):
    """Agreement of two labellings, and of one with the other permuted among frames."""
    f = frames(spark, d).withColumn("bin", F.least(F.greatest(F.floor(F.col("y") - 18), F.lit(0)), F.lit(9)))
    p = resample.permuted(f.select("frame", "stratum", "bin"), "frame", "bin", 1)
    out = {}
    for name, x, label in (("", f, "bin"), ("permuted_", p, "bin_perm")):
        c = geometry.contingency(x, "stratum", label)
        out |= {f"{name}adjusted_information": geometry.adjusted_information(c), f"{name}matched_share": sum(c[i, j] for i, j in geometry.best_match(c)) / c.sum()}
    return _result(spark, out)


@query(f"""WITH {FRAMES}, c AS (SELECT stratum AS a, least(greatest(floor(y - 18), 0), 9) AS b, count(*) AS n FROM frames GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS t FROM c), p AS (SELECT n / t AS p, sum(n) OVER (PARTITION BY a) / t AS pa, sum(n) OVER (PARTITION BY b) / t AS pb FROM c, t)
SELECT {q6('sum(p * ln(p / (pa * pb)))')} AS information, count(*) AS cells FROM p""")
def i31_information(spark, d):
    """Mutual information of two labellings."""
    f = frames(spark, d).withColumn("bin", F.least(F.greatest(F.floor(F.col("y") - 18), F.lit(0)), F.lit(9)))
    c = geometry.contingency(f, "stratum", "bin")
    return spark.createDataFrame([(float(geometry.mutual_information(c)), int((c > 0).sum()))], "information double, cells long").withColumn("information", r6("information"))


@query()
def i32_silhouette(spark, d):
    """Silhouette of a clustering and of the same with every column permuted by itself; size and mean y of each cluster."""
    f = frames(spark, d).select("frame", "y", "x1", "x2", "x3")
    n = f
    for i, c in enumerate(("x1", "x2", "x3")):
        one = resample.permuted(f.select("frame", c), "frame", c, 1, seed=i).select("frame", F.col(f"{c}_perm").alias(c))
        n = n.drop(c).join(one, "frame")
    out = {}
    for name, x in (("", f), ("null_", n)):
        x = x.withColumn("features", array_to_vector(F.array("x1", "x2", "x3")))
        p = KMeans(k=4, seed=3).fit(x).transform(x)
        out[f"{name}silhouette"] = ClusteringEvaluator().evaluate(p)
        if not name:
            for r in p.groupBy("prediction").agg(F.count("*").alias("n"), F.avg("y").alias("y")).collect():
                out |= {f"size_{r.prediction}": r.n, f"mean_y_{r.prediction}": r.y}
    return _result(spark, out)


def _code_vectors(spark, d):
    return factors.code_vectors(vectors.code_shares(sparse_codes(spark, d), "entity", "frame", "code"), "entity", "code", "share", range(16))


@query()
def i33_topic_factors(spark, d):
    """Non-negative topics of the entities' code shares, absent codes as zeros: the weight of each code in each topic, and the fit's share of squares."""
    h, explained = factors.topics(_code_vectors(spark, d), "v", 3, 60, 1e-5)
    rows = [(c, t, float(h[t, c]), float(explained)) for t in range(len(h)) for c in range(h.shape[1])]
    return spark.createDataFrame(rows, "code int, topic int, weight double, explained double").select("code", "topic", F.bround("weight", 4).alias("weight"), F.bround("explained", 4).alias("explained"))


@query()
def i33_rank_sweep(spark, d):
    """What topics explain by their number, beside the same of shares whose codes were shuffled among entities."""
    v = lineage.cut(_code_vectors(spark, d))
    rows = factors.rank_sweep(v, "entity", "v", (1, 3), rounds=20, tolerance=1e-4)
    return spark.createDataFrame(rows, "topics int, explained double, shuffled double").select("topics", F.bround("explained", 4).alias("explained"), F.bround("shuffled", 4).alias("shuffled"))


@query(f"WITH {FRAMES}, {_V8}, {_HALVES}, {_PAIRS}, x AS (SELECT list_distance(p.v, q.v) AS d1, list_distance(r.v, s.v) AS d2 FROM pr JOIN h1 p ON p.frame = a JOIN h1 q ON q.frame = b JOIN h2 r ON r.frame = a JOIN h2 s ON s.frame = b), k AS (SELECT rank() OVER (ORDER BY d1) AS a, rank() OVER (ORDER BY d2) AS b FROM x) SELECT CAST(round_even(corr(a, b), 4) AS DOUBLE) AS similarity FROM k")
def i34_representational_similarity(spark, d):
    """Rank correlation of pair distances in two spaces, the halves of the vector, over the sampled pairs."""
    p = _pairs(spark, d)
    f = frames(spark, d).withColumn("v", F.slice("emb", 1, 32)).withColumn("w", F.slice("emb", 33, 32))
    x = geometry.pair_distances(f, "frame", "v", p).withColumnRenamed("dist", "d1").join(geometry.pair_distances(f, "frame", "w", p).withColumnRenamed("dist", "d2"), ["a", "b"])
    x = windows.ranked(windows.ranked(x, "d1", "ra"), "d2", "rb")
    return x.agg(F.bround(F.corr("ra", "rb"), 4).alias("similarity"))


@query()
def i35_direction(spark, d):
    f = frames(spark, d).withColumn("z", F.col("x1") * 2 + F.col("stratum"))
    g = linear.total_gram(linear.design(f, "emb", ["y", "z"]))
    w = linear.ridge(g, 64, 1.0, False)[1:]
    cos = w[:, 0] @ w[:, 1] / np.sqrt((w[:, 0] @ w[:, 0]) * (w[:, 1] @ w[:, 1]))
    _, _, cov = linear.moments_of(g, 0)
    r2 = cov[64, :64] @ np.linalg.pinv(cov[:64, :64]) @ cov[:64, 64] / cov[64, 64]
    return _result(spark, {"angle": np.degrees(np.arccos(cos)), "r2": r2})


@query()
def i36_forward_selection(spark, d):
    """Features of the whole vector chosen inside each outer fold: how many folds chose each, the outer R2 and that of shuffled targets."""
    counts, r2, null = inference.nested_selection(_folded(spark, d).select("frame", "fold", "emb", "y"), "emb", "y", "frame", most=2, shuffles=4)
    x = spark.createDataFrame([(int(i), int(n), float(r2), float(max(null))) for i, n in counts], "feature int, folds int, r2 double, null_largest double")
    return x.select("feature", "folds", r6("r2").alias("r2"), r6("null_largest").alias("null_largest"))


@query()
def i37_forecast(spark, d):
    """Current value, or current value and slope, at each cutoff against the final value."""
    from panelforge.catalog.fixtures import visits
    from panelforge.operators.panel import at_cutoffs

    x = at_cutoffs(visits(spark, d), [10, 20], "entity", "t", "value", 3, 1).where("slope is not null").withColumn("fold", linear.hashed_fold("entity", FOLDS))
    rows = {}
    for c in (10.0, 20.0):
        at = x.where(F.col("cutoff") == c)
        rows[f"current@{c:g}"] = linear.held_out_r2(at, ["current"], "final", alpha=1.0)
        rows[f"dynamics@{c:g}"] = linear.held_out_r2(at, ["current", "slope"], "final", alpha=1.0)
    return _result(spark, rows)


@query(f"""WITH {FRAMES}, {_EQUAL}, l AS (SELECT frame, y, fold, x1 AS a, x1 + CAST(frame % 13 AS DOUBLE) / 50 AS b FROM f), s AS (SELECT g.fold, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, y) AS ca, covar_pop(b, y) AS cb FROM l JOIN (SELECT DISTINCT fold FROM l) g ON l.fold <> g.fold GROUP BY g.fold),
 p AS (SELECT y, my + (a - ma) * (n * ca / (n * va + va)) AS pa, my + (b - mb) * (n * cb / (n * vb + vb)) AS pb FROM l JOIN s USING (fold)) SELECT {q6('corr(pa, y)')} AS "without", {q6('corr(pb, y)')} AS "with", {q6('corr(pa - y, pb - y)')} AS lags FROM p""")
def i38_shifted_feature(spark, d):
    """The clock from a feature, and from the same with a covariate mixed in."""
    f = _equal(spark, d).withColumn("b", F.col("x1") + (F.col("frame") % 13).cast("double") / 50)
    one = linear.cross_validated(f, ["x1"], "y", alpha=1.0).predict(f, name="pa")
    x = linear.cross_validated(f, ["b"], "y", alpha=1.0).predict(one, name="pb")
    return x.agg(r6(F.corr("pa", "y")).alias("without"), r6(F.corr("pb", "y")).alias("with"), r6(F.corr(F.col("pa") - F.col("y"), F.col("pb") - F.col("y"))).alias("lags"))


@query()
def i38_causal_check(spark, d):
    """The clock with and without a covariate and its square, and how both lags correlate."""
    f = _folded(spark, d).withColumn("s", (F.col("frame") % 13).cast("double")).withColumn("s2", F.col("s") * F.col("s"))
    a = linear.cross_validated(f, ["x1", "x2"], "y", alpha=1.0).predict(f, name="a")
    b = linear.cross_validated(f, ["x1", "x2", "s", "s2"], "y", alpha=1.0).predict(f, name="b")
    x = a.select("frame", "y", "a").join(b.select("frame", "b"), "frame")
    return x.agg(r6(F.corr("a", "y")).alias("without"), r6(F.corr("b", "y")).alias("with"), r6(F.corr(F.col("a") - F.col("y"), F.col("b") - F.col("y"))).alias("lags"))


@query()
def i39_naming_reliability(spark, d):
    """Codes of several seeds matched to the first seed's by centroid cosine; how their effect profiles correlate, and in how many seeds by 0.5 or more."""
    f = frames(spark, d).select("frame", "y", "x1", "x2", "x3", "stratum", F.transform("emb", lambda v: v.cast("double")).alias("v")).withColumn("features", array_to_vector("v"))
    names = ["y", "x1", "x2", "x3", "stratum"]
    made = []
    for seed in (1, 2, 3):
        m = KMeans(k=6, seed=seed, maxIter=10).fit(f)
        c = np.array(m.clusterCenters())
        e = {r.prediction: [float(r[n]) for n in names] for r in m.transform(f).groupBy("prediction").agg(*[F.avg(n).alias(n) for n in names]).collect()}
        effects = np.array([e.get(i, [0.0] * len(names)) for i in range(len(c))])
        effects = (effects - effects.mean(0)) / np.maximum(effects.std(0), 1e-12)
        made.append((c / np.linalg.norm(c, axis=1, keepdims=True), effects))
    rows = []
    for seed, (c, effects) in enumerate(made[1:], 2):
        cosine = made[0][0] @ c.T
        rows += [(int(i), seed, int(j), float(cosine[i, j]), float(np.corrcoef(made[0][1][i], effects[j])[0, 1])) for i, j in geometry.best_match(cosine)]
    x = spark.createDataFrame(rows, "code int, seed int, matched int, cosine double, profile_r double")
    good = x.groupBy("code").agg(F.count_if(F.col("profile_r") >= 0.5).alias("seeds_reliable"))
    return x.join(good, "code").select("code", "seed", "matched", r6("cosine").alias("cosine"), r6("profile_r").alias("profile_r"), "seeds_reliable")


@query()
def i40_noise_prediction(spark, d):
    """Does a representation predict an entity's noise level, adjusted for time and a second covariate? With permutation p and the direction's angle to that of time."""
    from panelforge.catalog.fixtures import visits

    dev = windows.left_out_deviation(visits(spark, d).where("measure = 'view'"), "entity", "t", "value").groupBy("entity").agg(F.log1p(F.sqrt(F.avg(F.col("deviation") * F.col("deviation")))).alias("noise"), F.avg("t").alias("time"), F.count("*").cast("double").alias("n"))
    m = vectors.mean_by(frames(spark, d), ["entity"], "emb").select("entity", "mean")
    out = inference.noise_test(dev.join(m, "entity"), "entity", "mean", "noise", ["time", "n"], 40, axes=5)
    return _result(spark, out)

@query(f"WITH {FRAMES}, l AS (SELECT frame, unnest(emb)::DOUBLE AS v, unnest(range(64)) AS k FROM frames) SELECT CAST(a.k AS INTEGER) AS a, CAST(b.k AS INTEGER) AS b, {q6('covar_samp(a.v, b.v)')} AS cov FROM l a JOIN l b USING (frame) WHERE a.k <= b.k GROUP BY a.k, b.k")
def i13_covariance(spark, d):
    """The matrix that components, canonical correlations, spectra and labels start from."""
    _, cov = linear.covariance(frames(spark, d), "emb")
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(rows, "a int, b int, cov double").select("a", "b", r6("cov").alias("cov"))


@query(f"""WITH {WIDE}, w AS (SELECT entity, visit, t, click, lead(visit) OVER o AS v2, lead(t) OVER o AS t2, lead(click) OVER o AS y2 FROM wide WINDOW o AS (PARTITION BY entity ORDER BY visit)), x AS (SELECT visit, click AS p, (y2 - click) / (t2 - t) AS v FROM w WHERE v2 = visit + 1 AND t2 > t AND y2 IS NOT NULL AND click IS NOT NULL),
 g AS (SELECT visit, count(*) + 1.0::DOUBLE AS n, sum(p) AS sp, sum(p * p) + 1 AS spp, sum(v) AS sv, sum(p * v) AS spv, count(*) AS rows FROM x GROUP BY visit), b AS (SELECT visit, rows, (n * spv - sp * sv) / (n * spp - sp * sp) AS slope, (spp * sv - sp * spv) / (n * spp - sp * sp) AS start FROM g)
SELECT visit, {q6('slope')} AS slope, CAST(round_even(-start / slope, 3) AS DOUBLE) + 0.0 AS fixed, rows AS n FROM b""")
def i14_single_measure(spark, d):
    """The flow of one measure: slope of velocity on position, and where it stands still."""
    w = wide(spark, d)
    v = windows.velocity(w, "entity", "visit", "t", "click").drop("mid_time")
    rows = []
    for k, g in linear.grams(linear.design(w.join(v, ["entity", "visit"]), ["click"], ["velocity"], keep=["visit"]), "visit").items():
        trace, _, fixed, _ = linear.flow(g, 1)
        rows.append((int(k), trace, fixed[0], int(round(g[0, 0]))))
    x = spark.createDataFrame(rows, "visit int, slope double, fixed double, n long")
    return x.select("visit", r6("slope").alias("slope"), (F.bround("fixed", 3) + 0.0).alias("fixed"), "n")


_CORR3 = "c AS (SELECT corr(y, x1) AS a, corr(y, x2) AS b, corr(x1, x2) AS c, corr(y, stratum) AS ys, corr(x1, stratum) AS xs FROM frames)"


@query(f"WITH {FRAMES}, {_CORR3} SELECT {q6('sqrt((a * a + b * b - 2 * a * b * c) / (1 - c * c))')} AS r FROM c")
def i15_one_against_two(spark, d):
    """The canonical correlation of y with two features: their multiple correlation."""
    _, cov = linear.covariance(frames(spark, d), ["y", "x1", "x2"])
    return spark.createDataFrame([(float(linear.canonical(cov, 1, ridge_=1e-13)[0][0]),)], "r double").select(r6("r").alias("r"))


@query(f"WITH {FRAMES}, {_CORR3} SELECT unnest(['raw', 'size', 'block']) AS metric, unnest([{q6('abs(a)')}, {q6('abs(a - b * c) / sqrt((1 - b * b) * (1 - c * c))')}, {q6('abs(a - ys * xs) / sqrt((1 - ys * ys) * (1 - xs * xs))')}]) AS value FROM c")
def i16_pair_ladder(spark, d):
    """One feature and the target: the rungs are partial correlations."""
    _, cov = linear.covariance(frames(spark, d), ["x1", "y", "x2", "stratum"])
    return _result(spark, linear.ladder(cov, [0], [1], {"raw": [], "size": [2], "block": [3]}))


@query(f"WITH {FRAMES}, {_CORR3}, d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c) SELECT {q6('-0.5 * ln(det)')} AS total, {q6('0.5 * (ln(1 - a * a) + ln(1 - b * b) + ln(1 - c * c) - 2 * ln(det))')} AS dual FROM d")
def i19_triple(spark, d):
    _, cov = linear.covariance(frames(spark, d), ["y", "x1", "x2"])
    tc, dtc, _, _ = linear.o_information(cov)
    return spark.createDataFrame([(float(tc), float(dtc))], "total double, dual double").select(r6("total").alias("total"), r6("dual").alias("dual"))


@query(f"WITH {WIDE}, p AS (SELECT (click IS NOT NULL)::INT::VARCHAR || (error IS NOT NULL)::INT::VARCHAR || (view IS NOT NULL)::INT::VARCHAR AS pattern, click, error, view FROM wide) SELECT pattern, count(*) AS n, {q6('coalesce(sum(click), 0) + coalesce(sum(error), 0) + coalesce(sum(view), 0)')} AS total FROM p WHERE pattern <> '000' GROUP BY pattern")
def i20_patterns(spark, d):
    """The sums by pattern of missing cells that the factor model starts from."""
    parts = linear.pattern_sums(wide(spark, d).select(F.array("click", "error", "view").alias("v")), "v")
    rows = [(k, int(round(g[0, 0])), float(g[0, 1:].sum())) for k, g in parts.items()]
    return spark.createDataFrame(rows, "pattern string, n long, total double").select("pattern", "n", r6("total").alias("total"))


@query(f"WITH {FRAMES}, l AS (SELECT frame, unnest(emb)::DOUBLE AS v, unnest(range(64)) AS k FROM frames), c AS (SELECT a.k AS a, b.k AS b, covar_samp(a.v, b.v) AS c FROM l a JOIN l b USING (frame) GROUP BY ALL) SELECT CAST(round_even(pow(sum(c) FILTER (a = b), 2) / sum(c * c), 4) AS DOUBLE) AS participation FROM c")
def i21_participation(spark, d):
    """(sum of eigenvalues)^2 / sum of their squares."""
    values = np.linalg.eigvalsh(linear.covariance(frames(spark, d), "emb")[1])
    return spark.createDataFrame([(linear.participation(values),)], "participation double").select(F.bround("participation", 4).alias("participation"))


@query(f"""WITH {FRAMES}, d AS (SELECT a.frame, a.stratum AS own, b.stratum AS other, sum(pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2) + pow(a.x3 - b.x3, 2)) AS s, count(*) AS n FROM frames a, frames b GROUP BY ALL), m AS (SELECT frame, max(CASE WHEN n > 1 THEN s / (n - 1) END) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b FROM d GROUP BY frame)
SELECT CAST(round_even(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS DOUBLE) + 0.0 AS silhouette FROM m""")
def i32_silhouette_of_strata(spark, d):
    f = frames(spark, d).select(F.col("stratum").cast("double").alias("prediction"), array_to_vector(F.array("x1", "x2", "x3")).alias("features"))
    return spark.createDataFrame([(float(ClusteringEvaluator().evaluate(f)),)], "s double").select((F.bround("s", 4) + 0.0).alias("silhouette"))


@query(f"""WITH {FRAMES}, z AS (SELECT x1, x2, y, x1 * 2 + stratum AS z FROM frames), m AS (SELECT count(*) * var_pop(x1) + 1 AS a, count(*) * covar_pop(x1, x2) AS b, count(*) * var_pop(x2) + 1 AS c, count(*) * covar_pop(x1, y) AS y1, count(*) * covar_pop(x2, y) AS y2, count(*) * covar_pop(x1, z) AS z1, count(*) * covar_pop(x2, z) AS z2 FROM z),
 w AS (SELECT c * y1 - b * y2 AS p, a * y2 - b * y1 AS q, c * z1 - b * z2 AS r, a * z2 - b * z1 AS s FROM m) SELECT CAST(round_even(degrees(acos((p * r + q * s) / sqrt((p * p + q * q) * (r * r + s * s)))), 4) AS DOUBLE) + 0.0 AS angle FROM w""")
def i35_plane_direction(spark, d):
    """The angle between the directions of two scalars in a plane."""
    f = frames(spark, d).withColumn("z", F.col("x1") * 2 + F.col("stratum"))
    w = linear.ridge(linear.total_gram(linear.design(f, ["x1", "x2"], ["y", "z"])), 2, 1.0, False)[1:]
    cos = w[:, 0] @ w[:, 1] / np.sqrt((w[:, 0] @ w[:, 0]) * (w[:, 1] @ w[:, 1]))
    return spark.createDataFrame([(float(np.degrees(np.arccos(cos))),)], "a double").select((F.bround("a", 4) + 0.0).alias("angle"))


@query(f"""WITH {VISITS}, v AS (SELECT entity, unnest([10.0, 20.0])::DOUBLE AS k, t, value FROM visits WHERE value IS NOT NULL), c AS (SELECT entity, k, max_by(value, t) FILTER (t <= k) AS x, max_by(value, t) AS y FROM v GROUP BY ALL HAVING count_if(t <= k) >= 3 AND count_if(t > k) >= 1), f AS (SELECT *, entity * 7919 % 10007 % 5 AS fold FROM c), {_RIDGE1.format(k='k', t='f')}
SELECT f.k AS cutoff, {q6('1 - sum(pow(y - my - (x - mx) * (n * c / (n * vx + vx)), 2)) / (var_pop(y) * count(*))')} AS r2 FROM f JOIN s ON f.k = s.k AND f.fold = s.fold GROUP BY f.k""")
def i37_current_value(spark, d):
    """The value at a cutoff as a forecast of the final one, out of fold."""
    from panelforge.catalog.fixtures import visits
    from panelforge.operators.panel import at_cutoffs

    x = at_cutoffs(visits(spark, d), [10, 20], "entity", "t", "value", 3, 1).withColumn("fold", (F.col("entity") * 7919 % 10007 % 5).cast("int"))
    return inference.clocks(x, ["cutoff"], ["current"], "final", alpha=1.0, least=1).select("cutoff", r6("r2").alias("r2"))


@query(f"""WITH {FRAMES}, {_EQUAL}, k AS (SELECT 0 AS k, frame, entity, x1 AS x, y, fold FROM f), {_RIDGE1.format(k='k', t='k')} SELECT entity, {q6('avg(my + (x - mx) * (n * c / (n * vx + vx)) - y)')} AS lag, count(*) AS n FROM k JOIN s USING (fold) GROUP BY entity""")
def i08_single_feature_lag(spark, d):
    f = _equal(spark, d)
    p = linear.cross_validated(f, ["x1"], "y", alpha=1.0).predict(f.select("entity", "x1", "y", "fold"))
    return p.groupBy("entity").agg(r6(F.avg(F.col("pred") - F.col("y"))).alias("lag"), F.count("*").alias("n"))
