"""E: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.fixtures import CELLS, CODES, ENTITY_LAG, FRAMES, MEASURES, OUTCOMES, SHOTS, VISITS, WIDE, cells, codes, entity_lag, frames, outcomes, shots, visits, wide
from panelforge.operators import aggregate, inference, vectors, windows
from panelforge.registry import q6, query, r6

_DIMS = (0, 31, 63)


def _dims(name: str) -> list:
    return [r6(F.col(name)[i]).alias(f"m{i}") for i in _DIMS]


@query(f"WITH {FRAMES} SELECT entity, count(*) AS n, " + ", ".join(f"{q6(f'avg(CAST(emb[{i + 1}] AS DOUBLE))')} AS m{i}" for i in _DIMS) + " FROM frames GROUP BY entity")
def e01_mean_pool(spark, d):
    return vectors.mean_by(frames(spark, d), ["entity"], "emb").select("entity", "n", *_dims("mean"))


_W = "w AS (SELECT *, CASE WHEN frame % 5 = 0 THEN NULL WHEN frame % 97 < 3 THEN 0.0 ELSE (frame % 7) / CAST(7 AS DOUBLE) END AS w0 FROM frames), w2 AS (SELECT *, coalesce(w0, median(w0) OVER (PARTITION BY stratum)) AS wt FROM w)"


@query(f"WITH {FRAMES}, {_W} SELECT entity, stratum, " + ", ".join(q6(f"CASE WHEN sum(wt) > 0 THEN sum(wt * emb[{i + 1}]) / sum(wt) ELSE avg(CAST(emb[{i + 1}] AS DOUBLE)) END") + f" AS m{i}" for i in _DIMS) + " FROM w2 GROUP BY ALL")
def e02_weighted_pool(spark, d):
    k = F.col("frame")
    f = frames(spark, d).withColumn("w0", F.when(k % 5 == 0, None).when(k % 97 < 3, 0.0).otherwise((k % 7) / 7.0))
    fill = f.groupBy("stratum").agg(F.percentile("w0", F.lit(0.5)).alias("m"))
    f = f.join(fill, "stratum").withColumn("wt", F.coalesce("w0", "m"))
    return vectors.mean_by(f, ["entity", "stratum"], "emb", weight="wt").select("entity", "stratum", *_dims("mean"))


@query(f"WITH {SHOTS} SELECT entity, {q6('avg(lag)')} AS lag, count(*) AS n, {q6('quantile_cont(date_diff(' + chr(39) + 'day' + chr(39) + ', DATE ' + chr(39) + '1990-01-01' + chr(39) + ', study), 0.5)')} AS median_day FROM shots GROUP BY entity")
def e03_entity_lag(spark, d):
    day = F.date_diff("study", F.lit("1990-01-01").cast("date"))
    return shots(spark, d).groupBy("entity").agg(r6(F.avg("lag")).alias("lag"), F.count("*").alias("n"), r6(F.percentile(day, F.lit(0.5))).alias("median_day"))


@query(f"""WITH {SHOTS}, x AS (SELECT entity, lag, count(*) OVER (PARTITION BY entity) AS n, row_number() OVER (PARTITION BY entity ORDER BY lag) AS r FROM shots), t AS (SELECT entity, avg(lag) AS trimmed FROM x WHERE n < 3 OR (r > floor(n * 0.2) AND r <= n - floor(n * 0.2)) GROUP BY entity)
SELECT entity, {q6('avg(lag)')} AS mean, {q6('quantile_cont(lag, 0.5)')} AS median, {q6('any_value(trimmed)')} AS trimmed FROM shots JOIN t USING (entity) GROUP BY entity""")
def e04_aggregator_choice(spark, d):
    s = shots(spark, d)
    t = aggregate.trimmed_mean(s, "entity", "lag")
    m = s.groupBy("entity").agg(r6(F.avg("lag")).alias("mean"), r6(F.percentile("lag", F.lit(0.5))).alias("median"))
    return m.join(t, "entity").select("entity", "mean", "median", r6("trimmed").alias("trimmed"))


@query(f"WITH {SHOTS} SELECT entity, {q6('sum(lag / v) / sum(1 / v)')} AS mean, count(*) AS n FROM (SELECT entity, lag, (part % 5) * CAST(0.5 AS DOUBLE) AS v FROM shots) WHERE v > 0 GROUP BY entity")
def e05_inverse_variance(spark, d):
    return aggregate.inverse_variance_mean(shots(spark, d).withColumn("v", (F.col("part") % 5) * 0.5), "entity", "lag", "v").withColumn("mean", r6("mean"))


@query(f"WITH {SHOTS} SELECT entity, {q6('CASE WHEN sum(w) > 0 THEN sum(w * lag) / sum(w) ELSE avg(lag) END')} AS mean FROM (SELECT *, CASE WHEN stratum = 'A' THEN CAST(1 AS DOUBLE) ELSE 0 END AS w FROM shots) GROUP BY entity")
def e06_stratum_weighted(spark, d):
    return aggregate.weighted_mean(shots(spark, d), "entity", "lag", F.when(F.col("stratum") == "A", 1.0).otherwise(0.0)).withColumn("mean", r6("mean"))


@query(f"WITH {VISITS} SELECT entity, measure, {q6('CASE WHEN count(*) >= 2 AND stddev_samp(t) > 0 THEN regr_slope(value, t) END')} AS slope, count(*) AS points FROM visits WHERE value IS NOT NULL GROUP BY ALL")
def e07_growth_slope(spark, d):
    return aggregate.slopes(visits(spark, d), ["entity", "measure"], "t", "value").select("entity", "measure", r6("slope").alias("slope"), "points")


@query(f"WITH {WIDE} SELECT entity, {q6('max(view) FILTER (visit = 0) - max(view) FILTER (visit = 3)')} AS change FROM wide GROUP BY entity")
def e08_early_minus_late(spark, d):
    w = wide(spark, d)
    return w.groupBy("entity").agg(r6(F.max(F.when(F.col("visit") == 0, F.col("view"))) - F.max(F.when(F.col("visit") == 3, F.col("view")))).alias("change"))


@query(f"WITH {VISITS} SELECT entity, measure, {q6('regr_slope(value, t)')} AS slope, {q6('avg(value)')} AS mean, count(*) AS points FROM visits WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 3 AND stddev_samp(t) > 1")
def e09_guarded_slope(spark, d):
    s = aggregate.slopes(visits(spark, d), ["entity", "measure"], "t", "value", 3).where("points >= 3 and time_sd > 1")
    return s.select("entity", "measure", r6("slope").alias("slope"), r6("mean").alias("mean"), "points")


@query(f"WITH {FRAMES}, l AS (SELECT entity, frame AS t, unnest([x1, x2, x3]) AS v, unnest([1, 2, 3]) AS dim FROM frames) SELECT entity, dim, {q6('regr_slope(v, t)')} AS slope, {q6('max_by(v, t) - min_by(v, t)')} AS change, {q6('max(v) - min(v)')} AS span, {q6('max_by(v, t)')} AS late FROM l GROUP BY ALL")
def e10_trajectory_features(spark, d):
    x = frames(spark, d).select("entity", F.col("frame").alias("t"), F.posexplode(F.array("x1", "x2", "x3")).alias("dim", "v")).withColumn("dim", F.col("dim") + 1)
    return x.groupBy("entity", "dim").agg(r6(F.regr_slope("v", "t")).alias("slope"), r6(F.max_by("v", "t") - F.min_by("v", "t")).alias("change"), r6(F.max("v") - F.min("v")).alias("span"), r6(F.max_by("v", "t")).alias("late"))


@query(f"WITH {FRAMES}, g AS (SELECT entity, covar_pop(y, x1) AS ta, covar_pop(y, x2) AS tb, covar_pop(x1, x2) AS ab, var_pop(x2) AS bb, var_pop(y) AS tt, count(*) AS n FROM frames GROUP BY entity) SELECT entity, {q6('(ta - ab / bb * tb) / tt')} AS slope FROM g WHERE n >= 3 AND bb > 1e-12 AND tt > 1e-12")
def e11_orthogonal_slope(spark, d):
    return aggregate.residual_slope(frames(spark, d), "entity", "y", "x1", "x2").withColumn("slope", r6("slope"))


_COV3 = {f"{x}{y}": f"covar_samp({p}, {q})" for x, p in zip("abc", ("click", "view", "error")) for y, q in zip("abc", ("click", "view", "error"))}
_DET3 = "{aa} * ({bb} * {cc} - {bc} * {bc}) - {ab} * ({ab} * {cc} - {bc} * {ac}) + {ac} * ({ab} * {bc} - {bb} * {ac})".format(**_COV3)


@query(f"WITH {WIDE} SELECT visit, count(*) AS n, {q6('{aa} + {bb} + {cc}'.format(**_COV3))} AS trace, CAST(round_even(({_DET3}) / 1e6, 3) AS DOUBLE) + 0.0 AS det, {q6('quantile_cont(t, 0.5)')} AS t FROM wide WHERE click IS NOT NULL AND view IS NOT NULL AND error IS NOT NULL GROUP BY visit HAVING count(*) >= 5")
def e12_population_spread(spark, d):
    g = inference.generalised_variance(wide(spark, d), "visit", ["click", "view", "error"], "t")
    return g.select("visit", "n", r6("trace").alias("trace"), (F.bround(F.col("det") / 1e6, 3) + 0.0).alias("det"), r6("t").alias("t"))


@query(f"WITH {SHOTS} SELECT source, count(*) AS n, count(DISTINCT entity) AS entities, count(DISTINCT dataset) AS datasets FROM shots GROUP BY source")
def e13_value_counts(spark, d):
    return shots(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.count_distinct("dataset").alias("datasets"))


@query(f"WITH {SHOTS} SELECT entity, source FROM (SELECT entity, source, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, source) AS r FROM shots GROUP BY entity, source) WHERE r = 1")
def e14_entity_mode(spark, d):
    c = shots(spark, d).groupBy("entity", "source").agg(F.count("*").alias("n"))
    return c.groupBy("entity").agg(F.max_by("source", F.struct("n", -F.col("source"))).alias("source"))


@query(f"""WITH {SHOTS}, {OUTCOMES}, g AS (SELECT dataset, entity, avg(lag) AS lag FROM shots GROUP BY GROUPING SETS ((dataset, entity), (entity)))
SELECT coalesce(dataset, 'both') AS dataset, grp, count(*) AS n, {q6('avg(lag)')} AS lag FROM g JOIN outcomes USING (entity) GROUP BY ALL""")
def e15_grouping_sets(spark, d):
    g = shots(spark, d).groupingSets([["dataset", "entity"], ["entity"]], "dataset", "entity").agg(F.avg("lag").alias("lag"))
    return g.join(outcomes(spark, d), "entity").groupBy(F.coalesce("dataset", F.lit("both")).alias("dataset"), "grp").agg(F.count("*").alias("n"), r6(F.avg("lag")).alias("lag"))


@query(f"""WITH {SHOTS}, m AS (SELECT dataset, date_trunc('month', study) AS month, avg(lag) AS lag, count(*) AS n FROM shots GROUP BY ALL HAVING count(*) >= 20)
SELECT dataset, count(*) AS months, {q6("regr_slope(lag, date_diff('day', DATE '1990-01-01', CAST(month AS DATE)) / 365.25)")} AS yearly FROM m GROUP BY dataset""")
def e16_monthly_drift(spark, d):
    m = shots(spark, d).groupBy("dataset", F.trunc("study", "month").alias("month")).agg(F.avg("lag").alias("lag"), F.count("*").alias("n")).where("n >= 20")
    years = F.date_diff("month", F.lit("1990-01-01").cast("date")) / 365.25
    return m.groupBy("dataset").agg(F.count("*").alias("months"), r6(F.regr_slope("lag", years)).alias("yearly"))


@query(f"WITH {SHOTS} SELECT source, count_if(stratum = 'A') AS a, count_if(stratum = 'N') AS n, count_if(stratum = 'R') AS r FROM shots GROUP BY source")
def e17_crosstab(spark, d):
    return shots(spark, d).groupBy("source").agg(*[F.count_if(F.col("stratum") == s).alias(s.lower()) for s in "ANR"])


_ETA = "SELECT count(*) AS n, avg({v}) AS m, var_pop({v}) AS v FROM {t} WHERE {v} IS NOT NULL GROUP BY {g}"


@query(f"WITH {SHOTS}, g AS ({_ETA.format(v='lag', t='shots', g='source')}), t AS (SELECT sum(n * m) / sum(n) AS gg FROM g) SELECT {q6('sum(n * pow(m - gg, 2)) / (sum(n * pow(m - gg, 2)) + sum(n * v))')} AS eta2, CAST(sum(n) AS BIGINT) AS n FROM g, t")
def e18_eta_squared(spark, d):
    return aggregate.eta_squared(shots(spark, d), "source", "lag").withColumn("eta2", r6("eta2"))


_ICC = """g AS (SELECT count(*) AS n, avg({v}) AS m, var_pop({v}) AS v FROM {t} WHERE {v} IS NOT NULL GROUP BY entity HAVING count(*) >= 2), s AS (SELECT count(*) AS a, sum(n) AS nn, sum(n * n) AS n2, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum(n * v) AS ssw FROM g),
 k AS (SELECT a, nn, (nn - n2 / nn::DOUBLE) / (a - 1) AS k0, (nmm - nm * nm / nn) / (a - 1) AS msb, ssw / (nn - a) AS msw FROM s), r AS (SELECT a, nn, k0, (msb - msw) / (msb + (k0 - 1) * msw) AS icc FROM k)
SELECT a, CAST(nn AS BIGINT) AS "N", """ + ", ".join(q6(f"{e}") + f" AS {n}" for e, n in (("k0", "k0"), ("icc", "icc"), ("icc", "rel_1"), ("2 * icc / (1 + icc)", "rel_2"), ("4 * icc / (1 + 3 * icc)", "rel_4"))) + " FROM r"


def _icc(x):
    return x.select("a", "N", *[r6(c).alias(c) for c in ("k0", "icc", "rel_1", "rel_2", "rel_4")])


@query(f"WITH {FRAMES}, {_ICC.format(v='y', t='frames')}")
def e19_icc(spark, d):
    return _icc(aggregate.icc(frames(spark, d), "entity", "y"))


@query(f"WITH {FRAMES}, z AS (SELECT entity, (y - avg(y) OVER (PARTITION BY stratum)) / stddev_samp(y) OVER (PARTITION BY stratum) AS y FROM frames), {_ICC.format(v='y', t='z')}")
def e20_adjusted_icc(spark, d):
    z = windows.stratum_z(frames(spark, d), "stratum", "y", 1, 0.0, 1)
    return _icc(aggregate.icc(z, "entity", "z"))


@query(f"WITH {FRAMES}, h AS (SELECT entity, avg(y) FILTER (frame // 97 % 2 = 0) AS a, avg(y) FILTER (frame // 97 % 2 = 1) AS b, count(*) AS n FROM frames GROUP BY entity) SELECT {q6('corr(a, b)')} AS r, {q6('2 * corr(a, b) / (1 + corr(a, b))')} AS reliability, count(*) AS n FROM h WHERE n >= 4 AND a IS NOT NULL AND b IS NOT NULL")
def e21_split_half(spark, d):
    odd = F.floor(F.col("frame") / 97) % 2
    h = frames(spark, d).groupBy("entity").agg(F.avg(F.when(odd == 0, F.col("y"))).alias("a"), F.avg(F.when(odd == 1, F.col("y"))).alias("b"), F.count("*").alias("n")).where("n >= 4 and a is not null and b is not null")
    r = F.corr("a", "b")
    return h.agg(r6(r).alias("r"), r6(2 * r / (1 + r)).alias("reliability"), F.count("*").alias("n"))


@query(f"""WITH {ENTITY_LAG}, s AS (SELECT unnest([-5.0, -1.0, 0.0, 1.0, 5.0])::DOUBLE AS threshold) SELECT threshold, count_if(grp = 'SGA' AND lag <= threshold) AS tp, count_if(grp <> 'SGA' AND lag <= threshold) AS fp, count_if(grp = 'SGA' AND lag > threshold) AS fn, count_if(grp <> 'SGA' AND lag > threshold) AS tn,
 {q6("max(lag) FILTER (grp = 'SGA' AND lag <= threshold)")} AS edge FROM entity_lag, s GROUP BY threshold""")
def e22_threshold_sweep(spark, d):
    e = entity_lag(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, (-5.0, -1.0, 0.0, 1.0, 5.0)))))
    sga, low = F.col("grp") == "SGA", F.col("lag") <= F.col("threshold")
    return e.groupBy("threshold").agg(F.count_if(sga & low).alias("tp"), F.count_if(~sga & low).alias("fp"), F.count_if(sga & ~low).alias("fn"), F.count_if(~sga & ~low).alias("tn"), r6(F.max(F.when(sga & low, F.col("lag")))).alias("edge"))


@query(f"WITH {ENTITY_LAG} SELECT grp, count(*) AS n, {q6('avg(lag)')} AS lag, {q6('avg(weeks)')} AS weeks FROM entity_lag GROUP BY grp")
def e23_outcome_gradient(spark, d):
    return entity_lag(spark, d).groupBy("grp").agg(F.count("*").alias("n"), r6(F.avg("lag")).alias("lag"), r6(F.avg("weeks")).alias("weeks"))


@query(f"""WITH {VISITS}, p AS (SELECT measure, count(*) AS n, avg(value) AS m FROM visits WHERE value IS NOT NULL GROUP BY measure), q AS (SELECT v.measure, any_value(n) AS n, avg(pow(value - m, 2)) AS m2, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4 FROM visits v JOIN p USING (measure) WHERE value IS NOT NULL GROUP BY v.measure)
SELECT measure, n, {q6('(m3 * m3 / pow(m2, 3) + 1) / (m4 / (m2 * m2) - 3 + 3 * pow(n - 1, 2) / ((n - 2) * (n - 3)))')} AS bimodality FROM q WHERE n >= 8""")
def e24_bimodality(spark, d):
    return aggregate.bimodality(visits(spark, d), ["measure"], "value").withColumn("bimodality", r6("bimodality"))


@query(f"WITH {WIDE}, l AS (SELECT 'click' AS col, click AS v, t FROM wide UNION ALL SELECT 'view', view, t FROM wide UNION ALL SELECT 'error', error, t FROM wide) SELECT col, count(v) AS n, {q6('corr(v, t)')} AS r FROM l GROUP BY col HAVING count(v) > 10")
def e25_time_leakage(spark, d):
    x = wide(spark, d).unpivot(["t"], ["click", "view", "error"], "col", "v")
    return x.groupBy("col").agg(F.count("v").alias("n"), r6(F.corr("v", "t")).alias("r")).where("n > 10")


@query(f"""WITH {WIDE}, l AS (SELECT entity, visit, unnest({MEASURES}) AS m, unnest([{', '.join(MEASURES)}]) AS v FROM wide), k AS (SELECT m, avg(v) AS a, stddev_pop(v) AS s FROM l GROUP BY m), z AS (SELECT entity, visit, m, (v - a) / s AS z FROM l JOIN k USING (m) WHERE v IS NOT NULL)
SELECT x.m AS a, y.m AS b, count(*) AS n, {q6('CASE WHEN count(*) > 2 THEN avg(x.z * y.z) END')} AS cov FROM z x JOIN z y USING (entity, visit) WHERE x.m <= y.m GROUP BY ALL""")
def e26_pairwise_covariance(spark, d):
    return inference.pairwise_covariance(wide(spark, d), MEASURES).select("a", "b", "n", r6("cov").alias("cov"))


#: Codes as they come, and with every third (entity, code) pair absent.
SPARSE = CODES + ", sparse AS (SELECT * FROM codes WHERE (entity * 7 + code) % 3 > 0)"


def _shares(rows: str) -> str:
    """Shares of all codes by entity, zeros included: entities times codes."""
    return f"""n AS (SELECT entity, frame, count(*) AS p FROM {rows} GROUP BY ALL), g AS (SELECT entity, count(*) AS f FROM n GROUP BY entity), h AS (SELECT entity, frame, code, count(*) AS c FROM {rows} GROUP BY ALL),
 u AS (SELECT h.entity, code, sum(c / p::DOUBLE) AS s FROM h JOIN n USING (entity, frame) GROUP BY h.entity, code), grid AS (SELECT entity, f, code FROM g, (SELECT DISTINCT code FROM {rows})),
 shares AS (SELECT grid.entity, grid.code, coalesce(s, 0) / f AS share FROM grid LEFT JOIN u ON u.entity = grid.entity AND u.code = grid.code)"""


def sparse_codes(spark, d):
    return codes(spark, d).where((F.col("entity") * 7 + F.col("code")) % 3 > 0)


@query(f"WITH {CODES}, {_shares('codes')} SELECT entity, code, {q6('share')} AS share FROM shares")
def e27_code_histogram(spark, d):
    return vectors.code_shares(codes(spark, d), "entity", "frame", "code").select("entity", "code", r6("share").alias("share"))


@query(f"WITH {SPARSE}, {_shares('sparse')}, p AS (SELECT *, ln(greatest(share / sum(share) OVER (PARTITION BY entity), 1e-6)) AS l FROM shares) SELECT entity, code, {q6('share')} AS share, {q6('l - avg(l) OVER (PARTITION BY entity)')} AS clr FROM p")
def e27_absent_codes(spark, d):
    """Codes that an entity lacks: share 0, and a log-ratio against the floor."""
    x = windows.clr(vectors.code_shares(sparse_codes(spark, d), "entity", "frame", "code"), "entity", "share")
    return x.select("entity", "code", r6("share").alias("share"), r6("clr").alias("clr"))


@query(f"WITH {CODES}, c AS (SELECT code, patch, count(*) AS n FROM codes GROUP BY ALL), t AS (SELECT code, sum(n) AS t, sum(n * patch) AS s FROM c GROUP BY code) SELECT c.code, CAST(any_value(t) AS BIGINT) AS n, CAST(any_value(s) AS BIGINT) AS patch_sum, {q6('1 + sum(n / t::DOUBLE * ln(n / t::DOUBLE)) / ln(7)')} AS concentration FROM c JOIN t USING (code) WHERE t >= 20 GROUP BY c.code")
def e28_code_position(spark, d):
    return aggregate.code_position(codes(spark, d), "code", "patch", 7, 20).withColumn("concentration", r6("concentration"))


@query(f"WITH {FRAMES}, l AS (SELECT frame, i AS k, abs(CAST(emb[i + 1] AS DOUBLE)) AS a FROM frames, range(64) r(i)), c AS (SELECT frame, sum(a * k) / sum(a) AS centre, sum(a) AS mass, quantile_cont(a, 0.75) AS q FROM l GROUP BY frame) SELECT l.frame, {q6('any_value(centre)')} AS centre, {q6('sqrt(sum(a * pow(k - centre, 2)) / any_value(mass))')} AS dispersion, count_if(a >= q) AS top FROM l JOIN c USING (frame) GROUP BY l.frame")
def e29_activation_centroid(spark, d):
    return aggregate.activation(frames(spark, d), "frame", "emb").select("frame", r6("centre").alias("centre"), r6("dispersion").alias("dispersion"), "top")


@query(f"WITH {FRAMES}, l AS (SELECT frame, i AS k, abs(CAST(emb[i + 1] AS DOUBLE)) AS a FROM frames, range(64) r(i)), c AS (SELECT frame, quantile_cont(a, 0.75) AS q FROM l GROUP BY frame) SELECT CAST(k AS INTEGER) AS place, count(*) AS rows, count_if(a >= q) AS top FROM l JOIN c USING (frame) GROUP BY k")
def e29_position_histogram(spark, d):
    return aggregate.position_histogram(frames(spark, d), "frame", "emb")


@query(f"WITH {CELLS}, m AS (SELECT entity, visit, avg(value) AS m FROM cells GROUP BY ALL), s AS (SELECT var_pop(m) AS s FROM m), t AS (SELECT var_pop(value) AS t, count(DISTINCT measure) AS e FROM cells) SELECT {q6('s / t')} AS shared, {q6('1.0 / e')} AS floor FROM s, t")
def e30_shared_variance(spark, d):
    x = aggregate.shared_variance(cells(spark, d), ["entity", "visit"], "measure", "value")
    return x.select(r6("shared").alias("shared"), r6("floor").alias("floor"))


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"WITH {ENTITY_LAG}, r AS (SELECT grp = 'SGA' AS y, {_RANK.format('lag')} AS r FROM entity_lag) SELECT {q6('(sum(r) FILTER (y) - count_if(y) * (count_if(y) + 1) / 2.0) / (count_if(y) * count_if(NOT y))')} AS auc, count_if(y) AS n1, count_if(NOT y) AS n0 FROM r")
def e31_rank_auc(spark, d):
    x = entity_lag(spark, d).withColumn("y", (F.col("grp") == "SGA").cast("int"))
    return aggregate.auc(x, "y", "lag").select(r6("auc").alias("auc"), "n1", "n0")


@query(f"WITH {ENTITY_LAG}, r AS (SELECT *, {_RANK.format('lag')} AS ra, {_RANK.format('size')} AS rb FROM entity_lag) SELECT {q6('corr(lag, size)')} AS pearson, {q6('corr(ra, rb)')} AS spearman, {q6(chr(99) + 'orr(lag, (grp = ' + chr(39) + 'SGA' + chr(39) + ')::INT)')} AS biserial FROM r")
def e32_correlations(spark, d):
    x = windows.ranked(windows.ranked(entity_lag(spark, d), "lag", "ra"), "size", "rb")
    return x.agg(r6(F.corr("lag", "size")).alias("pearson"), r6(F.corr("ra", "rb")).alias("spearman"), r6(F.corr("lag", (F.col("grp") == "SGA").cast("int"))).alias("biserial"))


@query(f"WITH {ENTITY_LAG}, r AS (SELECT grp, {_RANK.format('lag')} AS r FROM entity_lag), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM r GROUP BY r)), g AS (SELECT sum(r) AS s, count(*) AS n FROM r GROUP BY grp), h AS (SELECT sum(s * s / n) AS x, sum(n)::DOUBLE AS n FROM g) SELECT {q6('(12 / (n * (n + 1)) * x - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n))')} AS h, CAST(n AS BIGINT) AS n FROM h, t")
def e33_kruskal(spark, d):
    x = windows.ranked(entity_lag(spark, d), "lag", "r")
    return aggregate.kruskal(x, "grp", "r").select(r6("h").alias("h"), "n")


@query(f"WITH {SHOTS}, r AS (SELECT source, count(*) AS r FROM shots GROUP BY 1), c AS (SELECT stratum, count(*) AS c FROM shots GROUP BY 1), o AS (SELECT source, stratum, count(*) AS o FROM shots GROUP BY ALL), t AS (SELECT count(*) AS t FROM shots) SELECT {q6('sum(pow(coalesce(o, 0) - r * c / t::DOUBLE, 2) / (r * c / t::DOUBLE))')} AS chi2, (count(DISTINCT source) - 1) * (count(DISTINCT stratum) - 1) AS df FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o USING (source, stratum)")
def e33_chi_square(spark, d):
    return aggregate.chi_square(shots(spark, d), "source", "stratum").select("chi2", "df").withColumn("chi2", r6("chi2"))


_SERIES = "list_sum(list_transform(range(30), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * pow(x, 2 * k + 1) / (factorial(CAST(k AS INTEGER))::DOUBLE * (2 * k + 1))))"


@query(f"""WITH {ENTITY_LAG}, r AS (SELECT grp = 'SGA' AS g, {_RANK.format('lag')} AS r FROM entity_lag), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM r GROUP BY r)), s AS (SELECT sum(r) FILTER (g) AS s, count_if(g)::DOUBLE AS n1, count_if(NOT g)::DOUBLE AS n0 FROM r),
 u AS (SELECT s - n1 * (n1 + 1) / 2 AS u, n1, n0, sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - t / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM s, t), z AS (SELECT *, sign(u - n1 * n0 / 2) * greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / sd AS z FROM u), x AS (SELECT *, abs(z) / sqrt(2::DOUBLE) AS x FROM z)
SELECT {q6('u')} AS u, {q6('z')} AS z, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, {q6(f'1 - 2 / sqrt(pi()) * {_SERIES}')} AS p FROM x""")
def e33_mann_whitney(spark, d):
    x = entity_lag(spark, d).withColumn("g", (F.col("grp") == "SGA").cast("int"))
    return aggregate.mann_whitney(x, "g", "lag").select(r6("u").alias("u"), r6("z").alias("z"), "n1", "n0", r6("p").alias("p"))


@query(f"WITH {ENTITY_LAG}, v AS (SELECT lag, sum(count_if(grp = 'SGA')) OVER w AS a, sum(count_if(grp = 'LGA')) OVER w AS b FROM entity_lag GROUP BY lag WINDOW w AS (ORDER BY lag)), n AS (SELECT count_if(grp = 'SGA') AS na, count_if(grp = 'LGA') AS nb FROM entity_lag) SELECT {q6('max(abs(a / na::DOUBLE - b / nb::DOUBLE))')} AS ks FROM v, n")
def e33_ks_distance(spark, d):
    return aggregate.ks_distance(entity_lag(spark, d), "grp", "SGA", "LGA", "lag").select(r6("ks").alias("ks"))


@query(f"""WITH {SHOTS}, r AS (SELECT stratum AS g, {_RANK.format('lag')} AS r FROM shots), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM r GROUP BY r)), h AS (SELECT sum(s * s / n) AS x, sum(n)::DOUBLE AS n, count(*) AS k FROM (SELECT sum(r) AS s, count(*) AS n FROM r GROUP BY g)),
 v AS (SELECT (12 / (n * (n + 1)) * x - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, k - 1 AS df FROM h, t) SELECT {q6('h')} AS h, df, {q6('exp(-h / 2)')} AS p FROM v""")
def e33_kruskal_p(spark, d):
    """Three groups, so two degrees of freedom, whose tail is exp(-h / 2)."""
    x = windows.ranked(shots(spark, d), "lag", "r")
    return aggregate.kruskal(x, "stratum", "r").select(r6("h").alias("h"), "df", r6("p").alias("p"))


_TWO = "x AS (SELECT part % 2 AS a, (part // 2) % 2 AS b FROM shots), o AS (SELECT a, b, count(*) AS o, sum(count(*)) OVER (PARTITION BY a)::DOUBLE * sum(count(*)) OVER (PARTITION BY b) / sum(count(*)) OVER () AS e FROM x GROUP BY a, b)"


@query(f"""WITH {SHOTS}, {_TWO}, y AS (SELECT sum(pow(greatest(abs(o - e) - 0.5, 0), 2) / e) AS yates FROM o), x2 AS (SELECT yates, sqrt(yates / 2) AS x FROM y) SELECT {q6('yates')} AS yates, {q6(f'1 - 2 / sqrt(pi()) * {_SERIES}')} AS p FROM x2""")
def e33_yates(spark, d):
    """Two by two, corrected; one degree of freedom is the normal tail."""
    x = shots(spark, d).select((F.col("part") % 2).alias("a"), (F.floor(F.col("part") / 2) % 2).alias("b"))
    return aggregate.chi_square(x, "a", "b").select(r6("yates").alias("yates"), r6("p").alias("p"))


@query(f"""WITH {ENTITY_LAG}, v AS (SELECT lag, sum(count_if(grp = 'SGA')) OVER w AS a, sum(count_if(grp = 'LGA')) OVER w AS b FROM entity_lag GROUP BY lag WINDOW w AS (ORDER BY lag)), n AS (SELECT count_if(grp = 'SGA')::DOUBLE AS na, count_if(grp = 'LGA')::DOUBLE AS nb FROM entity_lag),
 k AS (SELECT max(abs(a / na - b / nb)) AS ks, max(na * nb / (na + nb)) AS m FROM v, n), l AS (SELECT ks, greatest(ks * sqrt(m), 1e-3) AS l FROM k), j AS (SELECT ks, l, unnest(range(1, 51)) AS j FROM l)
SELECT {q6('max(ks)')} AS ks, {q6('CASE WHEN max(l) < 1 THEN 1 - sqrt(2 * pi()) / max(l) * sum(exp(-(2 * j - 1) * (2 * j - 1) * pi() * pi() / (8 * l * l))) ELSE 2 * sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * l * l)) END')} AS p FROM j""")
def e33_ks_p(spark, d):
    return aggregate.ks_distance(entity_lag(spark, d), "grp", "SGA", "LGA", "lag").select(r6("ks").alias("ks"), r6("p").alias("p"))


_EFFECTS = "eff AS (SELECT stratum, source, avg(lag) AS e, var_samp(lag) / count(*) AS v FROM shots GROUP BY ALL HAVING count(*) > 5)"


@query(f"""WITH {SHOTS}, {_EFFECTS}, g AS (SELECT stratum, count(*) AS k, sum(1 / v) AS w, sum(e / v) AS we, sum(e * e / v) AS wee, sum(1 / (v * v)) AS ww FROM eff GROUP BY stratum), h AS (SELECT stratum, k, wee - we * we / w AS q, greatest(0, (wee - we * we / w - (k - 1)) / (w - ww / w)) AS tau2 FROM g)
SELECT stratum, any_value(k) AS k, {q6('any_value(q)')} AS q, {q6('any_value(tau2)')} AS tau2, {q6('sum(e / (v + tau2)) / sum(1 / (v + tau2))')} AS pooled, {q6('sqrt(1 / sum(1 / (v + tau2)))')} AS se FROM eff JOIN h USING (stratum) GROUP BY stratum""")
def e34_random_effects(spark, d):
    e = shots(spark, d).groupBy("stratum", "source").agg(F.avg("lag").alias("e"), (F.var_samp("lag") / F.count("*")).alias("v"), F.count("*").alias("n")).where("n > 5")
    return aggregate.random_effects(e, ["stratum"], "e", "v").select("stratum", "k", *[r6(c).alias(c) for c in ("q", "tau2", "pooled", "se")])


@query(f"WITH {ENTITY_LAG}, c AS (SELECT quantile_cont(lag, 1/3.0) AS a, quantile_cont(lag, 2/3.0) AS b FROM entity_lag) SELECT CAST((lag > a)::INT + (lag > b)::INT AS INTEGER) AS tertile, count(*) AS n, {q6('avg(percentile)')} AS percentile FROM entity_lag, c GROUP BY 1")
def e35_tertile_gradient(spark, d):
    x = windows.percentile_cut(entity_lag(spark, d), "lag", [1 / 3, 2 / 3], "tertile")
    return x.groupBy("tertile").agg(F.count("*").alias("n"), r6(F.avg("percentile")).alias("percentile"))


@query(f"WITH {ENTITY_LAG}, c AS (SELECT quantile_cont(lag, 0.9) AS c FROM entity_lag), r AS (SELECT lag > c AS g, {_RANK.format('percentile')} AS r FROM entity_lag, c) SELECT {q6('(sum(r) FILTER (g) - count_if(g) * (count_if(g) + 1) / 2.0) / (count_if(g) * count_if(NOT g))')} AS auc, count_if(g) AS n1 FROM r")
def e35_top_decile(spark, d):
    """How well the percentile tells the top tenth by lag."""
    x = windows.percentile_cut(entity_lag(spark, d), "lag", [0.9], "top")
    return aggregate.auc(x, "top", "percentile").select(r6("auc").alias("auc"), "n1")


@query(f"""WITH {FRAMES}, x AS (SELECT entity, frame, y, r, row_number() OVER (PARTITION BY r, entity ORDER BY (frame * 7919 + r * 104729 + frame * r * 31) % 10007, frame) % 2 AS i FROM frames, range(1, 21) q(r)), h AS (SELECT r, entity, avg(y) FILTER (i = 0) AS a, avg(y) FILTER (i = 1) AS b, count(*) AS n FROM x GROUP BY ALL),
 c AS (SELECT least, r, corr(a, b) AS c, count(*) AS e FROM h, (SELECT unnest([2, 4, 6]) AS least) WHERE n >= least GROUP BY ALL) SELECT least, {q6('avg(c)')} AS r, {q6('avg(2 * c / (1 + c))')} AS reliability, max(e) AS entities FROM c GROUP BY least""")
def e21_random_halves(spark, d):
    """Reliability over random halves, by the frames an entity must have."""
    from panelforge.operators.resample import arithmetic_order

    x = inference.split_halves(frames(spark, d), "entity", "frame", "y", 20, order=arithmetic_order())
    return x.select("least", r6("r").alias("r"), r6("reliability").alias("reliability"), "entities")
