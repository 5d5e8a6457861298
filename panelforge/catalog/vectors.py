"""H and M: vector and token operators, plug points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelforge.catalog.fixtures import ENTITY_LAG, FRAMES, entity_lag, frames
from panelforge.operators import resample, vectors
from panelforge.registry import q6, query, r6

E = "CAST(emb[{i}] AS DOUBLE)"


@query(f"WITH {FRAMES} SELECT stratum, count(*) AS n, {q6('avg(' + E.format(i=2) + ')')} AS mean, {q6('quantile_cont(' + E.format(i=2) + ', 0.5)')} AS median FROM frames GROUP BY stratum")
def h01_vector_mean_median(spark, d):
    f = frames(spark, d)
    m, q = vectors.mean_by(f, ["stratum"], "emb"), vectors.median_by(f, ["stratum"], "emb")
    return m.join(q, "stratum").select("stratum", "n", r6(F.col("mean")[1]).alias("mean"), r6(F.col("median")[1]).alias("median"))


@query(f"WITH {FRAMES} SELECT frame, {q6('(' + E.format(i=1) + ' - avg(' + E.format(i=1) + ') OVER ()) / stddev_pop(' + E.format(i=1) + ') OVER ()')} AS a, {q6('(' + E.format(i=5) + ' - avg(' + E.format(i=5) + ') OVER ()) / stddev_pop(' + E.format(i=5) + ') OVER ()')} AS b, CAST(8 AS INTEGER) AS width FROM frames")
def h02_layer_fusion(spark, d):
    f = frames(spark, d).select("frame", F.slice("emb", 1, 4).alias("early"), F.slice("emb", 5, 4).alias("late"))
    x = vectors.fused(f, ["early", "late"])
    return x.select("frame", r6(F.col("fused")[0]).alias("a"), r6(F.col("fused")[4]).alias("b"), F.size("fused").alias("width"))


_TOKEN0 = [E.format(i=1 + 8 * p) for p in range(8)]
_CENTRE0 = _TOKEN0[2:6]


_T = "t AS (SELECT frame, p, list_transform(emb[8 * p + 1 : 8 * p + 8], lambda x: CAST(x AS DOUBLE)) AS tok FROM frames, range(8) r(p)), u AS (SELECT frame, p, tok[1] AS v, tok, sqrt(list_inner_product(tok, tok)) AS nrm, exp(-pow((p - 3.5) / 3.5, 2)) AS g FROM t)"


@query(f"WITH {FRAMES}, {_T} SELECT frame, {q6('avg(v)')} AS mean, {q6('max(v)')} AS max, {q6('stddev_pop(v)')} AS std, {q6('avg(v) FILTER (p BETWEEN 2 AND 5)')} AS centre, {q6('avg(v) FILTER (p NOT BETWEEN 2 AND 5)')} AS periphery, {q6('avg(v) * max(v)')} AS product, {q6('sum(v * nrm) / sum(nrm)')} AS norm_weighted, {q6('sum(v * g) / sum(g)')} AS gaussian FROM u GROUP BY frame")
def h03_patch_pooling(spark, d):
    x = vectors.with_pooled(frames(spark, d).select("frame", "emb"), "emb", vectors.POOLS, 8)
    return x.select("frame", *[r6(F.col(p)[0]).alias(p) for p in vectors.POOLS])


@query(f"""WITH {FRAMES}, {_T}, n AS (SELECT frame, avg(nrm) AS norm_mean, stddev_pop(nrm) AS norm_std, max(nrm) - min(nrm) AS norm_range, avg(nrm) FILTER (p NOT BETWEEN 2 AND 5) - avg(nrm) FILTER (p BETWEEN 2 AND 5) AS edge FROM u GROUP BY frame), c AS (SELECT frame, p, unnest(tok) AS v, unnest(range(8)) AS k FROM u),
 g AS (SELECT frame, avg(pow(v - w, 2)) AS gradient FROM (SELECT frame, v, lag(v) OVER (PARTITION BY frame, k ORDER BY p) AS w FROM c) WHERE w IS NOT NULL GROUP BY frame), s AS (SELECT frame, avg(x) AS variance FROM (SELECT frame, k, var_pop(v) AS x FROM c GROUP BY ALL) GROUP BY frame)
SELECT frame, {q6('norm_mean')} AS norm_mean, {q6('norm_std')} AS norm_std, {q6('norm_range')} AS norm_range, {q6('gradient')} AS gradient, {q6('edge')} AS edge_minus_centre, {q6('variance')} AS variance FROM n JOIN g USING (frame) JOIN s USING (frame)""")
def h04_texture(spark, d):
    x = vectors.with_pooled(frames(spark, d).select("frame", "emb"), "emb", {"texture": vectors.texture}, 8)
    return x.select("frame", *[r6(F.col("texture")[i]).alias(n) for i, n in enumerate(("norm_mean", "norm_std", "norm_range", "gradient", "edge_minus_centre", "variance"))])


@query(f"WITH {FRAMES} SELECT frame, CAST(p AS INTEGER) AS patch, {q6(' + '.join(f'CAST(emb[p * 8 + {i + 1}] AS DOUBLE) * {i + 1}' for i in range(8)))} AS saliency FROM frames, range(8) r(p)")
def h05_saliency(spark, d):
    t = vectors.to_tokens(frames(spark, d).select("frame", "emb"), "emb", 8)
    return t.select("frame", "patch", r6(vectors.dot("tok", range(1, 9))).alias("saliency"))


@query(f"WITH {FRAMES} SELECT frame, {q6(E.format(i=1))} AS cls, {q6('(' + ' + '.join(_TOKEN0[1:]) + ') / 7')} AS patch FROM frames")
def h06_layer_summary(spark, d):
    x = vectors.with_pooled(frames(spark, d).select("frame", "emb"), "emb", {"summary": lambda t: np.concatenate([t[:, 0], t[:, 1:].mean(1)], axis=1)}, 8)
    return x.select("frame", r6(F.col("summary")[0]).alias("cls"), r6(F.col("summary")[8]).alias("patch"))


@query(f"""WITH {FRAMES}, l AS (SELECT frame, stratum, unnest(emb)::DOUBLE AS v, unnest(range(64)) AS k FROM frames), m AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY k), z AS (SELECT frame, stratum, k, (v - m) / s AS z FROM l JOIN m USING (k)), c AS (SELECT stratum AS code, k, avg(z) AS c FROM z GROUP BY ALL),
 x AS (SELECT frame, code, sum(pow(z - c, 2)) AS distance FROM z JOIN c USING (k) GROUP BY ALL) SELECT frame, CAST(arg_min(code, distance) AS INTEGER) AS code, {q6('min(distance)')} AS distance FROM x GROUP BY frame""")
def h07_assign_codes(spark, d):
    """Standardised vectors to the nearest of the strata's standardised means."""
    f = frames(spark, d).select("frame", "stratum", "emb")
    _, mean, sd = vectors.moments(f, "emb")
    rows = vectors.mean_by(f, ["stratum"], "emb").orderBy("stratum").collect()
    centres = (np.array([r["mean"] for r in rows]) - mean) / sd
    names = F.array(*[F.lit(int(r.stratum)) for r in rows])
    x = vectors.assign(f.select("frame", "emb"), "emb", centres, mean=mean, sd=sd)
    return x.select("frame", F.element_at(names, F.col("code") + 1).alias("code"), r6("distance").alias("distance"))


@query(f"WITH {FRAMES}, x AS (SELECT frame, list_transform(range(64), lambda i: CAST(emb[i + 1] AS DOUBLE)) AS v, list_transform(range(64), lambda i: CASE WHEN (frame + i) % 3 = 0 AND frame % 10 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS m FROM frames), y AS (SELECT frame, unnest(v) AS v, unnest(m) AS m FROM x) SELECT frame, {q6('CASE WHEN sum(m) > 0 THEN sum(v * m) / sum(m) ELSE avg(v) END')} AS error FROM y GROUP BY frame")
def h08_masked_mean(spark, d):
    f = frames(spark, d).withColumn("m", F.transform("emb", lambda v, i: F.when(((F.col("frame") + i) % 3 == 0) & (F.col("frame") % 10 > 0), 1.0).otherwise(0.0)))
    return f.select("frame", r6(vectors.masked_mean("emb", "m")).alias("error"))


_M01 = ", ".join(str(e) for e in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183))


@query(f"WITH {ENTITY_LAG}, b AS (SELECT lag, r, len(list_filter([{_M01}]::DOUBLE[], lambda e: ((entity * 7919 + r * 104729 + entity * r * 31) % 10007 + 0.5::DOUBLE) / 10007 > e)) AS w FROM entity_lag, range(1, 11) x(r)) SELECT CAST(r AS INTEGER) AS replicate, {q6('sum(lag * w) / greatest(sum(w), 1)')} AS s FROM b GROUP BY r")
def m01_statistic_plug_point(spark, d):
    x = resample.per_replicate(entity_lag(spark, d).select("entity", "lag", "size"), lambda p: float((p["lag"].astype(float) * p["weight"]).sum() / max(p["weight"].sum(), 1)), 10, resample.arithmetic_order())
    return x.select("replicate", r6("s").alias("s"))


@query(f"""WITH {FRAMES}, f AS (SELECT *, entity * 7919 % 10007 % 5 AS fold FROM frames), s AS (SELECT g.fold, count(*) AS n, avg(x1) AS mx, avg(y) AS my, var_pop(x1) AS vx, covar_pop(x1, y) AS c FROM f JOIN (SELECT DISTINCT fold FROM f) g ON f.fold <> g.fold GROUP BY g.fold),
 p AS (SELECT y, my + (x1 - mx) * (n * c / (n * vx + vx)) AS pred FROM f JOIN s USING (fold)) SELECT {q6('corr(pred, y)')} AS r, count(*) AS n FROM p""")
def m02_fit_predict_plug_point(spark, d):
    """A callable from rows with ``fold`` to (row, pred): here the library's own ridge."""
    from panelforge.operators.linear import cross_validated

    def fit_predict(df):
        return cross_validated(df, ["x1"], "y", alpha=1.0).predict(df)

    x = fit_predict(frames(spark, d).select("frame", "x1", "y", (F.col("entity") * 7919 % 10007 % 5).cast("int").alias("fold")))
    return x.agg(r6(F.corr("pred", "y")).alias("r"), F.count("*").alias("n"))


@query(f"WITH {FRAMES} SELECT frame, {q6('(' + ' + '.join(f'{i + 1} * {t}' for i, t in enumerate(_TOKEN0)) + ') / 36')} AS first FROM frames")
def m03_pooler_plug_point(spark, d):
    ramp = np.arange(1, 9) / 36
    x = vectors.with_pooled(frames(spark, d).select("frame", "emb"), "emb", {"ramp": lambda t: np.einsum("npd,p->nd", t, ramp)}, 8)
    return x.select("frame", r6(F.col("ramp")[0]).alias("first"))


@query(f"WITH {FRAMES} SELECT stratum, " + ", ".join(f"{q6(f'sum({E.format(i=i + 1)})')} AS s{i}" for i in (0, 3)) + " FROM frames GROUP BY stratum")
def m04_array_aggregate(spark, d):
    f = frames(spark, d).select("stratum", F.transform(F.slice("emb", 1, 4), lambda v: v.cast("double")).alias("v"))
    s = f.groupBy("stratum").agg(vectors.sum_arrays("v", 4).alias("s"))
    return s.select("stratum", *[r6(F.col("s")[i]).alias(f"s{i}") for i in (0, 3)])
