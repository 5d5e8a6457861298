"""F: window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.fixtures import CELLS, ENTITY_LAG, FRAMES, SHOTS, VISITS, WIDE, cells, entity_lag, frames, shots, visits, wide
from panelforge.operators import inference, windows
from panelforge.registry import q6, query, r6, table


@query(f"WITH {WIDE}, w AS (SELECT entity, visit, t, view, lead(visit) OVER o AS v2, lead(t) OVER o AS t2, lead(view) OVER o AS y2 FROM wide WINDOW o AS (PARTITION BY entity ORDER BY visit)) SELECT entity, visit, {q6('(t + t2) / 2')} AS mid_time, {q6('(y2 - view) / (t2 - t)')} AS velocity FROM w WHERE v2 = visit + 1 AND t2 > t AND y2 IS NOT NULL AND view IS NOT NULL")
def f01_velocity(spark, d):
    v = windows.velocity(wide(spark, d), "entity", "visit", "t", "view")
    return v.select("entity", "visit", r6("mid_time").alias("mid_time"), r6("velocity").alias("velocity"))


_LOO = """p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS r, count(*) OVER (PARTITION BY entity) AS n FROM visits WHERE measure = 'view' AND value IS NOT NULL),
 dev AS (SELECT a.entity, a.event_id, any_value(a.value) - (regr_intercept(b.value, b.t) + regr_slope(b.value, b.t) * any_value(a.t)) AS deviation FROM p a JOIN p b ON a.entity = b.entity AND a.event_id <> b.event_id WHERE a.n >= 3 AND a.r > 1 AND a.r < a.n GROUP BY a.entity, a.event_id)"""


def _deviation(spark, d):
    return windows.left_out_deviation(visits(spark, d).where("measure = 'view'"), "entity", "t", "value")


@query(f"WITH {VISITS}, {_LOO} SELECT entity, event_id, CAST(round_even(deviation, 4) AS DOUBLE) + 0.0 AS deviation FROM dev")
def f02_left_out_deviation(spark, d):
    return _deviation(spark, d).select("entity", "event_id", (F.bround("deviation", 4) + 0.0).alias("deviation"))


@query(f"WITH {VISITS}, {_LOO} SELECT entity, CAST(round_even(ln(1 + sqrt(avg(deviation * deviation))), 4) AS DOUBLE) AS noise FROM dev GROUP BY entity")
def f03_noise_level(spark, d):
    return _deviation(spark, d).groupBy("entity").agg(F.bround(F.log1p(F.sqrt(F.avg(F.col("deviation") * F.col("deviation")))), 4).alias("noise"))


@query(f"WITH {SHOTS}, top AS (SELECT source FROM shots GROUP BY source ORDER BY count(*) DESC, source LIMIT 6), x AS (SELECT entity, lag - avg(lag) OVER (PARTITION BY source) AS c FROM shots WHERE source IN (SELECT source FROM top)) SELECT entity, {q6('avg(c)')} AS adjusted FROM x GROUP BY entity")
def f04_source_centred(spark, d):
    from panelforge.operators.sampling import top_groups

    x = windows.centred(top_groups(shots(spark, d), "source", 6), "source", "lag")
    return x.groupBy("entity").agg(r6(F.avg("centred")).alias("adjusted"))


@query(f"WITH {FRAMES} SELECT frame, {q6('(y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-8)')} AS z FROM frames WINDOW w AS (PARTITION BY stratum)")
def f05_stratum_z(spark, d):
    return windows.stratum_z(frames(spark, d), "stratum", "y").select("frame", r6("z").alias("z"))


@query(f"WITH {CELLS} SELECT entity, visit, measure, {q6('value / stddev_samp(value) OVER (PARTITION BY visit)')} AS scaled FROM cells")
def f06_slot_standardised(spark, d):
    c = cells(spark, d)
    s = c.groupBy("visit").agg(F.stddev_samp("value").alias("s"))
    return c.join(s, "visit").select("entity", "visit", "measure", r6(F.col("value") / F.col("s")).alias("scaled"))


@query(f"WITH {ENTITY_LAG}, e AS (SELECT " + ", ".join(f"quantile_cont(lag, {p}) AS e{i}" for i, p in enumerate(("1/3.0", "2/3.0"))) + " FROM entity_lag) SELECT entity, rank() OVER (ORDER BY lag) + (count(*) OVER (PARTITION BY lag) - 1) / 2.0 AS rank, CAST((lag > e0)::INT + (lag > e1)::INT AS INTEGER) AS tertile, CAST(least(greatest(floor(percentile / 10), 0), 9) AS INTEGER) AS decile FROM entity_lag, e")
def f07_rank_and_cut(spark, d):
    x = windows.percentile_cut(windows.ranked(entity_lag(spark, d), "lag"), "lag", [1 / 3, 2 / 3], "tertile")
    return x.select("entity", "rank", "tertile", F.least(F.greatest(F.floor(F.col("percentile") / 10), F.lit(0)), F.lit(9)).cast("int").alias("decile"))


@query(f"WITH {SHOTS}, n AS (SELECT part, count(*) AS n FROM shots GROUP BY part) SELECT CASE WHEN n < 32 THEN 'pooled' ELSE CAST(part AS VARCHAR) END AS stratum, count(*) AS n FROM shots JOIN n USING (part) GROUP BY 1")
def f08_collapse_rare(spark, d):
    x = windows.collapse_rare(shots(spark, d).select(F.col("part").cast("string").alias("stratum")), "stratum", 32)
    return x.groupBy("stratum").agg(F.count("*").alias("n"))


@query(f"""WITH {VISITS}, p AS (SELECT entity, day AS t, avg(value) AS v FROM visits WHERE measure = 'click' AND value IS NOT NULL GROUP BY ALL), s AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM p WINDOW w AS (PARTITION BY entity ORDER BY t)), l AS (SELECT *, max(t2) OVER (PARTITION BY entity) AS last FROM s WHERE t2 IS NOT NULL)
SELECT at_day, count(*) AS n, {q6('avg(v + (v2 - v) * (at_day - t) / (t2 - t))')} AS value FROM (SELECT *, unnest(range(t, CASE WHEN t2 = last THEN t2 + 1 ELSE t2 END)) AS at_day FROM l) GROUP BY at_day""")
def f09_grid_path(spark, d):
    p = visits(spark, d).where("measure = 'click' and value is not null").groupBy("entity", F.col("day").alias("t")).agg(F.avg("value").alias("v"))
    return windows.to_grid(p, "entity", "t", "v").groupBy(F.col("at").cast("long").alias("at_day")).agg(F.count("*").alias("n"), r6(F.avg("v")).alias("value"))


_P = "pv AS (SELECT part AS id, (part * 7919 % 9973) / CAST(9973 AS DOUBLE) AS p FROM (SELECT DISTINCT l_partkey AS part FROM lineitem))"
_ADJ = "m AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r FROM pv)"


def _pv(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct().withColumn("p", (F.col("id") * 7919 % 9973) / 9973.0)


@query(f"WITH {_P}, {_ADJ}, h AS (SELECT sum(CAST(1 AS DOUBLE) / i) AS h FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM pv))) AS i)) SELECT id, {q6('least(1, min(p * m / r) OVER w)')} AS bh, {q6('least(1, min(p * m / r * h) OVER w)')} AS by FROM m, h WINDOW w AS (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)")
def f10_adjusted_p(spark, d):
    x = windows.adjust_p(_pv(spark, d)).withColumnRenamed("q", "bh")
    return windows.adjust_p(x, method="by").select("id", r6("bh").alias("bh"), r6("q").alias("by"))


@query(f"WITH {SHOTS}, b AS (SELECT l_orderkey, l_linenumber, part, least(greatest(floor((weeks - 6) / 36 * 16), 0), 15) AS b FROM shots), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY b) AS w FROM b) SELECT l_orderkey, l_linenumber, part, {q6('w / avg(w) OVER ()')} AS weight FROM w")
def f11_balance_weights(spark, d):
    x = windows.balance_weights(shots(spark, d), "weeks", 6, 42, 16)
    return x.select("l_orderkey", "l_linenumber", "part", r6("weight").alias("weight"))


@query(f"WITH {ENTITY_LAG}, r AS (SELECT entity, lag - (SELECT regr_slope(lag, weeks) FROM entity_lag) * weeks - (SELECT regr_intercept(lag, weeks) FROM entity_lag) AS r FROM entity_lag), m AS (SELECT quantile_cont(r, 0.5) AS m FROM r), a AS (SELECT quantile_cont(abs(r - m), 0.5) AS mad FROM r, m) SELECT entity, {q6('(r - m) / (1.4826 * mad)')} AS z FROM r, m, a")
def f12_robust_z(spark, d):
    x = windows.debiased(entity_lag(spark, d), "lag", "weeks", "r")
    return windows.robust_z(x, "r", "z").select("entity", r6("z").alias("z"))


@query()
def f12_spline_z(spark, d):
    """Robust z of what a spline in time leaves of the log value; valid only within the guards."""
    e = entity_lag(spark, d).select("entity", F.col("weeks").cast("double").alias("weeks"), (F.col("size") + 2000).alias("value"))
    z = inference.spline_z(e, "value", "weeks")
    return z.select("entity", r6("z").alias("z"), r6("with_time").alias("with_time"), r6("with_raw").alias("with_raw"), "valid")


@query(f"WITH {ENTITY_LAG}, k AS (SELECT regr_slope(lag, weeks) AS k, regr_intercept(lag, weeks) AS c FROM entity_lag) SELECT entity, {q6('lag - k * weeks - c')} AS debiased FROM entity_lag, k")
def f13_debiased_lag(spark, d):
    return windows.debiased(entity_lag(spark, d), "lag", "weeks").select("entity", r6("debiased").alias("debiased"))


@query(f"WITH {FRAMES} SELECT frame, " + ", ".join(q6(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()") + f" AS {c}" for c in ("x1", "x2", "x3")) + " FROM frames")
def f14_global_standardisation(spark, d):
    cols = ("x1", "x2", "x3")
    x = windows.with_row(frames(spark, d), *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    return x.select("frame", *[r6((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in cols])


@query(f"WITH {SHOTS}, e AS (SELECT quantile_cont(weeks, 1/3.0) AS a, quantile_cont(weeks, 2/3.0) AS b FROM shots) SELECT year(study) || '_' || ((weeks > a)::INT + (weeks > b)::INT) AS stratum, count(*) AS n FROM shots, e GROUP BY 1")
def f15_acquisition_strata(spark, d):
    x = windows.percentile_cut(shots(spark, d), "weeks", [1 / 3, 2 / 3])
    return x.groupBy(F.concat_ws("_", F.year("study").cast("string"), F.col("cut").cast("string")).alias("stratum")).agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, s AS (SELECT measure, quantile_cont(value, 0.5) AS m, stddev_pop(value) AS s FROM cells GROUP BY measure) SELECT entity, {q6('max(abs(value - m) / s)')} AS score FROM cells JOIN s USING (measure) GROUP BY entity")
def f16_outlier_score(spark, d):
    return windows.outlier_score(cells(spark, d), "entity", "measure", "value").withColumn("score", r6("score"))
