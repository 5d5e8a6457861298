"""K: resampling and nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.fixtures import ENTITY_LAG, FRAMES, entity_lag, frames
from panelforge.operators import resample
from panelforge.operators.bijection import partner_sql
from panelforge.operators.lineage import cut
from panelforge.registry import q6, query, r6

R = 40
#: Replicates where a p value comes out.
RP = 200
_ORDER = resample.arithmetic_order()
_KEY = "({k} * 7919 + r * 104729 + {k} * r * 31) % 10007"


def _entities(spark, d):
    return entity_lag(spark, d).withColumn("grp2", F.col("entity") % 3)


_ENT = ENTITY_LAG + ", ent AS (SELECT *, entity % 3 AS grp2 FROM entity_lag)"
_REPS = f"reps AS (SELECT unnest(range(1, {R + 1})) AS r)"
_REPS_P = f"reps AS (SELECT unnest(range(1, {RP + 1})) AS r)"


def _moved(by: str = "", key: str = "entity") -> str:
    """Rows by number (within ``by``), and for each replicate the number that takes a row's place."""
    part = f"PARTITION BY {by} " if by else ""
    return f"num AS (SELECT *, row_number() OVER ({part}ORDER BY {key}) AS i, count(*) OVER ({part}) AS of_n FROM ent), a AS (SELECT num.*, r, {partner_sql('i', 'of_n', 'r')} AS j FROM num, reps)"


def _perm(by: str) -> str:
    return f"""{_moved(by)}, s AS (SELECT a.r, abs(corr(a.size, b.lag)) AS s FROM a JOIN num b ON b.i = a.j{f' AND a.{by} = b.{by}' if by else ''} GROUP BY a.r), o AS (SELECT abs(corr(size, lag)) AS o FROM ent)
SELECT {q6('any_value(o)')} AS observed, {q6(f'(1 + count_if(s >= o - 1e-9)) / {RP + 1}.0')} AS p, {q6('avg(s)')} AS null_mean, {q6('quantile_cont(s, 0.95)')} AS null_p95 FROM s, o"""


def _test(spark, d, strata):
    x = resample.permutation_test(_entities(spark, d), "entity", "lag", lambda t: F.corr("size", t), RP, strata)
    return x.select(*[r6(c).alias(c) for c in ("observed", "p", "null_mean", "null_p95")])


@query(f"WITH {_ENT}, {_REPS_P}, {_perm('')}")
def k01_row_permutation(spark, d):
    return _test(spark, d, [])


@query(f"WITH {_ENT}, {_REPS_P}, {_perm('grp2')}")
def k02_stratified_permutation(spark, d):
    return _test(spark, d, ["grp2"])


@query(f"WITH {_ENT}, {_REPS}, {_moved()} SELECT CAST(a.r AS INTEGER) AS replicate, {q6('corr(a.size, b.lag)')} AS a, {q6('corr(b.lag, b.weeks)')} AS kept FROM a JOIN num b ON b.i = a.j GROUP BY a.r")
def k03_block_permutation(spark, d):
    """Rows of the block (lag, weeks) are permuted together, so its inner correlation stays."""
    e = _entities(spark, d).withColumn("block", F.struct("lag", "weeks"))
    p = resample.permuted(e, "entity", "block", R)
    return p.groupBy("replicate").agg(r6(F.corr("size", "block_perm.lag")).alias("a"), r6(F.corr("block_perm.lag", "block_perm.weeks")).alias("kept"))


@query(f"WITH {_ENT}, {_REPS}, {_moved()}, c AS (SELECT i, r, {partner_sql('i', 'of_n', 'r', 1)} AS k FROM num, reps) SELECT CAST(a.r AS INTEGER) AS replicate, {q6('corr(b.lag, d.weeks)')} AS broken FROM a JOIN c ON a.r = c.r AND a.i = c.i JOIN num b ON b.i = a.j JOIN num d ON d.i = c.k GROUP BY a.r")
def k04_column_permutation(spark, d):
    """Each column permuted by a bijection of its own (parallel analysis): inner correlations go."""
    e = _entities(spark, d)
    one = resample.permuted(e, "entity", "lag", R).select("replicate", "entity", "lag_perm")
    two = resample.permuted(e, "entity", "weeks", R, seed=1).select("replicate", "entity", "weeks_perm")
    return one.join(two, ["replicate", "entity"]).groupBy("replicate").agg(r6(F.corr("lag_perm", "weeks_perm")).alias("broken"))


@query(f"WITH {FRAMES}, {_REPS}, ent AS (SELECT entity, min(y) AS t FROM frames GROUP BY entity), {_moved()}, p AS (SELECT a.r, a.entity, b.t FROM a JOIN num b ON b.i = a.j) SELECT CAST(r AS INTEGER) AS replicate, {q6('corr(x1, t)')} AS s FROM frames JOIN p USING (entity) GROUP BY r")
def k05_whole_group_permutation(spark, d):
    x = resample.whole_groups(frames(spark, d).withColumn("t", F.col("y")), "entity", "t", R)
    return x.groupBy("replicate").agg(r6(F.corr("x1", "t_perm")).alias("s"))


@query(f"WITH {FRAMES}, {_REPS}, ent AS (SELECT * FROM frames), {_moved('entity', 'frame')} SELECT CAST(a.r AS INTEGER) AS replicate, {q6('corr(a.x1, b.y)')} AS s FROM a JOIN num b ON b.i = a.j AND b.entity = a.entity GROUP BY a.r")
def k06_time_shuffle(spark, d):
    x = resample.shuffled_times(frames(spark, d), "entity", "frame", "y", R)
    return x.groupBy("replicate").agg(r6(F.corr("x1", "y_perm")).alias("s"))


_POIS = "(" + " + ".join(f"(u > {e})::INT" for e in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)) + ")"
_BOOT = f"bt AS (SELECT *, {_POIS} AS w FROM (SELECT *, ({_KEY.format(k='entity')} + 0.5::DOUBLE) / 10007 AS u FROM ent, reps))"


def _wcorr(a, b):
    return f"(sum(w) * sum(w * {a} * {b}) - sum(w * {a}) * sum(w * {b})) / sqrt((sum(w) * sum(w * {a} * {a}) - sum(w * {a}) * sum(w * {a})) * (sum(w) * sum(w * {b} * {b}) - sum(w * {b}) * sum(w * {b})))"


@query(f"WITH {_ENT}, {_REPS}, {_BOOT}, s AS (SELECT r, {_wcorr('lag', 'size')} AS s FROM bt GROUP BY r) SELECT {q6('quantile_cont(s, 0.025)')} AS low, {q6('quantile_cont(s, 0.5)')} AS middle, {q6('quantile_cont(s, 0.975)')} AS high, count(*) AS replicates FROM s")
def k07_bootstrap_interval(spark, d):
    x = resample.bootstrap_interval(_entities(spark, d), "entity", resample.weighted_correlation("lag", "size"), R, _ORDER)
    return x.select(*[r6(c).alias(c) for c in ("low", "middle", "high")], "replicates")


@query(f"WITH {_ENT}, {_REPS} SELECT CAST(r AS INTEGER) AS replicate, count(*) AS weights, count(*) AS entities FROM ent, reps GROUP BY r")
def k07_multinomial_weights(spark, d):
    """Every exact bootstrap draws as many entities as there are."""
    x = resample.multinomial_weights(_entities(spark, d).select("entity"), "entity", R)
    return x.groupBy("replicate").agg(F.sum("weight").alias("weights"), F.count("*").alias("entities"))


@query()
def k07_exact_interval(spark, d):
    x = resample.bootstrap_interval(_entities(spark, d), "entity", resample.weighted_correlation("lag", "size"), R, exact=True)
    return x.select(*[r6(c).alias(c) for c in ("low", "middle", "high")], "replicates")


@query(f"WITH {_ENT}, {_REPS}, {_BOOT}, s AS (SELECT r, {_wcorr('lag', 'size')} - {_wcorr('lag', 'weeks')} AS s FROM bt GROUP BY r) SELECT {q6('quantile_cont(s, 0.025)')} AS low, {q6('quantile_cont(s, 0.975)')} AS high, {q6('avg((s > 0)::INT)')} AS above, count(*) AS replicates FROM s")
def k08_paired_bootstrap(spark, d):
    x = resample.paired_difference(_entities(spark, d), "entity", resample.weighted_correlation("lag", "size"), resample.weighted_correlation("lag", "weeks"), R, _ORDER)
    return x.select(*[r6(c).alias(c) for c in ("low", "high", "above")], "replicates")


_FOLDS = "f AS (SELECT f.*, seed, (entity * 7919 + seed * 104729 + entity * seed * 31) % 10007 % 5 AS fold FROM frames f, range(1, 21) q(seed))"
# a ridge on two standardised features and on the first of them, from the sums of the training rows
_RIDGE2 = """s AS (SELECT g.seed, g.fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, corr(x1, x2) AS r, covar_pop(x1, y) / stddev_pop(x1) AS c1, covar_pop(x2, y) / stddev_pop(x2) AS c2 FROM f JOIN (SELECT DISTINCT seed, fold FROM f) g ON f.seed = g.seed AND f.fold <> g.fold GROUP BY ALL),
 w AS (SELECT *, n * c1 / (n + 1) AS b, ((n + 1) * n * c1 - n * r * n * c2) / ((n + 1) * (n + 1) - n * r * n * r) AS b1, ((n + 1) * n * c2 - n * r * n * c1) / ((n + 1) * (n + 1) - n * r * n * r) AS b2 FROM s),
 e AS (SELECT f.seed, 1 - sum(pow(y - my - (x1 - m1) / s1 * b, 2)) / (var_pop(y) * count(*)) AS small, 1 - sum(pow(y - my - (x1 - m1) / s1 * b1 - (x2 - m2) / s2 * b2, 2)) / (var_pop(y) * count(*)) AS joint FROM f JOIN w ON f.seed = w.seed AND f.fold = w.fold GROUP BY f.seed)"""


def _increments(spark, d):
    from panelforge.operators.inference import increments

    k, s = F.col("entity"), F.col("seed")
    fold = lambda _: ((k * 7919 + s * 104729 + k * s * 31) % 10007 % 5).cast("int")
    return increments(frames(spark, d), ["x1"], ["x2"], "y", "entity", 20, fold=fold)


@query(f"WITH {FRAMES}, {_FOLDS}, {_RIDGE2} SELECT {q6('avg(joint - small)')} AS mean, {q6('quantile_cont(joint - small, 0.025)')} AS low, {q6('quantile_cont(joint - small, 0.975)')} AS high, {q6('avg((joint - small <= 0)::INT)')} AS not_above, count(*) AS seeds FROM e")
def k09_seed_spread(spark, d):
    """Increment of features A+B over A across independent fold seeds (never by resampling rows)."""
    from panelforge.operators.inference import spread

    return spread(_increments(spark, d), "increment").select(*[r6(c).alias(c) for c in ("mean", "low", "high", "not_above")], "seeds")


@query(f"WITH {FRAMES}, {_FOLDS}, {_RIDGE2} SELECT CAST(seed AS INTEGER) AS seed, {q6('small')} AS small, {q6('joint')} AS joint, {q6('joint - small')} AS increment FROM e")
def k09_increments(spark, d):
    return _increments(spark, d).select("seed", *[r6(c).alias(c) for c in ("small", "joint", "increment")])


@query(f"WITH {_ENT}, {_REPS}, s AS (SELECT r, share, corr(lag, size) AS s FROM (SELECT *, unnest([0.25, 0.5, 1.0])::DOUBLE AS share FROM ent, reps) WHERE {_KEY.format(k='entity')} < share * 10007 GROUP BY r, share) SELECT share, {q6('avg(s)')} AS mean, {q6('stddev_samp(s)')} AS sd, count(*) AS n FROM s GROUP BY share")
def k10_subsample_curve(spark, d):
    x = resample.subsample_curve(_entities(spark, d), "entity", F.corr("lag", "size"), [0.25, 0.5, 1.0], R, _ORDER)
    return x.select("share", r6("mean").alias("mean"), r6("sd").alias("sd"), "n")


@query(f"WITH {_ENT}, m AS (SELECT 'control' AS metric, abs(corr(lag, lag + size / 1000)) AS v FROM ent UNION ALL SELECT 'size', abs(corr(lag, size)) FROM ent UNION ALL SELECT 'weeks', abs(corr(lag, weeks)) FROM ent) SELECT metric, {q6('v')} AS v, (SELECT v FROM m WHERE metric = 'control') >= 0.5 AS valid FROM m WHERE metric <> 'control'")
def k11_positive_control(spark, d):
    e = _entities(spark, d)
    one = e.agg(F.abs(F.corr("lag", F.col("lag") + F.col("size") / 1000)).alias("control"), F.abs(F.corr("lag", "size")).alias("size"), F.abs(F.corr("lag", "weeks")).alias("weeks"))
    return resample.gate(one.unpivot([], ["control", "size", "weeks"], "metric", "v"), "control", "metric", "v", 0.5).select("metric", r6("v").alias("v"), "valid")


@query(f"""WITH {_ENT}, {_REPS_P}, {_moved()},
 n AS (SELECT unnest([round_even(abs(corr(a.size, b.lag)), 9), round_even(abs(corr(a.weeks, b.lag)), 9), round_even(abs(corr(a.percentile, b.lag)), 9)]) AS s FROM a JOIN num b ON b.i = a.j GROUP BY a.r), o AS (SELECT unnest([round_even(abs(corr(size, lag)), 9), round_even(abs(corr(weeks, lag)), 9), round_even(abs(corr(percentile, lag)), 9)]) AS s FROM ent),
 k AS (SELECT max(abs((SELECT avg((o.s <= x.s)::INT) FROM o) - (SELECT avg((n.s <= x.s)::INT) FROM n))) AS ks FROM (SELECT s FROM n UNION ALL SELECT s FROM o) x)
SELECT {q6('(SELECT quantile_cont(s, 0.5) FROM o)')} AS real_median, {q6('(SELECT quantile_cont(s, 0.9) FROM o)')} AS real_p90, {q6('(SELECT max(s) FROM o)')} AS real_largest, {q6('(SELECT quantile_cont(s, 0.5) FROM n)')} AS null_median, {q6('(SELECT quantile_cont(s, 0.9) FROM n)')} AS null_p90, {q6('(SELECT max(s) FROM n)')} AS null_largest, {q6('ks')} AS ks FROM k""")
def k12_matched_null(spark, d):
    """|r| of all variables against the same of shuffled targets: quantiles of both, and the distance of their distributions."""
    from panelforge.operators.inference import null_distance

    names = ["size", "weeks", "percentile"]
    stats = lambda target: [F.bround(F.abs(F.corr(c, target)), 9).alias(c) for c in names]
    e = cut(_entities(spark, d))
    real = e.agg(*stats("lag")).unpivot([], names, "variable", "s")
    null = resample.permuted(e, "entity", "lag", RP).groupBy("replicate").agg(*stats("lag_perm")).unpivot(["replicate"], names, "variable", "s")
    x = null_distance(real, null)
    return x.select(*[r6(c).alias(c) for c in x.columns])


@query(f"WITH {_ENT}, {_REPS}, h AS (SELECT r, ({_KEY.format(k='entity')}) % 2 AS half, unnest(['size', 'weeks', 'percentile']) AS variable, unnest([corr(lag, size), corr(lag, weeks), corr(lag, percentile)]) AS c FROM ent, reps GROUP BY r, half), pick AS (SELECT r, arg_max(variable, abs(c)) AS variable FROM h WHERE half = 0 GROUP BY r) SELECT p.variable, count(*) AS selected, {q6('avg(abs(h.c))')} AS tested FROM pick p JOIN h ON h.r = p.r AND h.variable = p.variable AND h.half = 1 GROUP BY p.variable")
def k13_repeated_split(spark, d):
    """Pick the strongest variable on one half, test it on the other, over many splits."""
    names = ["size", "weeks", "percentile"]
    x = resample.replicated(_entities(spark, d), R).withColumn("half", _ORDER("replicate", "entity") % 2)
    h = x.groupBy("replicate", "half").agg(*[F.corr("lag", c).alias(c) for c in names]).unpivot(["replicate", "half"], names, "variable", "c")
    pick = h.where("half = 0").groupBy("replicate").agg(F.max_by("variable", F.abs(F.col("c"))).alias("variable"))
    return pick.join(h.where("half = 1"), ["replicate", "variable"]).groupBy("variable").agg(F.count("*").alias("selected"), r6(F.avg(F.abs(F.col("c")))).alias("tested"))


_AXES = f"""{FRAMES}, ent AS (SELECT entity, avg(list_sum(list_transform(emb[1:32], lambda x: CAST(x AS DOUBLE)))) AS first, avg(list_sum(list_transform(emb[33:64], lambda x: CAST(x AS DOUBLE)))) AS second,
 CASE WHEN entity % 5 > 0 THEN avg(y) END AS size, CASE WHEN entity % 7 > 0 THEN CAST(avg(stratum) > 4.5 AS INTEGER) END AS late, max(x1) AS peak FROM frames GROUP BY entity)"""


@query(f"""WITH {_AXES}, {_REPS_P}, long AS (SELECT entity, first, second, unnest([{{'anchor': 'size', 'metric': 'r', 'y': CAST(size AS DOUBLE)}}, {{'anchor': 'late', 'metric': 'auc', 'y': CAST(late AS DOUBLE)}}, {{'anchor': 'peak', 'metric': 'r', 'y': peak}}]) AS s FROM ent),
l AS (SELECT entity, s.anchor AS anchor, s.metric AS metric, s.y AS y, first, second FROM long WHERE s.y IS NOT NULL),
m AS (UNPIVOT (SELECT * FROM l) ON first, second INTO NAME axis VALUE z),
num AS (SELECT *, row_number() OVER (PARTITION BY anchor, axis ORDER BY entity) AS i, count(*) OVER (PARTITION BY anchor, axis) AS of_n FROM m),
a AS (SELECT num.*, r, {partner_sql('i', 'of_n', 'r')} AS j FROM num, (SELECT r FROM reps)),
e AS (SELECT axis, anchor, metric, z, y, 0 AS r FROM num UNION ALL SELECT a.axis, a.anchor, a.metric, a.z, b.y, a.r FROM a JOIN num b ON b.anchor = a.anchor AND b.axis = a.axis AND b.i = a.j),
k AS (SELECT *, rank() OVER (PARTITION BY axis, anchor, r ORDER BY z) + (count(*) OVER (PARTITION BY axis, anchor, r, z) - 1) / 2.0 AS k FROM e),
v AS (SELECT axis, anchor, metric, r, count(*) AS n, CASE WHEN metric = 'auc' THEN (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) ELSE corr(z, y) END AS value FROM k GROUP BY axis, anchor, metric, r),
w AS (SELECT *, abs(value - CASE WHEN metric = 'auc' THEN 0.5 ELSE 0.0 END) AS far FROM v)
SELECT o.axis, o.anchor, o.metric, {q6('o.value')} AS value, {q6(f'(1 + count_if(w.far >= o.far - 1e-9)) / {RP + 1}.0')} AS p, o.n FROM w o JOIN w ON w.axis = o.axis AND w.anchor = o.anchor AND w.r > 0 WHERE o.r = 0 GROUP BY o.axis, o.anchor, o.metric, o.value, o.n""")
def k14_axis_anchors(spark, d):
    """Two axes over whole vectors against anchors that some entities lack: r or AUC by kind, with permutation p."""
    half = lambda at: F.avg(F.aggregate(F.slice("emb", at, 32), F.lit(0.0), lambda s, v: s + v.cast("double")))
    e = frames(spark, d).groupBy("entity").agg(half(1).alias("first"), half(33).alias("second"), F.avg("y").alias("size"), (F.avg("stratum") > 4.5).cast("int").alias("late"), F.max("x1").alias("peak"))
    e = e.withColumns({"size": F.when(F.col("entity") % 5 > 0, F.col("size")), "late": F.when(F.col("entity") % 7 > 0, F.col("late"))})
    x = resample.anchored(e, "entity", ["first", "second"], {"size": "r", "late": "auc", "peak": "r"}, RP)
    return x.select("axis", "anchor", "metric", r6("value").alias("value"), r6("p").alias("p"), "n")
