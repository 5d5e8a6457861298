"""G: sorts, top-k, sampling, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.fixtures import CODES, ENTITY_LAG, FRAMES, SHOTS, codes, entity_lag, frames, shots
from panelforge.operators import panel, sampling, vectors
from panelforge.registry import q6, query, r6, table


@query(f"WITH {SHOTS}, k AS (SELECT *, row_number() OVER (PARTITION BY entity, source ORDER BY l_orderkey, l_linenumber, part, study, lag, weeks) > 1 AS dup FROM shots) SELECT dup AS is_duplicate, count(*) AS n FROM k GROUP BY dup")
def g01_duplicate_flag(spark, d):
    x = panel.duplicate_flag(shots(spark, d), ["entity", "source"], ["l_orderkey", "l_linenumber", "part", "study", "lag", "weeks"])
    return x.groupBy("is_duplicate").agg(F.count("*").alias("n"))


@query(f"WITH {SHOTS} SELECT source, count(*) AS n, {q6('avg(lag)')} AS lag FROM shots WHERE source IN (SELECT source FROM shots GROUP BY source ORDER BY count(*) DESC, source LIMIT 5) GROUP BY source")
def g02_top_groups(spark, d):
    return sampling.top_groups(shots(spark, d), "source", 5).groupBy("source").agg(F.count("*").alias("n"), r6(F.avg("lag")).alias("lag"))


@query(f"WITH {FRAMES}, t AS (SELECT frame, p, list_transform(emb[8 * p + 1 : 8 * p + 8], lambda x: CAST(x AS DOUBLE)) AS tok FROM frames, range(8) r(p)), s AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY abs(list_inner_product(tok, [-3.5, -2.5, -1.5, -0.5, 0.5, 1.5, 2.5, 3.5]::DOUBLE[])) DESC) AS r FROM t) SELECT frame, " + ", ".join(f"{q6(f'avg(tok[{i + 1}])')} AS m{i}" for i in range(8)) + " FROM s WHERE r <= 3 GROUP BY frame")
def g03_top_patches(spark, d):
    import numpy as np

    x = vectors.with_pooled(frames(spark, d).select("frame", "emb"), "emb", {"top": vectors.top_patches(3, np.arange(8) - 3.5)}, 8)
    return x.select("frame", *[r6(F.col("top")[i]).alias(f"m{i}") for i in range(8)])


_CENTRE = "c AS (SELECT stratum, avg(x1) AS c1, avg(x2) AS c2, avg(x3) AS c3 FROM frames GROUP BY stratum)"


@query(f"WITH {FRAMES}, {_CENTRE}, d AS (SELECT frame, stratum, row_number() OVER (PARTITION BY stratum ORDER BY pow(x1 - c1, 2) + pow(x2 - c2, 2) + pow(x3 - c3, 2), frame) AS r FROM frames JOIN c USING (stratum)) SELECT stratum, frame, CAST(r AS INTEGER) AS rank FROM d WHERE r <= 12")
def g04_exemplars(spark, d):
    from pyspark.sql.window import Window

    f = frames(spark, d)
    c = f.groupBy("stratum").agg(*[F.avg(x).alias(f"c_{x}") for x in ("x1", "x2", "x3")])
    gap = sum(F.pow(F.col(x) - F.col(f"c_{x}"), F.lit(2.0)) for x in ("x1", "x2", "x3"))
    return f.join(c, "stratum").withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy(gap, "frame"))).where("rank <= 12").select("stratum", "frame", "rank")


@query(f"WITH {ENTITY_LAG} SELECT grp, entity, CAST(round_even(lag, 3) AS DOUBLE) + 0.0 AS lag FROM entity_lag ORDER BY grp, lag, entity")
def g05_sorted_result(spark, d):
    return entity_lag(spark, d).select("grp", "entity", (F.bround("lag", 3) + 0.0).alias("lag")).orderBy("grp", "lag", "entity")


@query(f"WITH {SHOTS}, e AS (SELECT source, stratum, avg(lag) AS effect FROM shots GROUP BY ALL) SELECT source, stratum, {q6('effect')} AS effect FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(effect) DESC, stratum) AS r FROM e) WHERE r = 1")
def g06_strongest_effect(spark, d):
    e = shots(spark, d).groupBy("source", "stratum").agg(F.avg("lag").alias("effect"))
    return sampling.strongest(e, ["source"], "effect", "stratum").select("source", "stratum", r6("effect").alias("effect"))


@query(f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY frame * 7919 % 10007, frame) AS r FROM frames) SELECT entity, frame FROM r WHERE r <= 3")
def g07_capped_sample(spark, d):
    return sampling.capped(frames(spark, d), ["entity"], F.col("frame") * 7919 % 10007, "frame", 3).select("entity", "frame")


@query(f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY frame * 7919 % 10007, frame) AS r FROM frames), k AS (SELECT entity, frame, row_number() OVER (ORDER BY frame * 7919 % 10007, frame) AS k FROM r WHERE r <= 3) SELECT entity, frame FROM k WHERE k <= 100")
def g07_capped_overall(spark, d):
    """A cap for each entity, then one for all."""
    return sampling.capped(frames(spark, d), ["entity"], F.col("frame") * 7919 % 10007, "frame", 3, 100).select("entity", "frame")


@query(f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY frame * 7919 % 10007, frame) - 1 AS r, count(*) OVER (PARTITION BY entity) AS n FROM frames)
SELECT entity, frame, CAST(draw AS INTEGER) AS draw FROM (SELECT entity, frame, unnest(range(r, 8, n)) AS draw FROM r WHERE r < 8)""")
def g08_exact_budget(spark, d):
    return sampling.exactly(frames(spark, d), ["entity"], F.col("frame") * 7919 % 10007, "frame", 8).select("entity", "frame", "draw")


@query(f"WITH {CODES} SELECT code, count(*) AS n FROM codes WHERE (frame * 7919 + patch * 104729) % 10007 < 2000 GROUP BY code")
def g09_fraction_sample(spark, d):
    return codes(spark, d).where((F.col("frame") * 7919 + F.col("patch") * 104729) % 10007 < 2000).groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY frame * 7919 % 10007, frame) AS r FROM frames) SELECT entity, max(frame) FILTER (r = 1) AS a, coalesce(max(frame) FILTER (r = 2), max(frame) FILTER (r = 1)) AS b FROM r GROUP BY entity")
def g10_entity_pair(spark, d):
    x = sampling.capped(frames(spark, d), ["entity"], F.col("frame") * 7919 % 10007, "frame", 2).withColumn("k", F.struct(F.col("frame") * 7919 % 10007, "frame"))
    return x.groupBy("entity").agg(F.min_by("frame", "k").alias("a"), F.max_by("frame", "k").alias("b"))


@query("SELECT doc_id, min(origin) AS origin FROM (SELECT doc_id, 'a' AS origin FROM documents UNION ALL SELECT doc_id, 'b' FROM labels) GROUP BY doc_id")
def g11_cohort_union(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.lit("a").alias("origin"))
    b = table(spark, d, "labels").select("doc_id", F.lit("b").alias("origin"), "quality")
    return panel.keep_first(a.unionByName(b, allowMissingColumns=True), ["doc_id"], ["origin"]).select("doc_id", "origin")


@query("SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'only' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def g12_set_operations(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return a.intersect(b).withColumn("side", F.lit("both")).unionAll(a.subtract(b).withColumn("side", F.lit("only")))


@query()
def g13_greedy_decorrelation(spark, d):
    import numpy as np

    from panelforge.operators.linear import covariance

    names, cov = covariance(frames(spark, d), "emb")
    sd = np.sqrt(np.diag(cov))
    r = cov / sd[:, None] / sd[None, :]

    def redundant(kept, c):
        at = [*kept, c]
        return np.linalg.eigvalsh(r[np.ix_(at, at)])[0] <= 0.2

    kept = sampling.greedy_keep(range(len(names)), redundant)
    return spark.createDataFrame([(int(k), i) for i, k in enumerate(kept)], "dim int, position int")


@query(f"WITH {SHOTS}, e AS (SELECT stratum, source, avg(lag) AS effect FROM shots GROUP BY ALL) SELECT stratum, source, CAST(r AS INTEGER) AS rank, {q6('effect')} AS effect FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY abs(effect) DESC, source) AS r FROM e) WHERE r <= 8")
def g06_effect_profile(spark, d):
    """The eight strongest sources of each stratum."""
    e = shots(spark, d).groupBy("stratum", "source").agg(F.avg("lag").alias("effect"))
    return sampling.strongest(e, ["stratum"], "effect", "source", 8).select("stratum", "source", "rank", r6("effect").alias("effect"))


@query(f"WITH {SHOTS}, e AS (SELECT stratum, source, avg(lag) AS effect FROM shots GROUP BY ALL), f AS (SELECT stratum, avg(abs(effect)) AS strength FROM e GROUP BY stratum) SELECT stratum, {q6('strength')} AS strength, CAST(row_number() OVER (ORDER BY strength DESC, stratum) AS INTEGER) AS rank FROM f")
def g06_family_ranking(spark, d):
    """Families (strata) by their mean absolute effect."""
    e = shots(spark, d).groupBy("stratum", "source").agg(F.avg("lag").alias("effect"))
    return sampling.families(e, "stratum", "effect").select("stratum", r6("strength").alias("strength"), "rank")
