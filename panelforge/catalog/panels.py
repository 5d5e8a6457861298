"""D: panels and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.catalog.fixtures import CELLS, FRAMES, MEASURES, OUTCOMES, VISITS, WIDE, cells, frames, outcomes, visits, wide
from panelforge.operators import inference, panel
from panelforge.registry import q6, query, r6, table

_NAMES = [f"{v}:{m}" for v in range(4) for m in MEASURES]


def _panel(spark, d):
    c = cells(spark, d).withColumn("name", F.concat(F.col("visit").cast("string"), F.lit(":"), "measure"))
    return panel.pivot_cells(c, ["entity"], "name", _NAMES, "value")


_PANEL = CELLS + ", panel AS (SELECT entity, " + ", ".join(f"max(value) FILTER (visit = {n[0]} AND measure = '{n[2:]}') AS \"{n}\"" for n in _NAMES) + " FROM cells GROUP BY entity)"


@query(f"WITH {_PANEL}, {OUTCOMES}, k AS (SELECT user_id AS entity, min_by(value, event_id) FILTER (value >= 1) AS constant FROM events GROUP BY 1) SELECT entity, grp, {q6('constant')} AS constant, " + ", ".join(f"{q6(chr(34) + n + chr(34))} AS v{i}" for i, n in enumerate(_NAMES)) + " FROM panel LEFT JOIN outcomes USING (entity) LEFT JOIN k USING (entity)")
def d01_load_panel(spark, d):
    first = visits(spark, d).groupBy("entity").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("event_id"))).alias("constant"))
    p = panel.align(_panel(spark, d), [_panel(spark, d), outcomes(spark, d), first], "entity")
    return p.select("entity", "grp", r6("constant").alias("constant"), *[r6(F.col(f"`{n}`")).alias(f"v{i}") for i, n in enumerate(_NAMES)])


@query(f"WITH {_PANEL} SELECT entity, " + ", ".join(f"{q6(chr(34) + n + chr(34))} AS \"{n[0]}_{n[2:]}\"" for n in _NAMES if n[0] in "01") + " FROM panel")
def d02_flatten(spark, d):
    return _panel(spark, d).select("entity", *[r6(F.col(f"`{n}`")).alias(f"{n[0]}_{n[2:]}") for n in _NAMES if n[0] in "01"])


_SETS = {"core": ["click", "error"], "all": MEASURES}


@query("WITH " + WIDE + " " + " UNION ALL ".join(f"SELECT '{k}' AS feature_set, count(*) AS n, {len(v)} AS features, {q6('avg((' + ' + '.join(f'({c} IS NOT NULL)::INT' for c in v) + f') / {len(v)}.0)')} AS observed, count_if({' AND '.join(f'{c} IS NOT NULL' for c in v)}) AS complete FROM wide" for k, v in _SETS.items()))
def d03_coverage(spark, d):
    return panel.coverage(wide(spark, d), _SETS).withColumn("observed", r6("observed"))


@query(f"WITH {CELLS} SELECT entity, " + ", ".join(f"{q6(f'max(value) FILTER (visit = {v})')} AS visit_{v}" for v in range(4)) + " FROM cells WHERE measure = 'view' GROUP BY entity")
def d04_visit_matrix(spark, d):
    m = panel.pivot_cells(cells(spark, d).where("measure = 'view'"), ["entity"], "visit", [0, 1, 2, 3], "value", "visit_")
    return m.select("entity", *[r6(f"visit_{v}").alias(f"visit_{v}") for v in range(4)])


@query("SELECT entity, a, c FROM (SELECT c_custkey AS entity, CASE WHEN c_custkey % 50 > 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS b, CASE WHEN c_custkey % 30 <> 3 THEN c_nationkey END AS c FROM customer) WHERE a IS NOT NULL AND c IS NOT NULL")
def d05_dense_prune(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(k.alias("entity"), F.when(k % 50 > 0, F.col("c_acctbal")).alias("a"), F.when(k % 4 > 0, F.col("c_acctbal")).alias("b"), F.when(k % 30 != 3, F.col("c_nationkey")).alias("c"))
    return t.select("entity", *panel.dense_columns(t, ["a", "b", "c"])).dropna()


@query(f"WITH {CELLS} SELECT entity, CAST(max(visit) + 1 AS INTEGER) AS length, count(value) AS observed, " + ", ".join(f"{q6(f'max(value) FILTER (visit = {v})')} AS s{v}" for v in range(4)) + " FROM cells WHERE measure = 'click' GROUP BY entity")
def d06_slot_sequence(spark, d):
    c = cells(spark, d).where("measure = 'click'")
    w = panel.pivot_cells(c, ["entity"], "visit", [0, 1, 2, 3], "value", "s")
    last = c.groupBy("entity").agg((F.max("visit") + 1).cast("int").alias("length"), F.count("value").alias("observed"))
    return last.join(w, "entity").select("entity", "length", "observed", *[r6(f"s{v}").alias(f"s{v}") for v in range(4)])


@query(f"""WITH {FRAMES}, b AS (SELECT entity, stratum AS week, count(*) AS n, avg(CAST(emb[1] AS DOUBLE)) AS m0, avg(CAST(emb[64] AS DOUBLE)) AS m63 FROM frames GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, week) AS r FROM b)
SELECT entity, week, n, {q6('m0')} AS m0, {q6('m63')} AS m63 FROM r WHERE r <= 8""")
def d07_image_sequence(spark, d):
    from panelforge.operators.vectors import mean_by

    f = frames(spark, d).withColumn("week", F.col("stratum"))
    m = mean_by(f, ["entity", "week"], "emb")
    return panel.largest_weeks(m, "entity", "week", "n").select("entity", "week", "n", r6(F.col("mean")[0]).alias("m0"), r6(F.col("mean")[63]).alias("m63"))


@query(f"""WITH {VISITS}, u AS (SELECT DISTINCT entity, day FROM visits WHERE measure IN ('click', 'view')), x AS (SELECT entity, day, row_number() OVER (PARTITION BY entity ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM u)
SELECT entity, day FROM x WHERE n <= 12 OR list_contains(list_transform(range(12), lambda j: j * (n - 1) // 11), i)""")
def d08_merged_timeline(spark, d):
    u = visits(spark, d).where("measure in ('click', 'view')").select("entity", "day").distinct()
    return panel.thin_evenly(u, "entity", "day", 12)


@query(f"WITH {FRAMES} SELECT entity, stratum, CAST(i AS INTEGER) AS dim, {q6('quantile_cont(CAST(emb[i + 1] AS DOUBLE), 0.5)')} AS median FROM frames, range(64) r(i) GROUP BY ALL")
def d09_vector_median(spark, d):
    from panelforge.operators.vectors import median_by

    m = median_by(frames(spark, d), ["entity", "stratum"], "emb")
    return m.select("entity", "stratum", F.posexplode("median").alias("dim", "v")).select("entity", "stratum", "dim", r6("v").alias("median"))


@query(f"WITH {CELLS} SELECT entity, {q6('avg(value)')} AS size FROM cells GROUP BY entity")
def d10_size_proxy(spark, d):
    return cells(spark, d).groupBy("entity").agg(r6(F.avg("value")).alias("size"))


@query("""WITH x AS (SELECT 'name' AS col, p_name AS v FROM part UNION ALL SELECT 'size', CASE WHEN p_size > 5 THEN CAST(p_size AS VARCHAR) END FROM part UNION ALL SELECT 'one', 'k' FROM part)
SELECT col, """ + q6("avg((v IS NOT NULL)::INT)") + """ AS coverage, count(DISTINCT v) AS levels, count(DISTINCT v) <= 1 AS constant FROM x GROUP BY col""")
def d11_registry_profile(spark, d):
    p = table(spark, d, "part")
    rows = F.array(F.struct(F.lit("name").alias("col"), F.col("p_name").alias("v")), F.struct(F.lit("size").alias("col"), F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).alias("v")), F.struct(F.lit("one").alias("col"), F.lit("k").alias("v")))
    return panel.profile(p.select(F.inline(rows)), "col", "v").withColumn("coverage", r6("coverage"))


@query("WITH p AS (SELECT p_size::DOUBLE AS a, p_retailprice::DOUBLE AS b, p_size * 2.0 + 1 AS c, -p_retailprice::DOUBLE AS d, (p_partkey * 7919 % 997)::DOUBLE AS e FROM part), r AS (SELECT abs(corr(a, b)) AS ab, abs(corr(a, c)) AS ac, abs(corr(b, c)) AS bc, abs(corr(a, d)) AS ad, abs(corr(b, d)) AS bd, abs(corr(a, e)) AS ae, abs(corr(b, e)) AS be FROM p) SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS col, unnest([NULL, CASE WHEN ab > 0.999 THEN 'a' END, CASE WHEN ac > 0.999 THEN 'a' WHEN bc > 0.999 THEN 'b' END, CASE WHEN ad > 0.999 THEN 'a' WHEN bd > 0.999 THEN 'b' END, CASE WHEN ae > 0.999 THEN 'a' WHEN be > 0.999 THEN 'b' END]) AS duplicate_of FROM r")
def d11_duplicate_columns(spark, d):
    """Columns of a registry that repeat an earlier one."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    p = table(spark, d, "part").select(size.alias("a"), price.alias("b"), (size * 2 + 1).alias("c"), (-price).alias("d"), (F.col("p_partkey") * 7919 % 997).cast("double").alias("e"))
    names = list("abcde")
    found = inference.duplicate_columns(inference.pairwise_covariance(p, names), names)
    return spark.createDataFrame([(c, found.get(c)) for c in names], "col string, duplicate_of string")
