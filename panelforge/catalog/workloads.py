"""L and W: streaming jobs run to completion, and the workloads end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.aggregates import SPARSE, _shares, sparse_codes
from panelforge.catalog.cleaning import _FILES, _IDS, _RAW, _files, _ids, _raw
from panelforge.catalog.fixtures import CODES, MEASURES, OUTCOMES, VISITS, codes, frames, outcomes, visits
from panelforge.operators.aggregate import random_effects
from panelforge.operators.lineage import scratch
from panelforge.plans import jobs
from panelforge.registry import q6, query, r6, table
from panelforge.streaming import incremental


def _stream(spark, d):
    t = table(spark, d, "events")
    return spark.readStream.schema(t.schema).parquet(f"{d}/events.parquet*").withColumn("time", F.col("ts").cast("timestamp"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids, CAST(sum(event_id) AS BIGINT) AS total FROM (SELECT DISTINCT event_id FROM events)")
def l01_incremental_ingest(spark, d):
    """Twice over the same files: what is in the sink stays as it is."""
    path, check = scratch(spark, "ingest"), scratch(spark, "ingest-state")
    for _ in range(2):
        s = incremental.deduplicated(_stream(spark, d), "time", "event_id").select("event_id", "time")
        incremental.to_table(s, path, check).awaitTermination()
    x = spark.read.schema("event_id long, time timestamp").parquet(path)
    return x.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.sum("event_id").alias("total"))


@query(f"SELECT event_type, {q6('avg(value)')} AS mean, count(*) AS n, CAST(epoch(time_bucket(INTERVAL '5 days', ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start FROM events GROUP BY event_type, time_bucket(INTERVAL '5 days', ts, TIMESTAMP '1970-01-01') HAVING count(*) >= 20")
def l02_drift_monitor(spark, d):
    """The tumbling-window monitor as a stream with a watermark, in update mode into a table."""
    path, check = scratch(spark, "drift"), scratch(spark, "drift-state")
    incremental.drift_to_table(_stream(spark, d), "time", "event_type", "value", path, check).awaitTermination()
    parts = spark.read.schema("start timestamp, event_type string, mean double, n long, epoch int").parquet(path)
    return incremental.latest_drift(parts, "event_type").select("event_type", r6("mean").alias("mean"), "n", F.unix_seconds("start").alias("start"))


@query(f"SELECT event_type, count(value) AS n, {q6('sum(value)')} AS s, {q6('sum(value * value)')} AS ss FROM events GROUP BY event_type")
def l03_running_sums(spark, d):
    path, check = scratch(spark, "sums"), scratch(spark, "sums-state")
    incremental.merge_sums(_stream(spark, d), "event_type", "value", path, check).awaitTermination()
    return incremental.latest_sums(spark, path, "event_type string, n long, s double, ss double").select("event_type", "n", r6("s").alias("s"), r6("ss").alias("ss"))


_NAMES = [f"{s}_{m}" for s in range(4) for m in MEASURES]


@query(f"WITH {VISITS}, {OUTCOMES}, w AS (SELECT entity, " + ", ".join(f"avg(value) FILTER (visit = {n[0]} AND measure = '{n[2:]}') AS \"{n}\"" for n in _NAMES) + ", " + ", ".join(f"regr_slope(value, t) FILTER (measure = '{m}') AS slope_{m}" for m in MEASURES) + f", count(value) AS observed FROM visits GROUP BY entity) SELECT entity, observed, grp, {q6('(' + ' + '.join(f'({chr(34)}{n}{chr(34)} IS NOT NULL)::INT' for n in _NAMES) + ') / 20.0')} AS coverage, " + ", ".join(f"{q6(chr(34) + n + chr(34))} AS \"{n}\"" for n in _NAMES) + ", " + ", ".join(f"{q6(f'slope_{m}')} AS slope_{m}" for m in MEASURES) + " FROM w LEFT JOIN outcomes USING (entity)")
def w1_entity_panel(spark, d):
    p = jobs.entity_panel(visits(spark, d), outcomes(spark, d), range(4), MEASURES)
    return p.select("entity", "observed", "grp", r6("coverage").alias("coverage"), *[r6(F.col(n)).alias(n) for n in _NAMES], *[r6(f"slope_{m}").alias(f"slope_{m}") for m in MEASURES])


@query()
def w2_clock_lag(spark, d):
    x = jobs.clock_lag(frames(spark, d), "emb", "y", "entity", outcomes(spark, d), 6, 42)
    return x.select("entity", "n", "grp", r6("lag").alias("lag"), r6("debiased").alias("debiased"))


_RANKS = "rank() OVER (PARTITION BY code ORDER BY {0}) + (count(*) OVER (PARTITION BY code, {0}) - 1) / 2.0"


def _effects(rows: str) -> str:
    """Effect of each code: rank correlation of its log-ratio with the score, over all entities."""
    return f"""{_shares(rows)}, c AS (SELECT entity, code, ln(greatest(share / sum(share) OVER (PARTITION BY entity), 1e-6)) AS l, entity * 7919 % 1009 AS score FROM shares),
 l AS (SELECT entity, code, score, l - avg(l) OVER (PARTITION BY entity) AS clr FROM c), k AS (SELECT code, {_RANKS.format('clr')} AS a, {_RANKS.format('score')} AS b FROM l) SELECT code, CAST(round_even(corr(a, b), 3) AS DOUBLE) + 0.0 AS effect, count(*) AS n FROM k GROUP BY code"""


def _scores(c):
    return c.select("entity").distinct().withColumn("score", F.col("entity") * 7919 % 1009)


@query(f"WITH {CODES}, {_effects('codes')}")
def w3_code_effects(spark, d):
    c = codes(spark, d)
    return jobs.code_effects(c, _scores(c), 20).select("code", (F.bround("effect", 3) + 0.0).alias("effect"), "n")


@query(f"WITH {SPARSE}, {_effects('sparse')}")
def w3_absent_codes(spark, d):
    """The same where entities lack codes: their zeros take part."""
    c = sparse_codes(spark, d)
    return jobs.code_effects(c, _scores(c), 20).select("code", (F.bround("effect", 3) + 0.0).alias("effect"), "n")


@query()
def w3_code_significance(spark, d):
    """Permutation p and adjusted q of every code, over 1000 replicates, and the pooled effect of all."""
    c = codes(spark, d)
    x = jobs.code_effects(c, _scores(c), 1000).withColumns({"all": F.lit("all"), "variance": 1 / (F.col("n") - 3.0)})
    meta = random_effects(x, ["all"], "effect", "variance").select("pooled", "se", "tau2")
    return x.crossJoin(F.broadcast(meta)).select("code", "n", *[r6(v).alias(v) for v in ("effect", "p", "q", "pooled", "se", "tau2")])


@query(f"""WITH {_IDS}, {_FILES}, x AS (SELECT f.id, f.header, f.file, i.folder, i.pid, i.name FROM files f JOIN ids i ON i.id = f.id), n AS (SELECT *, coalesce(TRY_CAST(regexp_extract(pid, '(?i)IMP[ACT]*\\s*(\\d+)', 1) AS BIGINT), TRY_CAST(regexp_extract(name, '(?i)IMP[ACT]*\\s*(\\d+)', 1) AS BIGINT)) AS k, regexp_replace(folder, '(_ok|_SI|_NO)$', '') AS bare FROM x),
 e AS (SELECT id, CASE WHEN k IS NOT NULL THEN printf('IMP%04d', k) WHEN regexp_full_match(bare, '\\d+') THEN 'NHC_' || bare ELSE bare END AS entity, coalesce(nullif(header, ''), CASE WHEN regexp_matches(file, '^\\d{{8}}\\.') THEN file[1:8] END, folder) AS study_date, regexp_replace(regexp_replace(regexp_replace(file, '\\.png$', ''), '_(debug|overlay|mask)$', ''), '^\\d+_(NHC_\\d+_)?', '') AS key FROM n)
SELECT id, entity, study_date, key, quality, row_number() OVER (PARTITION BY entity, study_date, key ORDER BY id) > 1 AS is_duplicate FROM e LEFT JOIN (SELECT doc_id AS id, min(quality) AS quality FROM labels GROUP BY 1) USING (id)""")
def w4_file_catalogue(spark, d):
    f = _files(spark, d).drop("folder").join(_ids(spark, d), "id")
    labels = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    return jobs.file_catalogue(f, labels).select("id", "entity", "study_date", "key", "quality", "is_duplicate")


@query(f"""WITH {_RAW}, x AS (SELECT *, TRY_CAST(trim(raw) AS DOUBLE) AS plain, TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE) AS other FROM raw), u AS (SELECT col, count(other) > 1.5 * count(plain) AS eu FROM x GROUP BY col), v AS (SELECT id, col, CASE WHEN eu THEN other ELSE plain END AS value, id * 7919 % 997 AS target FROM x JOIN u USING (col))
SELECT col, {q6('corr(value, target)')} AS r, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY col HAVING count(*) >= 50 AND stddev_pop(value) > 0""")
def w5_registry_screen(spark, d):
    raw = _raw(spark, d)
    target = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 997).alias("target"))
    return jobs.registry_screen(raw, target, "col", "raw", "id").select("col", r6("r").alias("r"), "n")
