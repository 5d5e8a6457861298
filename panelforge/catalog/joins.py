"""C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.fixtures import OUTCOMES, SHOTS, VISITS, outcomes, shots, visits
from panelforge.operators import panel
from panelforge.registry import q6, query, r6, table


@query(f"WITH {OUTCOMES} SELECT e.entity, o.grp, {q6('o.percentile')} AS percentile, x.n FROM (SELECT DISTINCT user_id AS entity FROM events) e LEFT JOIN outcomes o USING (entity) LEFT JOIN (SELECT o_custkey AS entity, count(*) AS n FROM orders GROUP BY 1) x USING (entity)")
def c01_align_to_spine(spark, d):
    spine = table(spark, d, "events").select(F.col("user_id").alias("entity"))
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("n"))
    return panel.align(spine, [outcomes(spark, d), n], "entity").select("entity", "grp", r6("percentile").alias("percentile"), "n")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def c02_label_lookup(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")


@query(f"WITH {SHOTS}, tags AS (SELECT part, source FROM (SELECT part, source, row_number() OVER (PARTITION BY part ORDER BY study, l_orderkey, l_linenumber, source) AS r FROM shots) WHERE r = 1) SELECT source, count(*) AS n FROM lineitem JOIN tags ON l_partkey = part GROUP BY source")
def c03_frames_with_tags(spark, d):
    tags = panel.keep_first(shots(spark, d), ["part"], ["study", "l_orderkey", "l_linenumber", "source"]).select("part", "source")
    return table(spark, d, "lineitem").join(tags, F.col("l_partkey") == F.col("part")).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {OUTCOMES}, n AS (SELECT o_custkey AS entity, count(*) AS orders FROM orders GROUP BY 1), e AS (SELECT user_id AS entity, count(*) AS events FROM events GROUP BY 1) SELECT entity, grp, coalesce(orders, 0) AS orders, coalesce(events, 0) AS events, events IS NOT NULL AS has_events FROM outcomes LEFT JOIN n USING (entity) LEFT JOIN e USING (entity)")
def c04_counts_and_flags(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("orders"))
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("entity")).agg(F.count("*").alias("events"))
    x = outcomes(spark, d).join(n, "entity", "left").join(e, "entity", "left")
    return x.select("entity", "grp", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("events", F.lit(0)).alias("events"), F.col("events").isNotNull().alias("has_events"))


@query("SELECT c_custkey AS entity FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def c05_panel_intersection(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("entity")).join(e, "entity", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def c06_reject_exclusion(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality = 0"), "doc_id", "left_anti")


_BINS = "bins AS (SELECT entity, day, avg(value) AS value FROM visits WHERE measure = 'click' AND value IS NOT NULL GROUP BY ALL), slots AS (SELECT DISTINCT entity, day AS slot FROM visits WHERE measure = 'view')"


def _bins(spark, d):
    v = visits(spark, d)
    bins = v.where("measure = 'click' and value is not null").groupBy("entity", "day").agg(F.avg("value").alias("value"))
    return v.where("measure = 'view'").select("entity", F.col("day").alias("slot")).distinct(), bins


@query(f"WITH {VISITS}, {_BINS} SELECT s.entity, s.slot, {q6('coalesce(a.value, b.value, c.value)')} AS value FROM slots s LEFT JOIN bins a ON a.entity = s.entity AND a.day = s.slot LEFT JOIN bins b ON b.entity = s.entity AND b.day = s.slot - 1 LEFT JOIN bins c ON c.entity = s.entity AND c.day = s.slot + 1")
def c07_near_time_join(spark, d):
    slots, bins = _bins(spark, d)
    return panel.near_time_join(slots, bins, "entity", "slot", "day", "value").select("entity", "slot", r6("value").alias("value"))


@query(f"WITH {VISITS} SELECT entity, {q6('max(t) FILTER (value IS NOT NULL AND t >= 5 AND t < 20)')} AS last_time, {q6('max_by(value, t) FILTER (value IS NOT NULL AND t >= 5 AND t < 20)')} AS last_value FROM visits GROUP BY entity")
def c08_as_of_last(spark, d):
    x = panel.last_before(visits(spark, d), "entity", "t", "value", 5, 20)
    return x.select("entity", r6("last_time").alias("last_time"), r6("last_value").alias("last_value"))


@query(f"""WITH {VISITS}, x AS (SELECT *, unnest([10.0, 20.0])::DOUBLE AS cutoff FROM visits WHERE value IS NOT NULL) SELECT entity, cutoff, count_if(t <= cutoff) AS n_before, count_if(t > cutoff) AS n_after,
 {q6('max_by(value, t) FILTER (t <= cutoff)')} AS current, {q6('regr_slope(value, t) FILTER (t <= cutoff)')} AS slope FROM x GROUP BY entity, cutoff HAVING count_if(t <= cutoff) >= 2 AND count_if(t > cutoff) >= 1""")
def c09_cutoff_join(spark, d):
    x = panel.at_cutoffs(visits(spark, d), [10, 20], "entity", "t", "value")
    return x.select("entity", "cutoff", "n_before", "n_after", r6("current").alias("current"), r6("slope").alias("slope"))


@query(f"WITH {VISITS}, c AS (SELECT entity, visit, avg(value) AS v, avg(t) AS t FROM visits GROUP BY ALL) SELECT a.entity, a.visit, {q6('a.v')} AS v0, {q6('b.v')} AS v1, {q6('b.t - a.t')} AS gap FROM c a JOIN c b ON a.entity = b.entity AND b.visit = a.visit + 1 WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND b.t > a.t")
def c10_consecutive_visits(spark, d):
    c = visits(spark, d).groupBy("entity", "visit").agg(F.avg("value").alias("v"), F.avg("t").alias("t"))
    return panel.consecutive(c, "entity", "visit", "t", "v").select("entity", "visit", *[r6(x).alias(x) for x in ("v0", "v1", "gap")])


@query(f"WITH {SHOTS} SELECT entity, count(DISTINCT dataset) AS datasets FROM shots GROUP BY entity HAVING count(DISTINCT dataset) > 1")
def c11_id_collision(spark, d):
    return shots(spark, d).groupBy("entity").agg(F.count_distinct("dataset").alias("datasets")).where("datasets > 1")


_TOLERANT = "a AS (SELECT regexp_replace(url, '^[a-z]+://(www\\.|m\\.)?', '') AS k, page_id FROM pages), b AS (SELECT k, min(page_id) AS page_id FROM (SELECT regexp_replace(replace(url, '/en/', '/fr/'), '^[a-z]+://(www\\.|m\\.|blog\\.)?', '') AS k, page_id FROM pages) GROUP BY k)"


def _tolerant(spark, d):
    """Pages beside the French addresses of all pages, whatever the prefix."""
    p = table(spark, d, "pages")
    other = p.select("page_id", F.replace("url", F.lit("/en/"), F.lit("/fr/")).alias("url"))
    return panel.tolerant_join(p.select("page_id", "url"), other, F.regexp_replace("url", r"^[a-z]+://(www\.|m\.)?", ""), F.regexp_replace("url", r"^[a-z]+://(www\.|m\.|blog\.)?", ""), "page_id")


@query(f"WITH {_TOLERANT} SELECT a.page_id, b.page_id AS matched, b.k IS NOT NULL AS found FROM a LEFT JOIN b USING (k)")
def c12_prefix_tolerant_join(spark, d):
    return _tolerant(spark, d).select("page_id", "matched", "found")


@query(f"WITH {_TOLERANT} SELECT count(*) AS rows, count(b.k) AS matches, {q6('avg((b.k IS NOT NULL)::INT)')} AS rate FROM a LEFT JOIN b USING (k)")
def c12_match_rate(spark, d):
    return panel.match_rate(_tolerant(spark, d)).withColumn("rate", r6("rate"))


@query("SELECT count_if(l.doc_id IS NOT NULL) AS in_labels, count_if(l.doc_id IS NULL) AS not_in_labels, count(*) - count(DISTINCT md5(d.text)) AS duplicates, count(DISTINCT d.source) AS sources FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def c13_provenance_audit(spark, d):
    seen = table(spark, d, "labels").select("doc_id").distinct().withColumn("seen", F.lit(True))
    x = table(spark, d, "documents").select("doc_id", "source", F.md5(F.encode("text", "UTF-8")).alias("h")).join(seen, "doc_id", "left")
    return x.agg(F.count_if("seen").alias("in_labels"), F.count_if(F.col("seen").isNull()).alias("not_in_labels"), (F.count("*") - F.count_distinct("h")).alias("duplicates"), F.count_distinct("source").alias("sources"))
