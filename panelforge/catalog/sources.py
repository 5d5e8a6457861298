"""A: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators.lineage import scratch
from panelforge.registry import q6, query, r6, table
from panelforge.sources import tables


@query(f"SELECT entity, visit, measure, n, {q6('value')} AS value FROM (SELECT user_id AS entity, CAST(least(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 8, 3) AS INTEGER) AS visit, event_type AS measure, count(*) AS n, avg(value) AS value FROM events GROUP BY ALL) WHERE visit IN (0, 2)")
def a01_visits_whitelist(spark, d):
    from panelforge.catalog.fixtures import visits

    e = table(spark, d, "events").select("event_id", F.col("value").alias("raw"))
    v = visits(spark, d).where(F.col("visit").isin(0, 2)).join(e, "event_id")
    return v.groupBy("entity", "visit", "measure").agg(F.count("*").alias("n"), r6(F.avg("raw")).alias("value"))


@query(f"SELECT vec_id AS frame, label AS stratum, CAST(len(embedding) AS INTEGER) AS dim, {q6('CAST(embedding[1] AS DOUBLE)')} AS first FROM embeddings WHERE label < 5")
def a02_embeddings(spark, d):
    e = tables.read_embeddings(spark, f"{d}/embeddings.parquet", columns=["vec_id", "label", "embedding"]).where("label < 5")
    return e.select(F.col("vec_id").alias("frame"), F.col("label").alias("stratum"), F.size("embedding").alias("dim"), r6(F.col("embedding")[0].cast("double")).alias("first"))


@query(f"SELECT vec_id AS frame, CAST(i AS INTEGER) AS patch, {q6('CAST(embedding[i * 8 + 1] AS DOUBLE)')} AS t0, {q6('CAST(embedding[i * 8 + 8] AS DOUBLE)')} AS t7 FROM embeddings, range(8) r(i)")
def a03_token_grids(spark, d):
    from panelforge.operators.vectors import to_tokens

    g = to_tokens(table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), "embedding"), "embedding", 8)
    return g.select("frame", "patch", r6(F.col("tok")[0].cast("double")).alias("t0"), r6(F.col("tok")[7].cast("double")).alias("t7"))




@query("""WITH x AS (SELECT o_custkey, o_orderkey, l_quantity AS q, l_returnflag AS f, l_linenumber AS n, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderkey AS VARCHAR) AS scan, f AS type, CAST(i AS INTEGER) AS index, CAST(n AS VARCHAR) AS path, q AS spacing FROM x""")
def a04_flatten_label_json(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    parts = tables.tasks_for(spark, li.count() + o.count())
    li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey")
    x = li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey)
    rank = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("spacing"), F.col("l_returnflag").alias("type"))
    scans = x.groupBy("o_custkey", "o_orderkey").agg(F.sort_array(F.collect_list(rank)).alias("r"))
    items = F.transform("r", lambda y: F.struct(y.l_linenumber.cast("string").alias("path"), y.type.alias("type"), y.spacing.alias("spacing"), F.lit(1.0).alias("confidence")))
    scan = F.struct(F.lit(20.0).alias("weeks"), F.lit("2024").alias("scan_date"), items.alias("items"))
    one = F.create_map(F.col("o_custkey").cast("string"), F.struct(F.create_map(F.col("o_orderkey").cast("string"), scan).alias("scans")))
    lines = scans.select(F.to_json(one).alias("json"), F.col("o_orderkey").alias("order"))
    return tables.flatten_labels(lines, partitions=parts).select("entity", "scan", "type", "index", "path", "spacing")


@query(r"SELECT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS folder, split_part(url, '/', -1) AS file, count(*) AS n FROM pages WHERE NOT regexp_matches(url, '\?') GROUP BY ALL")
def a05_discover_files(spark, d):
    parts = tables.path_parts(table(spark, d, "pages").where(~F.col("url").rlike(r"\?")), "url")
    return parts.withColumn("folder", F.element_at(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), 1)).groupBy("folder", "file").agg(F.count("*").alias("n"))


def _manifest(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("frame"), F.col("source").alias("name"), F.col("lang").alias("dataset"), F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("doc_id").cast("string")).alias("entity"))
    rejects = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("frame"))
    return tables.frame_manifest(x, rejects, {"en": "/a", "fr": "/b", "de": "/c"}, ["en", "fr"])


_MANIFEST = "manifest AS (SELECT doc_id AS frame, CAST(doc_id AS BIGINT) AS entity, lang AS dataset, CASE lang WHEN 'en' THEN '/a/' ELSE '/b/' END || source AS path FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 11 > 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL))"


@query(f"WITH {_MANIFEST} SELECT * FROM manifest")
def a06_frame_manifest(spark, d):
    return _manifest(spark, d).select("frame", "entity", "dataset", "path")


@query(f"""WITH {_MANIFEST}, files AS (SELECT DISTINCT CASE lang WHEN 'en' THEN '/a/' ELSE '/b/' END || source || CASE WHEN doc_id % 7 < 5 THEN '.png' ELSE '.jpg' END AS path FROM documents WHERE doc_id % 3 = 0),
 t AS (SELECT m.*, s.suffix, m.path || s.suffix AS file FROM manifest m, (VALUES ('.jpg'), ('.png')) s(suffix)), h AS (SELECT * FROM t WHERE file IN (SELECT path FROM files)),
 b AS (SELECT dataset, suffix FROM (SELECT dataset, suffix, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, suffix) AS r FROM h GROUP BY dataset, suffix) WHERE r = 1)
SELECT h.frame, h.dataset, h.file FROM h JOIN b USING (dataset, suffix)""")
def a07_resolve_extension(spark, d):
    k = F.col("doc_id")
    files = table(spark, d, "documents").where(k % 3 == 0).select(F.concat(F.when(F.col("lang") == "en", "/a/").otherwise("/b/"), "source", F.when(k % 7 < 5, ".png").otherwise(".jpg")).alias("path"))
    return tables.resolve_extension(_manifest(spark, d), files, [".jpg", ".png"]).select("frame", "dataset", "file")


@query("SELECT dataset, count(*) AS n FROM (SELECT l_linestatus AS dataset FROM lineitem) GROUP BY dataset")
def a08_written_mapping(spark, d):
    """Writes the mapping by dataset into the shared folder and counts what is read back."""
    path = scratch(spark, "mapping")
    tables.write_by(table(spark, d, "lineitem").select(F.col("l_linestatus").alias("dataset"), "l_orderkey"), path, "dataset")
    return spark.read.schema("l_orderkey long, dataset string").parquet(path).groupBy("dataset").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a09_resume(spark, d):
    return tables.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
