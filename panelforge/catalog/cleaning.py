"""B: projections, scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.fixtures import CELLS, ENTITY_LAG, OUTCOMES, SHOTS, VISITS, WIDE, cells, entity_lag, outcomes, shots, visits, wide
from panelforge.functions import clean
from panelforge.operators import panel
from panelforge.registry import q6, query, r6, table

_NAME = "CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE printf('IMPACT %d', c_custkey) END"
_PID = "CASE WHEN c_custkey % 3 = 0 THEN printf('imp%d x', c_custkey) ELSE printf('id-%d', c_custkey) END"
_FOLDER = "CASE WHEN c_custkey % 2 = 0 THEN printf('%d_ok', c_custkey * 31) ELSE printf('IMP%d_SI', c_custkey) END"


def _ids(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, "unknown").otherwise(F.format_string("IMPACT %d", k)).alias("name"),
        F.when(k % 3 == 0, F.format_string("imp%d x", k)).otherwise(F.format_string("id-%d", k)).alias("pid"),
        F.when(k % 2 == 0, F.format_string("%d_ok", k * 31)).otherwise(F.format_string("IMP%d_SI", k)).alias("folder"),
    )


_IDS = f"ids AS (SELECT c_custkey AS id, {_NAME} AS name, {_PID} AS pid, {_FOLDER} AS folder FROM customer)"
_NUM = r"TRY_CAST(regexp_extract({0}, '(?i)IMP[ACT]*\s*(\d+)', 1) AS BIGINT)"


@query(f"WITH {_IDS} SELECT id, {_NUM.format('name')} AS number FROM ids")
def b01_entity_number(spark, d):
    return _ids(spark, d).select("id", clean.entity_number(F.col("name")).alias("number"))


@query(f"""WITH {_IDS}, x AS (SELECT id, coalesce({_NUM.format('pid')}, {_NUM.format('name')}) AS n, regexp_replace(folder, '(_ok|_SI|_NO)$', '') AS bare FROM ids)
SELECT id, CASE WHEN n IS NOT NULL THEN printf('IMP%04d', n) WHEN regexp_full_match(bare, '\\d+') THEN 'NHC_' || bare ELSE bare END AS entity FROM x""")
def b02_resolve_entity(spark, d):
    return _ids(spark, d).select("id", clean.resolved_id(F.col("folder"), F.col("pid"), F.col("name")).alias("entity"))


@query(f"""WITH {_IDS} SELECT id, CASE WHEN upper(name) LIKE 'IMP%' AND regexp_replace(name, '[^0-9]', '', 'g') <> '' THEN printf('IMP_%04d', CAST(regexp_replace(name, '[^0-9]', '', 'g') AS BIGINT)) ELSE name END AS normal FROM ids""")
def b03_normalize_id(spark, d):
    return _ids(spark, d).select("id", clean.normalized_id(F.col("name")).alias("normal"))


_FILES = "files AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE '' END AS header, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y%m%d') || '.' || o_orderkey || '_debug.png' ELSE '12_NHC_3_f' || o_orderkey || '.png' END AS file, 'd' || o_custkey AS folder FROM orders)"


def _files(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, day).otherwise("").alias("header"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("folder"),
        F.when(k % 2 == 0, F.concat(day, F.lit("."), k.cast("string"), F.lit("_debug.png"))).otherwise(F.concat(F.lit("12_NHC_3_f"), k.cast("string"), F.lit(".png"))).alias("file"),
    )


@query(f"WITH {_FILES} SELECT id, coalesce(nullif(header, ''), CASE WHEN regexp_matches(file, '^\\d{{8}}\\.') THEN file[1:8] END, folder) AS study_date FROM files")
def b04_study_date(spark, d):
    return _files(spark, d).select("id", clean.study_date(F.col("header"), F.col("file"), F.col("folder")).alias("study_date"))


@query(f"WITH {_FILES} SELECT id, regexp_replace(regexp_replace(regexp_replace(file, '\\.png$', ''), '_(debug|overlay|mask)$', ''), '^\\d+_(NHC_\\d+_)?', '') AS frame_key FROM files")
def b05_frame_key(spark, d):
    return _files(spark, d).select("id", clean.frame_key(F.col("file")).alias("frame_key"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'cerebral' WHEN 'N' THEN 'femur' WHEN 'R' THEN 'abdominal' END AS stratum, l_linestatus || ':' || l_orderkey AS entity_key, l_orderkey || '_' || l_linenumber || '_' || l_returnflag AS new_filename FROM lineitem")
def b06_stratum_and_keys(spark, d):
    strata = F.create_map(*map(F.lit, ["A", "cerebral", "N", "femur", "R", "abdominal"]))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.try_element_at(strata, F.col("l_returnflag")).alias("stratum"), F.concat_ws(":", "l_linestatus", F.col("l_orderkey").cast("string")).alias("entity_key"), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag").alias("new_filename"))


_RAW = """raw AS (SELECT p_partkey AS id, 'price' AS col, replace(printf('%.2f', p_retailprice), '.', ',') AS raw FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part
 UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'big', printf('1.%03d,5', p_size) FROM part)"""


def _raw(spark, d):
    p = table(spark, d, "part")
    cols = {"price": F.regexp_replace(F.format_string("%.2f", "p_retailprice"), r"\.", ","), "size": F.col("p_size").cast("string"), "brand": F.col("p_brand"), "big": F.format_string("1.%03d,5", "p_size")}
    return p.select(F.col("p_partkey").alias("id"), F.inline(F.array(*[F.struct(F.lit(k).alias("col"), v.alias("raw")) for k, v in cols.items()])))


def _parse_sql(rule: str, other: str) -> str:
    return f"""WITH {_RAW}, x AS (SELECT *, TRY_CAST(trim(raw) AS DOUBLE) AS plain, TRY_CAST({other} AS DOUBLE) AS other FROM raw),
 u AS (SELECT col, {rule} AS eu FROM x GROUP BY col) SELECT id, col, {q6('CASE WHEN eu THEN other ELSE plain END')} AS value FROM x JOIN u USING (col)"""


@query(_parse_sql("count(other) > 1.5 * count(plain)", "replace(trim(raw), ',', '.')"))
def b07_eurofloat_comma(spark, d):
    return clean.parse_numbers(_raw(spark, d), "col", "raw").select("id", "col", r6("value").alias("value"))


@query(_parse_sql(r"count(plain) <= 0.5 * count(raw) AND count_if(regexp_matches(raw, '^\s*-?\d{1,3}(\.\d{3})*,\d+\s*$|^\s*-?\d+,\d+\s*$')) >= 0.3 * count(raw)", "replace(replace(trim(raw), '.', ''), ',', '.')"))
def b07_eurofloat_dots(spark, d):
    return clean.parse_numbers(_raw(spark, d), "col", "raw", "dots").select("id", "col", r6("value").alias("value"))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'sí' WHEN 3 THEN CAST(quality AS VARCHAR) WHEN 4 THEN '-2.5' ELSE '?' END AS f FROM labels), y AS (SELECT doc_id, lower(trim(f)) AS w FROM x)
SELECT doc_id, CAST(CASE WHEN w IN ('yes', 'si', 'sí', 'true', 'y') THEN 1 WHEN w IN ('no', 'false', 'n') THEN 0 WHEN TRY_CAST(w AS DOUBLE) IS NOT NULL THEN CASE WHEN TRY_CAST(w AS DOUBLE) > 0 THEN 1 ELSE 0 END END AS INTEGER) AS flag FROM y""")
def b08_yes_no(spark, d):
    k = F.col("doc_id") % 6
    f = F.when(k == 0, "Yes").when(k == 1, " no ").when(k == 2, "sí").when(k == 3, F.col("quality").cast("string")).when(k == 4, "-2.5").otherwise("?")
    return table(spark, d, "labels").select("doc_id", clean.yes_no(f).alias("flag"))


_DATES = "dates AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS a, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 - 45 AS INTEGER) END AS b FROM orders)"


@query(f"""WITH {_DATES} SELECT id, coalesce(a, b) AS anchor, CASE WHEN a IS NOT NULL THEN 'primary' WHEN b IS NOT NULL THEN 'fallback' END AS origin, CAST(date_diff('day', b, a) AS INTEGER) AS gap,
 CASE WHEN a IS NULL OR b IS NULL THEN 'single' WHEN abs(date_diff('day', b, a)) > 60 THEN '>60d' WHEN abs(date_diff('day', b, a)) > 14 THEN '>14d' ELSE 'ok' END AS flag FROM dates""")
def b09_dating_anchor(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    x = table(spark, d, "orders").select(k.alias("id"), F.when(k % 4 > 0, day).alias("a"), F.when(k % 7 > 0, F.date_add(day, (k % 90 - 45).cast("int"))).alias("b"))
    anchor, origin, gap, flag = clean.dating_anchor(F.col("a"), F.col("b"))
    return x.select("id", anchor.alias("anchor"), origin.alias("origin"), gap.alias("gap"), flag.alias("flag"))


@query(f"WITH {SHOTS} SELECT l_orderkey, l_linenumber, part, {q6('weeks')} AS weeks, weeks BETWEEN 6 AND 42 AS valid FROM shots")
def b10_clock_target(spark, d):
    s = shots(spark, d)
    w = clean.weeks_between(F.col("study"), F.col("anchor"))
    return s.select("l_orderkey", "l_linenumber", "part", r6(w).alias("weeks"), clean.within(w, 6, 42).alias("valid"))


@query("SELECT event_id, CASE WHEN value >= 5 THEN value END AS value, CAST(coalesce(value >= 5, false) AS INTEGER) AS mask FROM events")
def b11_sentinel_mask(spark, d):
    v = clean.unless_sentinel(F.col("value"), 5)
    return table(spark, d, "events").select("event_id", v.alias("value"), v.isNotNull().cast("int").alias("mask"))


@query(f"WITH {VISITS} SELECT event_id, {q6('(t - 6) / 36')} AS x, {q6('(t - 26) / 14')} AS z, {q6('(t - 6) / 36 * 36 + 6')} AS back FROM visits")
def b12_clock_scaling(spark, d):
    t = F.col("t")
    return visits(spark, d).select("event_id", r6(clean.scaled_clock(t)).alias("x"), r6(clean.scaled_clock(t, 26, 14)).alias("z"), r6(clean.unscaled_clock(clean.scaled_clock(t))).alias("back"))


@query(f"""WITH {WIDE}, u AS (SELECT CASE WHEN median(view) > 25 THEN 0.1 ELSE 1.0 END AS k FROM wide), x AS (SELECT entity, visit, click * k / 3 AS bpd, error * k / 3 AS hc, signup * k / 3 AS ac, view * k / 9 AS fl FROM wide, u)
SELECT entity, visit, {q6('pow(10, 1.3596 + 0.0064 * hc + 0.0424 * ac + 0.174 * fl + 0.00061 * bpd * ac - 0.00386 * ac * fl)')} AS weight FROM x""")
def b13_growth_reference(spark, d):
    w = wide(spark, d)
    unit = w.agg(F.when(F.percentile("view", F.lit(0.5)) > 25, 0.1).otherwise(1.0).alias("k"))
    k = F.col("k")
    g = clean.growth_reference(F.col("click") * k / 3, F.col("error") * k / 3, F.col("signup") * k / 3, F.col("view") * k / 9)
    return w.crossJoin(F.broadcast(unit)).select("entity", "visit", r6(g).alias("weight"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice / 1000 * 10 WHEN p_size % 3 = 1 THEN p_size / 10.0 END AS spacing FROM part")
def b14_pixel_spacing(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.when(s % 3 == 0, F.col("p_retailprice") / 1000 * 10), F.when(s % 3 == 1, s / 10.0)).alias("spacing"))


_COLUMNS = "cols AS (SELECT p_partkey AS id, p_type || '_' || p_name || CASE p_partkey % 5 WHEN 0 THEN '_date' WHEN 1 THEN '_id' WHEN 2 THEN '=1' ELSE '' END AS name FROM part)"
_RULES = [("=[01]$", "one-hot"), ("(?i)date|fecha", "date"), ("(?i)(^|_)(id|cod)$", "id")]
_FAMILIES = [("(?i)widget|ring", "outcome"), ("(?i)economy", "growth"), ("(?i)small|large", "size")]


@query(f"WITH {_COLUMNS} SELECT id, name, CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{v}'" for p, v in _RULES) + " ELSE 'clinical' END AS kind, CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{v}'" for p, v in _FAMILIES) + " ELSE 'other' END AS family FROM cols")
def b15_classify_columns(spark, d):
    k = F.col("p_partkey") % 5
    name = F.concat("p_type", F.lit("_"), "p_name", F.when(k == 0, "_date").when(k == 1, "_id").when(k == 2, "=1").otherwise(""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name")).select("id", "name", clean.first_match(F.col("name"), _RULES, "clinical").alias("kind"), clean.first_match(F.col("name"), _FAMILIES, "other").alias("family"))


@query(f"WITH {OUTCOMES} SELECT grp, count(*) AS n, {q6('avg(percentile)')} AS mean FROM outcomes GROUP BY grp")
def b16_outcome_group(spark, d):
    return outcomes(spark, d).groupBy("grp").agg(F.count("*").alias("n"), r6(F.avg("percentile")).alias("mean"))


@query(f"WITH {WIDE} SELECT entity, visit, CASE WHEN click IS NULL OR error IS NULL OR view IS NULL THEN NULL WHEN click > 60 AND error > 60 THEN 'high' WHEN click < 30 AND view < 40 THEN 'low' ELSE 'middle' END AS pole FROM wide")
def b17_pole_groups(spark, d):
    c, e, v = map(F.col, ("click", "error", "view"))
    return wide(spark, d).select("entity", "visit", F.when(clean.all_observed(c, e, v), F.when((c > 60) & (e > 60), "high").when((c < 30) & (v < 40), "low").otherwise("middle")).alias("pole"))


@query(f"WITH {ENTITY_LAG} SELECT entity, CASE WHEN n < 5 THEN 'too few' WHEN grp = 'SGA' AND lag < 0 THEN 'recovered' WHEN grp = 'SGA' THEN 'missed' WHEN lag < -3 THEN 'false alarm' ELSE 'clear' END AS status FROM entity_lag")
def b18_recovery_status(spark, d):
    g, lag = F.col("grp") == "SGA", F.col("lag")
    return entity_lag(spark, d).select("entity", F.when(F.col("n") < 5, "too few").when(g & (lag < 0), "recovered").when(g, "missed").when(lag < -3, "false alarm").otherwise("clear").alias("status"))


@query(f"WITH {ENTITY_LAG}, s AS (SELECT CASE WHEN corr(lag, size) > 0 THEN -1 ELSE 1 END AS k FROM entity_lag) SELECT entity, {q6('lag * k')} AS score FROM entity_lag, s")
def b19_orient_score(spark, d):
    e = entity_lag(spark, d)
    sign = e.agg(F.when(F.corr("lag", "size") > 0, -1).otherwise(1).alias("k"))
    return e.crossJoin(F.broadcast(sign)).select("entity", r6(F.col("lag") * F.col("k")).alias("score"))


@query(f"""WITH {VISITS}, k AS (SELECT quantile_cont(t, 0.25) AS a, quantile_cont(t, 0.5) AS b, quantile_cont(t, 0.75) AS c FROM visits)
SELECT event_id, {q6('t')} AS s0, {q6('pow(greatest(t - a, 0), 3)')} AS s1, {q6('pow(greatest(t - b, 0), 3)')} AS s2, {q6('pow(greatest(t - c, 0), 3)')} AS s3 FROM visits, k""")
def b20_spline_basis(spark, d):
    v = visits(spark, d)
    knots = v.agg(*[F.percentile("t", F.lit(p)).alias(n) for p, n in ((0.25, "a"), (0.5, "b"), (0.75, "c"))])
    x = v.crossJoin(F.broadcast(knots))
    return x.select("event_id", *[r6(c).alias(f"s{i}") for i, c in enumerate(clean.spline_basis(F.col("t"), [F.col(n) for n in "abc"]))])


@query(f"""WITH {CELLS}, s AS (SELECT entity, measure, sum(value) AS v FROM cells GROUP BY ALL), p AS (SELECT entity, measure, v / sum(v) OVER (PARTITION BY entity) AS p FROM s)
SELECT entity, measure, {q6('ln(greatest(p, 1e-6)) - avg(ln(greatest(p, 1e-6))) OVER (PARTITION BY entity)')} AS clr FROM p""")
def b21_clr_shares(spark, d):
    from panelforge.operators.windows import clr

    s = cells(spark, d).groupBy("entity", "measure").agg(F.sum("value").alias("v"))
    return clr(s, "entity", "v").select("entity", "measure", r6("clr").alias("clr"))


@query(f"WITH {WIDE} SELECT entity, visit, coalesce(click, 0) AS click, coalesce(error, 0) AS error FROM (SELECT entity, visit, {q6('click')} AS click, {q6('error')} AS error, (click IS NULL)::INT + (error IS NULL)::INT + (view IS NULL)::INT AS m FROM wide) WHERE m <= 1")
def b22_complete_case(spark, d):
    w = wide(spark, d).where(clean.missing_count(*map(F.col, ("click", "error", "view"))) <= 1)
    return w.select("entity", "visit", *[F.coalesce(r6(c), F.lit(0.0)).alias(c) for c in ("click", "error")])


@query(f"WITH {VISITS} SELECT event_id, CASE WHEN t > 0 AND t <= 8 THEN 'a' WHEN t > 8 AND t <= 16 THEN 'b' WHEN t > 16 AND t <= 32 THEN 'c' END AS nominal, CAST(CASE WHEN t > 0 AND t <= 5 THEN 0 WHEN t > 5 AND t <= 15 THEN 1 WHEN t > 15 AND t <= 30 THEN 2 END AS INTEGER) AS bin FROM visits")
def b23_visit_windows(spark, d):
    t = F.col("t")
    return visits(spark, d).select("event_id", F.element_at(F.array(*map(F.lit, "abc")), clean.right_closed_bin(t, [0, 8, 16, 32]) + 1).alias("nominal"), clean.right_closed_bin(t, [0, 5, 15, 30]).alias("bin"))


@query(f"WITH {ENTITY_LAG} SELECT entity, {q6('lag')} AS lag FROM entity_lag WHERE entity % 5 = 2")
def b24_held_out_mask(spark, d):
    e = entity_lag(spark, d)
    held = table(spark, d, "customer").where("c_custkey % 5 = 2").select(F.col("c_custkey").alias("entity"))
    return panel.held_out_only(e, held, "entity").select("entity", r6("lag").alias("lag"))
