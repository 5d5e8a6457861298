"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.collocations import collocations
from panelforge.llm.context_mixing import mixing_scores
from panelforge.llm.decontaminate import leaks
from panelforge.llm.embedding_dedup import embedding_components
from panelforge.llm.language_id import identify
from panelforge.llm.licenses import license_scan
from panelforge.llm.ngram_jaccard import jaccard_components
from panelforge.llm.source_mixing import mix_sources
from panelforge.llm.spelling import spelling_variants
from panelforge.llm.substring import without_repeats
from panelforge.llm.topk_search import top_products
from panelforge.llm.url_filter import RULES, host_of, url_verdicts
from panelforge.llm.warc_zip import read_packages, write_packages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_scores(_table(spark, sf_dir, "documents"))


@_query
def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"))


@_query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@_query
def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    rows = read_packages(write_packages(pages))
    ids = [F.col(c).cast("long").alias(c) for c in ("page_id", "refers_to")]
    return rows.select(ids[0], "payload_bytes", "payload_digest", "record_type", ids[1])


@_query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix_sources(_table(spark, sf_dir, "documents"))
    return taken.select("row.doc_id", "row.source", "n_tokens", "weight", "epoch", "block")


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", F.expr("coalesce(crc32(cast(row.doc_id as string)) % 5 = 0, false)").alias("held_out"), "lang_pred", "score")


#: Titles with runs of signs: pages of machine-made junk. Their URLs are the list; other addresses of the same page fall with them.
JUNK_TITLE = r"<title>[^<]*(%%%|###|\*\*\*)"


@_query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_verdicts(pages, pages.where(F.col("html").rlike(JUNK_TITLE))).select("page_id", "host", "path", "rule", "verdict")


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


@_query
def op13_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings"))


# -- DuckDB SQL with the same rows, for the queries that SQL can express ----------------------------

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

SQL["op1_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER.format("text"))}, []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s), u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m.b, n.doc_id)) AS component_id FROM n LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = n.doc_id"""

SQL["op2_collision_counting"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
g AS (SELECT * FROM v WHERE list_inner_product(x, x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a), d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id, least(e.vec_id, coalesce(c.b, e.vec_id)) = e.vec_id AS kept FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN d ON d.a = e.vec_id"""

SQL["op3_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM w WHERE len(w) >= 35),
x AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM x), p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM w),
k AS (SELECT p.doc_id, count(*) AS kept, string_agg(t, ' ' ORDER BY p.p) AS t FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p WHERE c.p IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

SQL["op6_warc_zip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(html) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS UBIGINT) >> (35 - 5 * (i % 8))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h)"""

_RULES_SQL = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in enumerate(sorted(RULES, key=lambda r: -len(r[1] + r[2]))))
_SORTED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))

SQL["op9_url_filter"] = f"""
WITH x AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
y AS (SELECT page_id, html, {_LOWER.format("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM x),
z AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www\\.|m\\.)', '') || regexp_replace(path, '(\\.html|/)$', '') END AS c FROM y),
l AS (SELECT DISTINCT c FROM z WHERE c IS NOT NULL AND regexp_matches(html, '{JUNK_TITLE}'))
SELECT page_id, host, path, CASE {_RULES_SQL.format(*(f"'{h}{p}'" for _, h, p in _SORTED))} END AS rule,
 CASE {_RULES_SQL.format(*(f"'{v}'" for v, _, _ in _SORTED))} WHEN c IN (SELECT c FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM z"""


SQL["op11_collocations"] = f"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(coalesce({_LOWER.format("text")}, ''), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents),
p AS (SELECT d, lang, unnest(range(1, len(p) + 1)) AS j, unnest(p) AS p FROM d), w AS (SELECT d, lang, j, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
u AS (SELECT lang, unnest(w) AS g FROM w), n AS (SELECT lang, count(*) AS n FROM u GROUP BY lang), f1 AS (SELECT lang, g, count(*) AS f FROM u GROUP BY ALL),
g2 AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS g FROM w WHERE len(w) >= 2), f2 AS (SELECT lang, g, count(*) AS f FROM g2 GROUP BY ALL HAVING count(*) >= 10),
g3 AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM w WHERE len(w) >= 3), f3 AS (SELECT lang, g, count(*) AS f FROM g3 GROUP BY ALL HAVING count(*) >= 10),
i AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, g[1:2] AS g, f FROM f3 UNION ALL SELECT lang, g[2:3], f FROM f3) GROUP BY ALL),
c AS (SELECT f2.lang, f2.g, f2.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * f2.f * f2.f) // (x.f::HUGEINT * y.f) AS score FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.g = f2.g[1] JOIN f1 y ON y.lang = f2.lang AND y.g = f2.g[2]
 LEFT JOIN i ON i.lang = f2.lang AND i.g = f2.g WHERE i.f IS NULL OR 100 * i.f < 50 * f2.f),
t AS (SELECT f3.lang, f3.g, f3.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2, (1000000::HUGEINT * f3.f * f3.f) // (x.f::HUGEINT * yz.f) AS s1, (1000000::HUGEINT * f3.f * f3.f) // (xy.f::HUGEINT * z.f) AS s2
 FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.g = f3.g[1] JOIN f1 z ON z.lang = f3.lang AND z.g = f3.g[3] JOIN f2 xy ON xy.lang = f3.lang AND xy.g = f3.g[1:2] JOIN f2 yz ON yz.lang = f3.lang AND yz.g = f3.g[2:3]),
e AS (SELECT lang, g, a, l, r, score FROM c UNION ALL SELECT lang, g, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM t),
o AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000"""


SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
d AS (SELECT row_number() OVER () AS d, coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_LOWER.format("text")} AS x FROM documents WHERE text IS NOT NULL),
r AS (SELECT d, id, unnest(regexp_extract_all(x, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM d), g AS (SELECT d, id, w, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT w, n, hex(encode(id || ':' || w)) AS x FROM g),
h AS (SELECT w, n, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda c, y: xor(t.t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) AS h FROM b, t),
k AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS word FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
c AS (SELECT DISTINCT word, n, a || z AS cut FROM p),
e AS (SELECT x.word, x.n, y.word AS other, y.n AS m FROM p x JOIN p y ON x.a = y.a AND x.z = y.z AND x.i = y.i AND x.word <> y.word
 UNION ALL SELECT c.word, c.n, v.word, v.n FROM c JOIN v ON v.word = c.cut UNION ALL SELECT v.word, v.n, c.word, c.n FROM c JOIN v ON v.word = c.cut),
o AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM e),
f AS (SELECT v.word, v.n, coalesce(near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN o ON o.word = v.word AND o.k = 1),
q AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT q.word, f.form, q.k + 1 FROM q JOIN f ON f.word = q.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM q GROUP BY word) q ON q.word = f.word"""

SQL["op13_topk_products"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.x) = len(c.x)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10"""
