"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter.

The listed canonical URLs make a blocked Bloom filter, kept as a table: a row per block, a 64-bit word
of bits. URLs meet it by block number (a broadcast if the filter's checked size allows, else a
shuffle); the possible hits go on to an exact hash join with the list, which removes false positives.
DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

BITS, PER_BLOCK = 4, 6
#: Bytes up to which the filter or the list is broadcast.
SMALL = 16 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.`` and path without a final ``/`` or ``.html``; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www\.|m\.)", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def matched_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path) and its verdict; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> Column:
    """A word with up to ``BITS`` bits set."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_url, {i + 1}), 64) as int))"))
    return out


def bloom_filter(listed: DataFrame, count: int) -> tuple[DataFrame, int]:
    """The filter as ``(block, word)`` rows, and its number of blocks; ``listed`` has the column ``_url``."""
    blocks = max(1, -(-count // PER_BLOCK))
    return listed.groupBy(_block(F.col("_url"), blocks).alias("_block")).agg(F.bit_or(_bits(F.col("_url"))).alias("_word")), blocks


def url_verdicts(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", list_url: str = "url", rules: tuple = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, listed)`` for each row of ``pages``.

    The verdict is the longest fitting rule's; without a rule, ``block`` if the canonical URL is in
    ``listed`` and else ``allow``. Null URLs and those without ``://`` have empty host and path, fit no
    rule and are never listed. Entries of ``listed`` may repeat or be null or malformed (then ignored).
    Repeated pages each get a row. Other columns are ignored.
    """
    u = F.col(list_url)
    entries = listed.select(canonical(host_of(u), path_of(u)).alias("_url"), host_of(u).alias("_host")).where("_host <> ''").select("_url").distinct()
    n, size = entries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_url") + 64), F.lit(0))).first()
    words, blocks = bloom_filter(entries, n)
    u = F.col(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("_url", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))))
    rows = rows.withColumn("_block", _block(F.col("_url"), blocks))
    exact = entries.select("_url", F.lit(True).alias("listed"))
    hit = F.coalesce(F.col("_word").bitwiseAND(_bits(F.col("_url"))) == _bits(F.col("_url")), F.lit(False))
    if size <= SMALL and blocks * 64 <= SMALL:
        probed = rows.join(F.broadcast(words), "_block", "left").withColumn("_url", F.when(hit, F.col("_url")))
        out = probed.join(F.broadcast(exact), "_url", "left")
    else:  # a row without a host, and one that the filter rules out, goes past the shuffles
        near = F.broadcast(words) if blocks * 64 <= SMALL else words
        probed = rows.where("_url is not null").join(near, "_block", "left").withColumn("_hit", hit)
        found = probed.where("_hit").join(F.broadcast(exact) if size <= SMALL else exact, "_url", "left")
        rest = probed.where("not _hit").select("page_id", "host", "path").unionByName(rows.where("_url is null").select("page_id", "host", "path"))
        out = found.select("page_id", "host", "path", "listed").unionByName(rest.withColumn("listed", F.lit(None).cast("boolean")))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    in_list = F.coalesce("listed", F.lit(False))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(in_list, "block").otherwise("allow")).alias("verdict"), in_list.alias("listed"))
