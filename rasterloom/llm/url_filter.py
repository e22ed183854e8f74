"""URL filter: rules on host and path, then a list of canonical URLs behind a blocked Bloom filter.

A rule (host, path, verdict) fits its host and all subdomains if the path starts with the rule's;
of the rules that fit the longest host + path wins.  Rules are a fixed argument and become one
expression.  Where no rule fits, a page is blocked if its canonical URL is listed: the Bloom filter
(a table of blocks of 8 words of 32 bits, one bit in each word per URL) passes possible hits, and an exact hash
join on the canonical URL removes the false ones.

The filter takes about ``bits_per_url`` bits a URL.  It is broadcast only if its size, computed
from the counted list, is at most ``broadcast_bytes``; else pages meet their block in a shuffled
join on the block number.

Canonical form: scheme, fragment, user, port 80/443, a leading ``www.`` or ``m.``, a final slash
or ``.html``, and query parameters that only track (utm_*, ref, fbclid, gclid) dropped, host in
lower case, other parameters sorted.

Only possible hits go into the exact join; all other pages pass by it.  In the query, URLs without a
number at their end, or with one beyond 64 bits, name no document and add nothing to the list.

Null URLs, and those without ``://``, have an empty host and path and no canonical form: no rule
fits, verdict allow.  Repeated rows are judged alike; an empty list or table is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url_rest(url), r"(?s)^([^/?#]*)", 1), *_LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(url_host(url), "^.*@", ""), ":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(url_path(url), r"(\.html|/)$", "")
    query = F.regexp_extract(url_rest(url), r"(?s)^[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.sort_array(kept), "&")
    return F.when(host == "", F.lit(None)).otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict), both null where no rule fits; of equal lengths the first by text wins."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _bits(url: Column, blocks: int) -> list[Column]:
    """Block number, then 8 masks of one bit in 32."""
    a, b = F.xxhash64(url), F.xxhash64(url, F.lit(1))
    return [F.pmod(a, F.lit(blocks)).alias("_blk"), *[F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(b, i * 5).bitwiseAND(F.lit(31).cast("long")).cast("int")).alias(f"_m{i}") for i in range(8)]]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table of at most ``blocks`` rows.  listed: one column _url."""
    return listed.select(*_bits(F.col("_url"), blocks)).groupBy("_blk").agg(*[F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(8)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", listed_url: str = "url", bits_per_url: int = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, listed (true where the exact join found the URL)."""
    urls = listed.select(canonical(F.col(listed_url)).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    n = urls.count()  # bounds the filter
    blocks = max(1, -(-n * bits_per_url // 256))
    name, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), canonical(F.col(url_col)).alias("_url"))
    rows = rows.withColumn("rule", name).withColumn("_v", verdict)
    asked = F.col("_v").isNull() & F.col("_url").isNotNull()
    bits = bloom(urls, blocks)
    hit = F.lit(True)
    for i in range(8):
        hit = hit & (F.coalesce(F.col(f"_w{i}"), F.lit(0)).bitwiseAND(F.col(f"_m{i}")) != 0)
    kept = ["page_id", "host", "path", "rule", "_v", "_url"]
    if blocks * 40 <= broadcast_bytes:
        met = rows.select(*kept, *_bits(F.col("_url"), blocks)).join(F.broadcast(bits), "_blk", "left").select(*kept, (asked & hit).alias("_maybe"))
        sure, maybe = met.where(~F.col("_maybe")), met.where("_maybe")
    else:  # only pages that no rule decides meet their block
        met = rows.where(asked).select(*kept, *_bits(F.col("_url"), blocks)).join(bits, "_blk", "left").select(*kept, hit.alias("_maybe"))
        sure, maybe = rows.where(~asked).select(*kept).unionByName(met.where(~F.col("_maybe")).select(*kept)), met.where("_maybe")
    found = maybe.join(urls.withColumnRenamed("_url", "_listed"), F.col("_url") == F.col("_listed"), "left")
    sure = sure.select("page_id", "host", "path", "rule", F.coalesce("_v", F.lit("allow")).alias("verdict"), F.lit(False).alias("listed"))
    found = found.select("page_id", "host", "path", "rule", F.when(F.col("_listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), F.col("_listed").isNotNull().alias("listed"))
    return sure.unionByName(found)


def op3(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Production list: the URLs under which documents labelled toxic were found (their number ends the path)."""
    number = F.regexp_extract(url_path(F.col("url")), r"/(\d+)(?:\.html|/)?$", 1).try_cast("long")
    listed = pages.select("url", number.alias("doc_id")).join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id")
    return filter_urls(pages, listed)


def queries_op3(spark, sf_dir: str) -> DataFrame:
    return op3(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


ORACLE = r"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*[^?#]*\?([^#]*)', 1) AS q FROM u),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)$', ''), '^(www|m)\.', '') AS ch,
             array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS cq FROM v),
k AS (SELECT *, CASE WHEN ch = '' THEN NULL ELSE ch || regexp_replace(path, '(\.html|/)$', '') || CASE WHEN cq <> '' THEN '?' || cq ELSE '' END END AS canon FROM c),
l AS (SELECT DISTINCT canon FROM k WHERE canon IS NOT NULL AND TRY_CAST(regexp_extract(path, '/(\d+)(?:\.html|/)?$', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                     WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                     WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                     WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM k)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END AS verdict,
       rule IS NULL AND canon IS NOT NULL AND canon IN (SELECT canon FROM l) AS listed
FROM r
"""
