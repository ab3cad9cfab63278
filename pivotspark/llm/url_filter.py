"""URL filter: prefix rules, then a blocked Bloom filter in front of an exact
hash join against a list of canonical URLs.

The list may be far larger than memory.  Its filter holds about 16 bits an
entry in 64-bit blocks (one row per block); pages whose bits are not all set
pass at once, and only the possible hits meet the list in an exact join, which
removes the false positives.  All of it is DataFrame code.

Defined results: a null URL or one without ``://`` has empty host and path and
is never listed (allow, unless a rule fits, which none can); repeated URLs and
page ids are judged row by row; an empty list allows whatever no rule blocks;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS_PER_ENTRY = 16
PROBES = 4
# Blocks of a filter that may be broadcast (24 bytes each); larger filters are
# joined by a shuffle on the block number.
BROADCAST_BLOCKS = 1 << 20

# Query parameters that do not change what a URL shows.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


class UrlRule(NamedTuple):
    verdict: str
    rule: str  # host, then path from the first "/"

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host):]


RULES = (UrlRule("block", "net/"), UrlRule("allow", "example.net/en/"),
         UrlRule("block", "example.com/de/"), UrlRule("allow", "org/fr/"))

# Host words of sites that a crawl would not want; the production list below
# names every canonical URL of such a site.
SPAM_HOST = r"(^|[.-])(spam|casino|bets|pills|ads|adult|porn|viagra|loans)([.-]|$)"

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``/``m.`` and default port, path without trailing
    slashes, query parameters sorted without tracking ones; null if no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    args = F.array_sort(F.filter(F.split(F.regexp_extract(url, _URL, 3), "&"),
                                 lambda a: (a != "") & ~a.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(args) > 0, F.concat(
        F.lit("?"), F.array_join(args, "&"))).otherwise("")))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict), else null."""
    longest_first = sorted(rules, key=lambda r: (-len(r.rule), r.rule))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                   F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in longest_first]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def bloom_bits(key: Column) -> Column:
    """The ``PROBES`` bits of a key inside its block, as a 64-bit word."""
    h = F.xxhash64(key, F.lit("bits"))
    word = F.lit(0).cast("long")
    for i in range(PROBES):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return word


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """One row per non-empty block: ``block``, ``word``."""
    return listed.groupBy(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block")).agg(
        F.bit_or(bloom_bits(F.col(key))).alias("word"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``pages(page_id, url, ...)`` against the URL rules and ``listed(url)``.
    Returns page_id, host, path, rule, verdict, listed (boolean)."""
    names = stored(listed.select(canonical(F.col("url")).alias("canon")).where(F.col("canon").isNotNull()).distinct(),
                   "url-list")
    n_listed = names.count()
    n_blocks = max(1, -(-n_listed * BITS_PER_ENTRY // 64))
    blocks = bloom_blocks(names, "canon", n_blocks)
    if n_blocks <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        canonical(F.col("url")).alias("canon"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("canon"), F.lit(n_blocks)))
    probed = rows.join(blocks, "block", "left").withColumn(
        "possible", F.col("canon").isNotNull()
        & F.coalesce(F.col("word").bitwiseAND(bloom_bits(F.col("canon"))) == bloom_bits(F.col("canon")), F.lit(False)))
    hits = probed.where("possible").join(names.withColumn("listed", F.lit(True)), "canon", "left").select(
        "page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed"))
    passed = probed.where(~F.col("possible")).select("page_id", "host", "path", F.lit(False).alias("listed"))
    found = matching_rule(F.col("host"), F.col("path"), rules)
    return hits.unionByName(passed).withColumn("found", found).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def spam_list(pages: DataFrame) -> DataFrame:
    """The production list: the URLs of every page on a spam-named host."""
    return pages.select("url").where(host_of(F.col("url")).rlike(SPAM_HOST))


def oracle_sql() -> str:
    """The same verdicts in DuckDB SQL, with a plain semi-join on the list."""
    longest_first = sorted(RULES, key=lambda r: (-len(r.rule), r.rule))
    fit = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in RULES}
    rule = " ".join(f"WHEN {fit[r]} THEN '{r.rule}'" for r in longest_first)
    verdict = " ".join(f"WHEN {fit[r]} THEN '{r.verdict}'" for r in longest_first)
    return rf"""
WITH u AS (SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '{_URL}', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '{_URL}', 2), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '{_URL}', 3), '&'),
        lambda a: a <> '' AND NOT regexp_matches(a, '{TRACKING}'))) AS args FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN
    regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canon FROM u),
listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '{SPAM_HOST}') AND canon IS NOT NULL),
j AS (SELECT page_id, host, path, canon IS NOT NULL AND canon IN (SELECT canon FROM listed) AS listed FROM c)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, listed FROM j"""
