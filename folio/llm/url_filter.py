"""URL filters: allow and block rules by host suffix and path prefix, then a list of blocked URLs.

Listed URLs are compared in canonical form. A blocked Bloom filter of them, one row of eight 32-bit words for each
block, marks the pages that may be listed; only those go on to an exact hash join with the list, which removes false
positives. All of it is DataFrame operations. The filter is broadcast while it has at most `broadcast_blocks` blocks
(8 words and a number each, so 100,000 blocks are about 8 MB); a larger one is joined on the block number.

Defined cases: a null url, or one without `://`, has empty host and path, no rule, and is allowed; null and repeated
listed urls are ignored; an empty list lists nothing; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.bloom import BROADCAST_BLOCKS, KEYS_PER_BLOCK, blocks_for, bloom_filter, probe

#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Host names seen in the sample tables, for use while no list is given. Incomplete: other bad hosts pass.
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical(url: Column) -> Column:
    """host and path without `www.`, `m.`, index pages and final slashes; the query's tracking parts and the fragment go, the rest of the query stays.

    Null where there is no host.
    """
    host, path = host_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[a-z]+|ref|fbclid|gclid)=")))
    tail = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, keys_per_block: int = KEYS_PER_BLOCK, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed (boolean: the url is on the list), for each row of `pages`.

    `listed` has a column url. With 16 keys in a block of 256 bits about 2.4 % of other urls pass the filter.
    """
    keys = listed.select(canonical(F.col("url")).alias("listed_url")).where("listed_url is not null").distinct()
    blocks = blocks_for(keys.count(), keys_per_block)
    bloom = bloom_filter(keys, "listed_url", blocks)
    host, path = host_path(F.col("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical")).withColumns({"rule": rule, "by_rule": verdict})
    probed = probe(judged, "canonical", bloom, blocks, "possible", broadcast_blocks)
    # two branches, so that urls that can't be listed aren't shuffled, and no join has a null key for most rows
    sure = probed.where("not possible").withColumn("listed", F.lit(False))
    maybe = probed.where("possible").join(keys, F.col("canonical") == F.col("listed_url"), "left").withColumn("listed", F.col("listed_url").isNotNull()).drop("listed_url")
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow"))
    return sure.unionByName(maybe).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def listed_urls(pages: DataFrame, names: tuple[str, ...] = BLOCKED_NAMES) -> DataFrame:
    """Stands in for a list where none is given: the urls of `pages` whose host has a label among `names`, and no others."""
    host, _ = host_path(F.col("url"))
    return pages.where(host.rlike(r"(?:^|\.)(?:" + "|".join(names) + r")(?:\.|$)")).select("url")
