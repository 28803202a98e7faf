"""URL filters: site rules, then a list of URLs behind a blocked Bloom filter.

A rule (action, site, path) fits its host and all subdomains if the url's path
starts with its path; the longest fitting rule decides.  Urls without a rule
are looked up by canonical form in a list: a blocked Bloom filter of the list
(one 512-bit block per url, one bit in each of its eight words) passes possible
hits, and an exact hash join removes its false positives.  The filter is built
with grouped bit_or and has at most BLOCKS blocks, which bounds its broadcast
whatever the list's size; a fuller filter only passes more rows to the join.

All of it is DataFrame expressions.

Defined results: a null url and one without "://" have empty host and path,
fit no rule and are on no list (verdict allow); every row gives one row;
repeated list entries count once, null ones not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 16  # of 64 bytes: the filter's bound is 4 MB
PER_BLOCK = 32    # listed urls a block is meant for
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = [f"w{i}" for i in range(8)]


def _rest(url: Column) -> Column:
    """What follows the first "://"; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url_host: Column, url_path: Column) -> Column:
    """Host and path without final slashes; null without a host."""
    return F.when(url_host != "", F.concat(url_host, F.regexp_replace(url_path, r"/+$", "")))


def rule_of(rules: list[tuple[str, str, str]], url_host: Column, url_path: Column) -> tuple[Column, Column]:
    """Rule (site and path as one string) and action of the longest rule that
    fits; of equally long ones that with the longer site, then by name."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, site, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r), reverse=False):
        fits = ((url_host == site) | url_host.endswith("." + site)) & url_path.startswith(start)
        name, action = F.when(fits, F.lit(site + start)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _hashed(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block, and its bit in each word of the block."""
    bits = F.xxhash64(F.lit(1), key)
    return (F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"),
            [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(len(WORDS))])


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of keys(key)."""
    block, bits = _hashed(F.col("key"), blocks)
    rows = keys.select(block.alias("block"), *[b.alias(w) for b, w in zip(bits, WORDS)])
    return rows.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """pages(page_id, url) judged: page_id, url, host, path, rule, verdict, on_list.
    listed(url) holds the urls to block where no rule fits."""
    keys = (listed.select(canonical(host(F.col("url")), path(F.col("url"))).alias("key")).filter("key IS NOT NULL").distinct())
    n = min(blocks, max(1, -(-keys.count() // PER_BLOCK)))
    bloom = F.broadcast(blocked_bloom(keys, n))
    urls = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, action = rule_of(rules, F.col("host"), F.col("path"))
    urls = urls.withColumn("rule", name).withColumn("action", action).withColumn("key", canonical(F.col("host"), F.col("path")))
    block, bits = _hashed(F.col("key"), n)
    urls = urls.withColumn("block", F.when(F.col("action").isNull(), block))
    tested = urls.join(bloom, "block", "left")
    all_set = bits[0].bitwiseAND(F.col("w0")) != 0
    for b, w in zip(bits[1:], WORDS[1:]):
        all_set = all_set & (b.bitwiseAND(F.col(w)) != 0)
    tested = tested.withColumn("maybe", F.coalesce(all_set, F.lit(False)))
    sure = tested.filter(~F.col("maybe")).withColumn("on_list", F.lit(False))
    hits = tested.filter("maybe").join(keys.select("key", F.lit(True).alias("on_list")).hint("shuffle_hash"), "key", "left").withColumn("on_list", F.coalesce("on_list", F.lit(False)))
    out = ["page_id", "url", "host", "path", "rule", F.coalesce("action", F.when(F.col("on_list"), "block").otherwise("allow")).alias("verdict"), "on_list"]
    return sure.select(*out).union(hits.select(*out))
