"""The operators' queries over the driver's whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, conversation_repair, decontaminate, filter_audit, licenses, pii, quality, simhash, substring_dedup, suffix_dedup, token_counts, url_filter
from .frames import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SITE_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LISTED_LABEL = "ads-track"
KEEP_SCORE, MOST_TOKENS = 0.3, 4096
NEAREST, QUERY_STEP = 20, 20
REPEATED_BYTES = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM g),
f AS (SELECT s, min(doc_id) AS first_id FROM s GROUP BY s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM s JOIN f USING (s) WHERE doc_id > first_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@register
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed: every url of the table whose host has the label LISTED_LABEL."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").filter(F.array_contains(F.split(url_filter.host(F.col("url")), r"\."), LISTED_LABEL))
    return url_filter.filter_urls(pages, SITE_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE["op2_url_filter"] = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
k AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS key,
      CASE WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
           WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
           WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
           WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
           WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule FROM u),
listed AS (SELECT DISTINCT key FROM k WHERE list_contains(string_split(host, '.'), 'ads-track'))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM k"""


@register
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


@register
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), 3, 3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), "found")
    hit, total = F.col("found.n_hit"), F.col("found.n_words")
    return found.select("doc_id", total.alias("n_words"), hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), ((hit > 0) & (hit * 20 >= total)).alias("contaminated"))


ORACLE["op6_decontaminate"] = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM t),
item AS (SELECT id, w, least(len(w), 13) AS n FROM w WHERE kind = 1 AND len(w) > 0),
win AS (SELECT DISTINCT id AS item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item)),
doc AS (SELECT id AS doc_id, w, len(w) AS total FROM w WHERE kind = 0),
place AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, total, n, unnest(range(1, total - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE total >= n)),
found AS (SELECT doc_id, i, n, item_id FROM place JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS line FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(total AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(line, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= total AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


@register
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, NEAREST)


@register
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.size(pii.of_kinds("pii", [k])).cast("long").alias(f"n_{k}") for k in pii.BASE]
    base = pii.of_kinds("pii", pii.BASE)
    return found.select("doc_id", *count, F.sha2(pii.as_digest(base), 256).alias("base_sha256"), pii.as_digest(F.col("pii")).alias("spans"))


@register
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
                        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["containment"])), F.lit(0.0)).alias("best_containment"))


@register
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", token_counts.n_bytes().alias("n_bytes"), "n_tokens", (F.col("n_tokens") > MOST_TOKENS).alias("over_limit"))


@register
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, F.col("gone"), digest=True)


@register
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, filters = filter_audit.text_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return filter_audit.filter_audit(docs, table(spark, sf_dir, "labels"), filters)


ORACLE["op12_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
first AS (SELECT t, min(doc_id) AS first_id FROM t GROUP BY t),
w AS (SELECT doc_id, part, t, first_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t JOIN first USING (t)),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
             CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
             CASE WHEN first_id < doc_id THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN told USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS here, regexp_matches(fails, '[' || before || '_]') AS gone FROM c, s),
g AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
      FROM r GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""


@register
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.suffix_dedup(docs, REPEATED_BYTES, keep="none")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return found.select("doc_id", n.alias("n_bytes"), (n - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
