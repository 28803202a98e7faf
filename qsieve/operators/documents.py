"""Whole SARIF, CBOM and JSON documents per repository, as rows.

A document is a run of fragments: fixed text (even sections) around lists
(odd sections), one fragment per list element.  `document_fragments` gives each
fragment its text, its place in its list and its byte offset in the document,
by running sums over one range exchange (operators/order.py): a repository's
document is never built in one row or task.  `sinks/documents.py` writes the
fragments at their offsets.

Lists stand in report order: findings by severity, file and first appearance,
rules by their first finding, violations by finding, then policy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import scalars as SC
from .order import report_order, running
from .reports import serial_number

FORMATS = ["sarif", "cbom", "json"]
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
RULE_TAGS = ["security", "cryptography", "post-quantum"]
N_KEYS = 8  # the report order's columns, then the policy's ordinal


def _keys(findings: DataFrame) -> list[Column]:
    sev, file, *at, rule = report_order(findings)
    return [c.alias(f"o{i}") for i, c in enumerate([sev, file, *(a.cast("long") for a in at), rule, F.lit(-1)])]


_KEY_TYPES = ["int", "string", "long", "long", "long", "long", "string", "int"]


def _replacement() -> tuple[Column, Column]:
    r = F.col("replacement")
    return r, r.isNotNull() & (r != "")


def _text(c: Column) -> Column:
    return F.struct(c.alias("text"))


def sarif_rule() -> Column:
    """A rule's entry, from its first finding."""
    r, has = _replacement()
    return F.to_json(F.struct(
        F.col("rule_id").alias("id"), _text(F.col("algorithm")).alias("shortDescription"), _text(F.col("description")).alias("fullDescription"),
        F.struct(SC.sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration"),
        _text(F.when(has, F.concat(F.lit("Replace with: "), r)).otherwise("No migration needed")).alias("help"),
        F.struct(F.array(*map(F.lit, RULE_TAGS)).alias("tags")).alias("properties")))


def sarif_result() -> Column:
    """K3: the result of a finding that is not safe."""
    r, has = _replacement()
    region = F.struct(F.coalesce("line", F.lit(1)).alias("startLine"), F.coalesce("column", F.lit(1)).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), SC.sarif_level(F.col("severity")).alias("level"),
        _text(F.concat("algorithm", F.lit(": "), "description", F.when(has, F.concat(F.lit(". Replace with: "), r)).otherwise(""))).alias("message"),
        F.array(place).alias("locations"), F.struct("confidence", "effort").alias("properties")))


def cbom_component() -> Column:
    """K2: the crypto-asset component of a finding, nested as the format has it."""
    r, has = _replacement()
    sev, cat = F.col("severity"), F.col("category")
    name = lambda n, v: F.struct(F.lit(C.PROPERTY_PREFIX + n).alias("name"), v.alias("value"))
    props = F.array(name("severity", sev), name("confidence", SC.js_number(F.col("confidence"))), name("effort", F.col("effort")), name("detectionMethod", F.col("detection_method")))
    crypto = F.struct(
        SC.asset_type(cat).alias("assetType"),
        F.struct(SC.primitive(cat).alias("primitive"), F.col("algorithm").alias("variant"), F.array(SC.crypto_function(cat)).alias("cryptoFunctions")).alias("algorithmProperties"),
        SC.classical_level(sev).alias("classicalSecurityLevel"), SC.nist_quantum_level(sev).alias("nistQuantumSecurityLevel"))
    occurrence = F.struct(F.col("file").alias("location"), "line", F.col("column").alias("offset"), F.col("snippet").alias("symbol"),
                          F.when(has, F.concat(F.lit("Recommended replacement: "), r)).alias("additionalContext"))
    return F.to_json(F.struct(
        F.lit("crypto-asset").alias("type"), SC.bom_ref(F.col("rule_id"), F.col("file"), F.col("line")).alias("bom-ref"), F.col("algorithm").alias("name"), "description",
        crypto.alias("cryptoProperties"), F.struct(F.array(occurrence).alias("occurrences")).alias("evidence"),
        F.when(has, F.concat(props, F.array(name("replacement", r)))).otherwise(props).alias("properties")))


def finding_object() -> Column:
    """K1: a finding as its result object has it (null members left out)."""
    return F.struct(
        F.col("rule_id").alias("ruleId"), "description", "severity", "category", "algorithm", "replacement", "effort",
        F.struct("file", "line", "column", "snippet").alias("location"), F.col("detection_method").alias("detectionMethod"), "confidence", "occurrences")


def _fragments(rows: DataFrame, fmt: str, section: int, text: Column, keys: list[Column]) -> DataFrame:
    return rows.select("repo", F.lit(fmt).alias("format"), F.lit(section).alias("section"), text.alias("fragment"), *keys)


def _fixed(summary: DataFrame, fmt: str, texts: list[Column | str]) -> list[DataFrame]:
    none = [F.lit(None).cast(t).alias(f"o{i}") for i, t in enumerate(_KEY_TYPES)]
    return [_fragments(summary, fmt, 2 * i, F.lit(t) if isinstance(t, str) else t, none) for i, t in enumerate(texts)]


def sarif_fragments(findings: DataFrame, summary: DataFrame) -> DataFrame:
    head = F.concat(F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{C.TOOL_NAME}","version":"{C.TOOL_VERSION}","rules":['))
    keys = _keys(findings)
    first = findings.groupBy("repo", "rule_id").agg(F.min_by(F.struct("algorithm", "description", "severity", "replacement"), F.struct(*keys)).alias("r"),
                                                     F.min(F.struct(*keys)).alias("k"))
    rules = first.select("repo", "rule_id", "r.*", "k.*")
    parts = [*_fixed(summary, "sarif", [head, ']}},"results":[', "]}]}"]),
             _fragments(rules, "sarif", 1, sarif_rule(), [F.col(f"o{i}") for i in range(N_KEYS)]),
             _fragments(findings.where(F.col("severity") != "safe"), "sarif", 3, sarif_result(), keys)]
    return reduce(DataFrame.unionByName, parts)


def cbom_fragments(findings: DataFrame, summary: DataFrame, timestamp: str) -> DataFrame:
    tool = F.struct(F.lit("application").alias("type"), F.lit(C.TOOL_NAME).alias("name"), F.lit(C.TOOL_VERSION).alias("version"))
    target = F.struct(F.lit("application").alias("type"), F.col("repo").alias("name"), F.lit("target").alias("bom-ref"))
    meta = F.struct(F.lit(timestamp).alias("timestamp"), F.struct(F.array(tool).alias("components")).alias("tools"), target.alias("component"))
    head = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), serial_number(F.col("repo"), F.lit(timestamp)).alias("serialNumber"),
                              F.lit(1).alias("version"), meta.alias("metadata")))
    opened = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"components":['))
    parts = [*_fixed(summary, "cbom", [opened, "]}"]), _fragments(findings, "cbom", 1, cbom_component(), _keys(findings))]
    return reduce(DataFrame.unionByName, parts)


def json_fragments(findings: DataFrame, summary: DataFrame, timestamp: str, violations: DataFrame | None = None) -> DataFrame:
    """violations: rows of evaluate_policies with the finding's own columns kept
    (`FINDING_KEPT`); the document lists them only where policies were given."""
    counts = F.struct(F.col("files_scanned").alias("filesScanned"), F.col("findings_total").alias("findingsTotal"), F.struct(*C.SEVERITIES).alias("bySeverity"),
                      F.struct(*C.CATEGORIES).alias("byCategory"), F.col("pqc_ready").alias("pqcReady"))
    head = F.to_json(F.struct(F.lit(timestamp).alias("timestamp"), F.col("repo").alias("target"), counts.alias("summary")))
    opened = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"findings":['))
    parts = [*_fixed(summary, "json", [opened, "]}"] if violations is None else [opened, '],"policyViolations":[', "]}"]),
             _fragments(findings, "json", 1, F.to_json(finding_object()), _keys(findings))]
    if violations is not None:
        item = F.to_json(F.struct(F.col("policy_id").alias("policyId"), F.col("policy_description").alias("description"), "action", finding_object().alias("finding"), "message", "deadline"))
        keys = [*_keys(violations)[:-1], F.col("policy_ord").cast("int").alias(f"o{N_KEYS - 1}")]
        parts.append(_fragments(violations, "json", 3, item, keys))
    return reduce(DataFrame.unionByName, parts)


#: Columns of a finding that its object and its place in report order need.
FINDING_KEPT = ["description", "replacement", "effort", "column", "snippet", "detection_method", "occurrences", "phase", "rule_ord", "first_pos"]


def document_fragments(parts: DataFrame) -> DataFrame:
    """(repo, format, section, position, n_bytes, offset, fragment): position is
    the fragment's place (from 1) in its list, 1 for fixed text; a list's
    fragments but the first begin with their comma."""
    rows = parts.withColumn("doc", F.concat("format", F.lit("/"), "repo"))
    sums = running(rows, "doc", ["section", *(f"o{i}" for i in range(N_KEYS))],
                   {"_bytes": F.octet_length("fragment"), "_first": (F.col("section") == 1).cast("int"), "_second": (F.col("section") == 3).cast("int")})
    before = F.when(F.col("section") == 1, F.col("_first")).when(F.col("section") == 3, F.col("_second")).otherwise(F.lit(0).cast("long"))
    commas = sum((F.greatest(F.col(c) - 1, F.lit(0)) for c in ("_first", "_second")), F.lit(0))
    text = F.when(before > 0, F.concat(F.lit(","), "fragment")).otherwise(F.col("fragment"))
    return sums.select("repo", "format", "section", (before + 1).alias("position"), F.octet_length(text).cast("long").alias("n_bytes"),
                       (F.col("_bytes") + commas).alias("offset"), text.alias("fragment"))
