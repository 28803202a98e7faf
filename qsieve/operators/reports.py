"""Report datasets.

Every report is a DataFrame of rows (one per finding, rule, or repository)
written with an ordinary writer (`df.write.json/parquet/csv`).  Document
assembly into one JSON per repository is left to the writer side: a
repository's findings are never collected into one array in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import scalars as SC
from .enrich import finding_order
from .summary import readiness_score, score_band


js_number = SC.js_number


def sarif_rules(findings: DataFrame) -> DataFrame:
    """A8 + K3 rules: one entry per rule id (safe ones included) taken from
    the rule's first finding in report order."""
    f = finding_order(findings)
    first = f.groupBy("repo", "rule_id").agg(F.min_by(
        F.struct("algorithm", "description", "severity", "replacement"), F.col("ord")).alias("r"))
    return first.select(
        "repo", "rule_id", F.col("r.algorithm").alias("short_description"),
        F.col("r.description").alias("full_description"),
        SC.sarif_level(F.col("r.severity")).alias("level"),
        F.when(F.col("r.replacement").isNotNull() & (F.col("r.replacement") != ""),
               F.concat(F.lit("Replace with: "), F.col("r.replacement")))
        .otherwise(F.lit("No migration needed")).alias("help_text"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """K3 results: non-safe findings with level, message and region
    (missing line/column default to 1)."""
    repl = F.col("replacement")
    msg = F.concat(F.col("algorithm"), F.lit(": "), F.col("description"),
                   F.when(repl.isNotNull() & (repl != ""), F.concat(F.lit(". Replace with: "), repl))
                   .otherwise(F.lit("")))
    return findings.where(F.col("severity") != "safe").select(
        "repo", "rule_id", SC.sarif_level(F.col("severity")).alias("level"), msg.alias("message"),
        F.col("file").alias("uri"), F.coalesce("line", F.lit(1)).cast("long").alias("start_line"),
        F.coalesce("column", F.lit(1)).cast("long").alias("start_column"), "confidence", "effort")


def cbom_components(findings: DataFrame) -> DataFrame:
    """K2: one CycloneDX 1.6 `crypto-asset` component per finding, flattened
    (crypto properties, evidence occurrence, properties as a joined string)."""
    sev, cat, repl = F.col("severity"), F.col("category"), F.col("replacement")
    has_repl = repl.isNotNull() & (repl != "")
    p = C.PROPERTY_PREFIX
    props = F.concat_ws(
        ";", F.concat(F.lit(p + "severity="), sev),
        F.concat(F.lit(p + "confidence="), js_number(F.col("confidence"))),
        F.concat(F.lit(p + "effort="), F.col("effort")),
        F.concat(F.lit(p + "detectionMethod="), F.col("detection_method")),
        F.when(has_repl, F.concat(F.lit(p + "replacement="), repl)))
    return findings.select(
        "repo", SC.bom_ref(F.col("rule_id"), F.col("file"), F.col("line")).alias("bom_ref"),
        F.lit("crypto-asset").alias("type"), F.col("algorithm").alias("name"), "description",
        SC.asset_type(cat).alias("asset_type"), SC.primitive(cat).alias("primitive"),
        F.col("algorithm").alias("variant"), SC.crypto_function(cat).alias("crypto_function"),
        SC.classical_level(sev).cast("long").alias("classical_security_level"),
        SC.nist_quantum_level(sev).cast("long").alias("nist_quantum_security_level"),
        F.col("file").alias("location"), F.col("line").cast("long").alias("line"),
        F.col("column").cast("long").alias("offset"), F.col("snippet").alias("symbol"),
        F.when(has_repl, F.concat(F.lit("Recommended replacement: "), repl)).alias("additional_context"),
        props.alias("properties"))


SEVERITY_ICONS = {"critical": "!!", "high": "!", "medium": "~", "low": "-", "safe": "ok"}


def report_rows(findings: DataFrame) -> DataFrame:
    """K4 + A9: text/table report rows grouped by severity in rank order,
    with the size of the severity group (a per-(repo, severity) count joined
    back — partial aggregate, no collect)."""
    groups = findings.groupBy("repo", "severity").agg(F.count(F.lit(1)).cast("long").alias("group_size"))
    f = findings.join(groups, ["repo", "severity"])
    n = F.col("occurrences")
    return f.select(
        "repo", "severity", SC.severity_rank("severity").cast("long").alias("severity_rank"),
        F.concat(F.lit("--- "), F.upper("severity"), F.lit(" ("), F.col("group_size").cast("string"),
                 F.lit(") ---")).alias("group_header"),
        F.concat(F.lit("["), SC.lookup(SEVERITY_ICONS, F.col("severity")), F.lit("] "), F.col("algorithm"),
                 F.lit(" — "), F.col("description"), SC.occurrence_label(F.coalesce(n, F.lit(1))))
        .alias("label"),
        SC.location_label(F.col("file"), F.col("line")).alias("location"), "snippet",
        F.col("replacement").alias("fix"), SC.confidence_percent(F.col("confidence")).alias("confidence_pct"),
        "effort", F.col("detection_method").alias("via"), SC.category_label(F.col("category"))
        .alias("category_label"), "rule_id", "file")


def dashboard(summary: DataFrame) -> DataFrame:
    """K5: per repository severity/category counts, files, findings, score,
    score band and readiness status."""
    score = readiness_score(F.col("safe"), F.col("findings_total"))
    return summary.select(
        "repo", *C.SEVERITIES, *C.CATEGORIES, "files_scanned", "findings_total",
        score.alias("pqc_score"), score_band(score).alias("score_band"),
        F.when(F.col("pqc_ready"), F.lit("PQC READY")).otherwise(F.lit("NOT PQC READY")).alias("status"))


def serial_number(*parts: Column) -> Column:
    """`urn:uuid:` serial, name-based (md5 of the parts, formatted as a
    UUID) so a re-run of the same scan gets the same serial."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                                                    F.substring(h, 13, 4), F.substring(h, 17, 4),
                                                    F.substring(h, 21, 12)))


def cbom_header(summary: DataFrame, timestamp: str) -> DataFrame:
    """K2 document header per repository: format, spec version, serial,
    timestamp, tool and target component, and the component count."""
    return summary.select(
        "repo", F.lit("CycloneDX").alias("bom_format"), F.lit("1.6").alias("spec_version"),
        serial_number(F.col("repo"), F.lit(timestamp)).alias("serial_number"),
        F.lit(1).cast("long").alias("version"), F.lit(timestamp).alias("timestamp"),
        F.lit(C.TOOL_NAME).alias("tool_name"), F.lit(C.TOOL_VERSION).alias("tool_version"),
        F.col("repo").alias("target_name"), F.col("findings_total").alias("components"))


def json_summary(summary: DataFrame, timestamp: str) -> DataFrame:
    """K1 summary object per repository (filesScanned, findingsTotal,
    bySeverity, byCategory, pqcReady) as JSON."""
    obj = F.struct(F.col("files_scanned").alias("filesScanned"),
                   F.col("findings_total").alias("findingsTotal"),
                   F.struct(*[F.col(s) for s in C.SEVERITIES]).alias("bySeverity"),
                   F.struct(*[F.col(c) for c in C.CATEGORIES]).alias("byCategory"),
                   F.col("pqc_ready").alias("pqcReady"))
    return summary.select("repo", F.lit(timestamp).alias("timestamp"),
                          F.to_json(F.struct(F.col("repo").alias("target"), obj.alias("summary")))
                          .alias("json"))


def json_findings(findings: DataFrame, timestamp: str) -> DataFrame:
    """K1 as JSON lines: one object per finding (nested location; null
    fields dropped like `to_json`'s default) plus the scan timestamp."""
    loc = F.struct(F.col("file"), F.col("line"), F.col("column"), F.col("snippet"))
    obj = F.struct(F.col("rule_id").alias("ruleId"), "description", "severity", "category", "algorithm",
                   "replacement", "effort", loc.alias("location"),
                   F.col("detection_method").alias("detectionMethod"), "confidence", "occurrences")
    return findings.select("repo", F.lit(timestamp).alias("timestamp"), F.to_json(obj).alias("json"))
