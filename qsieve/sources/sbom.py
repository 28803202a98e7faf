"""SBOM documents → component rows.

`documents(sbom_id, doc_ord, content, format_hint)` → `components(sbom_id,
doc_ord, pos, format, name, version, purl, type, original)`.  Format: the hint
wins, else `bomFormat = 'CycloneDX'` → cyclonedx, a string `spdxVersion` →
spdx, else the document is undetected (format null; callers quarantine it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DOC = "struct<bomFormat: string, spdxVersion: string, components: array<string>, packages: array<string>>"
_REFS = "array<struct<referenceType: string, referenceLocator: string>>"


def detect_format(content: Column, hint: Column | None = None) -> Column:
    j = F.from_json(content, _DOC)
    detected = (F.when(j["bomFormat"] == "CycloneDX", F.lit("cyclonedx"))
                .when(j["spdxVersion"].isNotNull(), F.lit("spdx")))
    return F.coalesce(hint, detected) if hint is not None else detected


def components(docs: DataFrame) -> DataFrame:
    """One row per CycloneDX component / SPDX package, in document
    order (doc_ord, pos).  Undetected documents fail the job; set them apart
    with `undetected_documents` first."""
    hint = F.col("format_hint") if "format_hint" in docs.columns else None
    j = F.from_json(F.col("content"), _DOC)
    fmt = detect_format(F.col("content"), hint)
    items = F.when(fmt == "cyclonedx", F.coalesce(j["components"], F.array().cast("array<string>"))) \
        .when(fmt == "spdx", F.coalesce(j["packages"], F.array().cast("array<string>"))) \
        .otherwise(F.raise_error(F.concat(F.lit("Cannot detect SBOM format of "),
                                          F.coalesce(F.col("sbom_id").cast("string"), F.lit("null")))).cast("array<string>"))
    ex = (docs.select("sbom_id", "doc_ord", fmt.alias("format"),
                      F.posexplode(items).alias("pos", "original"))
          .withColumn("pos", F.col("pos").cast("long")))
    o = F.col("original")
    refs = F.from_json(F.get_json_object(o, "$.externalRefs"), _REFS)
    purl_ref = F.try_element_at(F.filter(refs, lambda r: r["referenceType"] == "purl"), F.lit(1))
    cdx = F.col("format") == "cyclonedx"
    name = F.coalesce(F.get_json_object(o, "$.name"), F.lit(""))
    version = F.when(cdx, F.get_json_object(o, "$.version")).otherwise(F.get_json_object(o, "$.versionInfo"))
    purl = F.when(cdx, F.get_json_object(o, "$.purl")).otherwise(purl_ref["referenceLocator"])
    typ = F.when(cdx, F.coalesce(F.get_json_object(o, "$.type"), F.lit("library"))).otherwise(F.lit("library"))
    return ex.select("sbom_id", "doc_ord", "pos", "format", name.alias("name"),
                     F.nullif(version, F.lit("")).alias("version"),
                     F.nullif(purl, F.lit("")).alias("purl"), typ.alias("type"), "original")


def undetected_documents(docs: DataFrame) -> DataFrame:
    """Documents whose format is neither hinted nor detectable — the
    quarantine of inputs the reference rejects with an error."""
    hint = F.col("format_hint") if "format_hint" in docs.columns else None
    return docs.where(detect_format(F.col("content"), hint).isNull())
