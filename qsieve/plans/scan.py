"""End-to-end scan: files (+ manifests, endpoints, policies, SBOM) → results.

`scan()` composes the DataFrame functions lazily; nothing runs until the
caller acts on one of the returned DataFrames.  Catalyst plans each output
independently; `materialize=True` checkpoints the de-duplicated findings into
the shared checkpoint directory when several outputs are consumed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..operators import findings as FD
from ..operators import summary as SM
from ..operators.lines import regex_findings_for
from ..sources.files import discover, readable, with_file_meta  # noqa: F401


@dataclass
class ScanResult:
    discovered: DataFrame      # file_meta rows of discovered files
    raw_findings: DataFrame    # all branches, before filters
    findings: DataFrame        # filtered (+ de-duplicated) findings
    summary: DataFrame         # one row per repository
    violations: DataFrame | None = None
    enriched_components: DataFrame | None = None   # CycloneDX
    enriched_packages: DataFrame | None = None     # SPDX


def detect(files: DataFrame, *, rules=None, usage: bool = True, dependencies: bool = False,
           endpoints: DataFrame | None = None, include: list[str] | None = None,
           exclude: list[str] | None = None, max_regex_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Discovery + every detection branch; returns (discovered, raw findings).
    Manifests are read from the files table directly (root-level only), as
    the dependency scanners do not go through discovery."""
    from ..operators.usage import usage_findings
    from ..operators.dependencies import dependency_findings
    from ..operators.network import endpoint_findings

    discovered = with_file_meta(discover(files, include, exclude))
    text = readable(discovered)
    branches = [regex_findings_for(text, rules, max_regex_chars)]
    if usage:
        branches.append(usage_findings(text, rules))
    if dependencies:
        branches.append(dependency_findings(files))
    if endpoints is not None:
        branches.append(endpoint_findings(endpoints))
    return discovered, FD.union_findings(*branches)


def scan(files: DataFrame, *, rules=None, usage: bool = True, dependencies: bool = False,
         endpoints: DataFrame | None = None, include: list[str] | None = None,
         exclude: list[str] | None = None, min_confidence: float = C.DEFAULT_MIN_CONFIDENCE,
         min_severity: str = "safe", dedupe: bool = True, policies: DataFrame | None = None,
         now: str | None = None, sbom_components: DataFrame | None = None,
         max_regex_chars: int | None = None, materialize: bool = False) -> ScanResult:
    discovered, raw = detect(files, rules=rules, usage=usage, dependencies=dependencies,
                             endpoints=endpoints, include=include, exclude=exclude, max_regex_chars=max_regex_chars)
    found = FD.finalize(FD.filter_findings(raw, min_confidence, min_severity), dedupe)
    if materialize:
        from ..session import materialize as _m
        found = _m(found)
    result = ScanResult(discovered, raw, found, SM.summary(found, discovered))
    if policies is not None:
        from ..operators.policy import evaluate_policies
        result.violations = evaluate_policies(found, policies, now)
    if sbom_components is not None:
        from ..operators.enrich import enrich_cyclonedx, enrich_spdx
        per_format = sbom_components.groupBy("sbom_id").agg(F.bool_or(F.col("format") == "cyclonedx").alias("cdx"),
                                                            F.bool_or(F.col("format") == "spdx").alias("spdx"))
        owned = lambda f: found.join(per_format.where(f), found["repo"] == per_format["sbom_id"], "left_semi")
        result.enriched_components = enrich_cyclonedx(sbom_components, owned("cdx"))
        result.enriched_packages = enrich_spdx(sbom_components, owned("spdx"))
    return result
