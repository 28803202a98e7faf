"""Registered queries: name → (spark, sf_dir) → DataFrame, and oracle SQL.

Every query reads the driver's tables (whole tables, every row) and derives
its inputs from them with Spark (plans/corpus.py).  Integer outputs are
BIGINT, fractional outputs DOUBLE, so schemas line up with the DuckDB twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as FD
from ..operators import summary as SM
from ..operators.lines import regex_findings
from ..operators.usage import usage_findings
from ..operators import dependencies as DP
from ..operators.network import endpoint_findings
from ..sources.endpoints import parse_endpoint_spec
from ..sources.policies import policies_frame
from ..operators import policy as PL
from ..operators import enrich as EN
from ..sources import sbom as SB
from ..sources.rules import rules_frame
from ..operators import documents as DOC
from ..operators import order as OR
from ..operators import reports as RP
from ..operators.lines import regex_findings_join
from ..session import materialize, shared_folder
from ..sinks.tree import write_tree
from ..sources.files import discover, read_tree, readable, with_file_meta
from . import corpus as CP
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _bigint(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# ------------------------------------------------------------------ inputs

def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_file_meta(discover(CP.corpus_files(spark, sf_dir)))


def regex_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_findings(readable(discovered_files(spark, sf_dir)))


_FILES = ("files", O.files_sql())
_DISC = ("discovered", O.discovered_sql())
_READ = ("readable", O.readable_sql())
_RAW_REGEX = ("raw_regex", O.regex_findings_sql())

FINDING_OUT = ["repo", "rule_id", "severity", "category", "algorithm", "file", "line", "column",
               "snippet", "detection_method", "confidence", "phase"]


def _finding_out_sql(src: str, extra: str = "") -> str:
    return (f"SELECT repo, rule_id, severity, category, algorithm, file, CAST(line AS BIGINT) AS line, "
            f"CAST(\"column\" AS BIGINT) AS \"column\", snippet, detection_method, confidence, "
            f"CAST(phase AS BIGINT) AS phase{extra} FROM {src}")


# ------------------------------------------------------------------ queries

@register("file_inventory", O.with_ctes([("files", f"{O.files_sql()} UNION ALL {O.inventory_files_sql()}"), _DISC], """
SELECT repo, path, language, is_binary, n_chars FROM discovered"""))
def q_file_inventory(spark, sf_dir):
    """Discovered files with language, binary flag and size; besides
    the corpus, every document under an excluded, hidden, binary or odd path."""
    files = CP.corpus_files(spark, sf_dir).unionByName(CP.inventory_files(spark, sf_dir))
    return with_file_meta(discover(files)).select("repo", "path", "language", "is_binary", "n_chars")


# a source may be null or no folder name: the tree's folders are its bytes in hex
@register("tree_inventory", O.with_ctes([("files", f"{O.files_sql()} UNION ALL {O.inventory_files_sql()}"), _DISC], """
SELECT 'r' || hex(coalesce(repo, '')) AS repo, path, language, is_binary, n_chars, sha256(content) AS content_sha256
FROM discovered WHERE content IS NOT NULL"""))
def q_tree_inventory(spark, sf_dir):
    """The files of `file_inventory` written as a tree in the shared
    folder, which is listed level by level and read back by tasks."""
    files = CP.corpus_files(spark, sf_dir).unionByName(CP.inventory_files(spark, sf_dir))
    root = shared_folder(spark, "tree")
    write_tree(files.withColumn("repo", F.concat(F.lit("r"), F.hex(F.coalesce("repo", F.lit(""))))), root)
    return with_file_meta(discover(read_tree(spark, root))).select(
        "repo", "path", "language", "is_binary", "n_chars", F.sha2("content", 256).alias("content_sha256"))


@register("regex_hits", O.with_ctes([_FILES, _DISC, _READ, _RAW_REGEX],
                                    _finding_out_sql("raw_regex")))
def q_regex_hits(spark, sf_dir):
    """J1 with P2–P10: every (line, rule) hit with column, snippet, confidence."""
    return _bigint(regex_raw(spark, sf_dir).select(*FINDING_OUT), ["line", "column", "phase"])


@register("regex_readiness", O.with_ctes(
    [_FILES, _DISC, _READ, _RAW_REGEX, ("filtered", O.filtered_sql("raw_regex")),
     ("deduped", O.dedupe_sql("filtered"))], O.summary_sql("deduped", "discovered")))
def q_regex_readiness(spark, sf_dir):
    """A2–A7 over the regex branch: filter, de-duplicate, summarise per repo."""
    disc = discovered_files(spark, sf_dir)
    found = FD.dedupe(FD.filter_findings(regex_findings(readable(disc))))
    return SM.summary(found, disc)


def code_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regex and usage branches over the planted corpus."""
    text = readable(discovered_files(spark, sf_dir))
    return FD.union_findings(regex_findings(text), usage_findings(text))


_RAW_USAGE = ("raw_usage", O.usage_findings_sql())
_RAW_CODE = ("raw_code", "SELECT * FROM raw_regex UNION ALL SELECT * FROM raw_usage")
_CODE_FOUND = [_FILES, _DISC, _READ, _RAW_REGEX, _RAW_USAGE, _RAW_CODE,
               ("filtered", O.filtered_sql("raw_code")), ("deduped", O.dedupe_sql("filtered"))]


@register("usage_findings", O.with_ctes([_FILES, _DISC, _READ, _RAW_USAGE],
                                        _finding_out_sql("raw_usage")))
def q_usage_findings(spark, sf_dir):
    """U1–U7 + J2–J5: import/require/call/option sites of JS/TS files."""
    text = readable(discovered_files(spark, sf_dir))
    return _bigint(usage_findings(text).select(*FINDING_OUT), ["line", "column", "phase"])


@register("findings", O.with_ctes(_CODE_FOUND, _finding_out_sql("deduped", ", occurrences")))
def q_findings(spark, sf_dir):
    """X1 + P11/P12 + W1/A1: filtered, de-duplicated findings (usage beats regex)."""
    found = FD.dedupe(FD.filter_findings(code_raw(spark, sf_dir)))
    return _bigint(found.select(*FINDING_OUT, "occurrences"), ["line", "column", "phase"])


@register("readiness", O.with_ctes(_CODE_FOUND, O.summary_sql("deduped", "discovered")))
def q_readiness(spark, sf_dir):
    """Flagship: readiness per repository over regex + usage findings."""
    disc = discovered_files(spark, sf_dir)
    text = readable(disc)
    found = FD.dedupe(FD.filter_findings(
        FD.union_findings(regex_findings(text), usage_findings(text))))
    return SM.summary(found, disc)


# ------------------------------------------------------------ dependencies

_MFILES = ("mfiles", O.manifests_sql())
DEP_OUT = ["repo", "rule_id", "severity", "category", "algorithm", "file", "snippet",
           "detection_method", "confidence", "phase"]


def _dep_out_sql(src: str) -> str:
    return f"SELECT repo, rule_id, severity, category, algorithm, file, snippet, detection_method, " \
           f"confidence, CAST(phase AS BIGINT) AS phase FROM ({src})"


def _dep_query(name: str, fn, sql_fn, doc: str):
    def q(spark, sf_dir):
        return _bigint(fn(CP.manifest_files(spark, sf_dir)).select(*DEP_OUT), ["phase"])
    q.__doc__ = doc
    register(name, O.with_ctes([_MFILES], _dep_out_sql(sql_fn())))(q)


_dep_query("deps_npm", lambda f: DP.dependency_findings(f, ["npm"]), O.npm_sql, "S13 + J6: package.json ⋈ known npm packages.")
_dep_query("deps_cargo", lambda f: DP.dependency_findings(f, ["cargo"]), O.cargo_sql, "S14 + J7: Cargo.toml ⋈ known crates.")
_dep_query("deps_go", lambda f: DP.dependency_findings(f, ["go"]), O.go_sql, "S15 + J8: go.mod ⋈ known modules (prefix).")
_dep_query("deps_pip", lambda f: DP.dependency_findings(f, ["pip"]), O.pip_sql,
           "S16/S17 + J9/J10: requirements ⋈ known; pyproject ▷ requirements.")
_dep_query("deps_java", lambda f: DP.dependency_findings(f, ["java"]), O.java_sql,
           "S18/S19 + J11/J12: Gradle/Maven ⋈ known artifacts; first source per rule id.")


# --------------------------------------------------------------- endpoints

@register("endpoint_findings", O.with_ctes([("obs", O.observations_sql())],
                                           _finding_out_sql("(" + O.endpoint_findings_sql() + ")")))
def q_endpoint_findings(spark, sf_dir):
    """S21 + N1–N6: TLS/SSH observations classified into findings."""
    f = endpoint_findings(CP.endpoint_observations(spark, sf_dir))
    return _bigint(f.select(*FINDING_OUT), ["line", "column", "phase"])


@register("endpoint_specs", O.endpoint_specs_sql())
def q_endpoint_specs(spark, sf_dir):
    """`[tls://|ssh://]host[:port]` specs → host, port, protocol."""
    s = CP.endpoint_specs(spark, sf_dir)
    p = parse_endpoint_spec(F.col("spec"))
    return s.select("event_id", "spec", p["host"].alias("host"), p["port"].alias("port"),
                    p["protocol"].alias("protocol"))


# ----------------------------------------------------------------- policies

def code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered, de-duplicated findings of the planted corpus (regex + usage)."""
    return FD.dedupe(FD.filter_findings(code_raw(spark, sf_dir)))


def shared_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code findings for a query that consumes them more than once: a
    reliable checkpoint in the session's checkpoint directory, so the scan
    runs once (Catalyst would otherwise re-plan each consumer separately)."""
    return materialize(code_findings(spark, sf_dir))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pol = policies_frame(spark, CP.POLICIES)
    return PL.evaluate_policies(code_findings(spark, sf_dir), pol, CP.POLICY_NOW)


_VIOL = ("violations", O.violations_sql("deduped"))
VIOL_OUT = ["repo", "policy_id", "description", "action", "message", "deadline", "rule_id",
            "severity", "category", "algorithm", "file", "line", "confidence"]


@register("policy_violations", O.with_ctes(_CODE_FOUND + [_VIOL], f"""
SELECT {', '.join(VIOL_OUT[:-2])}, CAST(line AS BIGINT) AS line, confidence FROM violations"""))
def q_policy_violations(spark, sf_dir):
    """S9 + J13: findings ⋈ policies (theta; deadlines at a fixed instant)."""
    return _bigint(violations(spark, sf_dir).select(*VIOL_OUT), ["line"])


@register("violation_counts", O.with_ctes(_CODE_FOUND + [_VIOL], """
SELECT repo, policy_id, action, CAST(count(*) AS BIGINT) AS violations FROM violations
GROUP BY repo, policy_id, action"""))
def q_violation_counts(spark, sf_dir):
    """Violations per repository, policy and action."""
    return PL.violation_counts(violations(spark, sf_dir))


@register("gate", O.with_ctes(_CODE_FOUND + [_VIOL, ("summary", O.summary_sql("deduped", "discovered"))],
                              O.gate_sql("summary", "violations")))
def q_gate(spark, sf_dir):
    """A10: CI exit code per repository (2 block violation, 1 critical/high, 0)."""
    disc = discovered_files(spark, sf_dir)
    found = shared_findings(spark, sf_dir)
    viol = PL.evaluate_policies(found, policies_frame(spark, CP.POLICIES), CP.POLICY_NOW)
    return PL.gate(SM.summary(found, disc), viol)


# --------------------------------------------------------------------- SBOM

def sbom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SB.components(CP.sbom_documents(spark, sf_dir))


def shared_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component rows for a query that consumes them more than once: read from
    a reliable checkpoint, so every SBOM document is parsed once."""
    return materialize(sbom_components(spark, sf_dir))


_COMPS = ("comps", O.sbom_components_sql())


@register("sbom_components", O.sbom_component_rows_sql())
def q_sbom_components(spark, sf_dir):
    """SBOM documents → format detection → component/package rows."""
    return sbom_components(spark, sf_dir).select("sbom_id", "doc_ord", "pos", "format", "name", "version",
                                                  "purl", "type")


@register("sbom_cyclonedx", O.with_ctes(_CODE_FOUND + [_COMPS], "SELECT * FROM (" + O.sbom_cyclonedx_sql("deduped", "comps") + ")"))
def q_sbom_cyclonedx(spark, sf_dir):
    """J14/J16/J17 + A18 + K6: enriched CycloneDX components (original + new)."""
    return EN.enrich_cyclonedx(shared_components(spark, sf_dir), shared_findings(spark, sf_dir)).drop("component")


@register("sbom_component_members", O.with_ctes(_CODE_FOUND + [_COMPS], "SELECT * FROM (" + O.sbom_component_members_sql("deduped", "comps") + ")"))
def q_sbom_component_members(spark, sf_dir):
    """K6: the members of every enriched component's JSON: the original's own,
    cryptoProperties, and a new component's evidence."""
    comp = EN.enrich_cyclonedx(shared_components(spark, sf_dir), shared_findings(spark, sf_dir))
    member = {"type": "$.type", "name": "$.name", "version": "$.version", "purl": "$.purl", "asset_type": "$.cryptoProperties.assetType", "variant": "$.cryptoProperties.algorithmProperties.variant",
              "description": "$.description", "location": "$.evidence.occurrences[0].location", "line": "$.evidence.occurrences[0].line", "context": "$.evidence.occurrences[0].additionalContext"}
    return comp.select("sbom_id", *EN.KEY, "origin", *(F.get_json_object("component", path).alias(c) for c, path in member.items()))


@register("sbom_spdx", O.with_ctes(_CODE_FOUND + [_COMPS], "SELECT * FROM (" + O.sbom_spdx_sql("deduped", "comps") + ")"))
def q_sbom_spdx(spark, sf_dir):
    """J15/J16 + A18 + K7: annotated SPDX packages plus one new package per
    unmatched finding."""
    return EN.enrich_spdx(shared_components(spark, sf_dir), shared_findings(spark, sf_dir))


# ------------------------------------------------------------------ reports

_SUMMARY = ("summary", O.summary_sql("deduped", "discovered"))


@register("sarif_rules", O.with_ctes(_CODE_FOUND, O.sarif_rules_sql("deduped")))
def q_sarif_rules(spark, sf_dir):
    """A8 + K3: distinct rules with their first finding (safe included)."""
    return RP.sarif_rules(code_findings(spark, sf_dir))


@register("sarif_results", O.with_ctes(_CODE_FOUND, O.sarif_results_sql("deduped")))
def q_sarif_results(spark, sf_dir):
    """P16 + F2 + F13 + K3: SARIF results for non-safe findings."""
    return RP.sarif_results(code_findings(spark, sf_dir))


@register("cbom_components", O.with_ctes(_CODE_FOUND, O.cbom_sql("deduped")))
def q_cbom_components(spark, sf_dir):
    """K2 + F3–F7 + F9: CycloneDX crypto-asset component per finding."""
    return RP.cbom_components(code_findings(spark, sf_dir))


@register("report_rows", O.with_ctes(_CODE_FOUND, O.report_rows_sql("deduped")))
def q_report_rows(spark, sf_dir):
    """K4 + A9 + F8/F10–F12: text/table report rows with severity groups."""
    return RP.report_rows(shared_findings(spark, sf_dir))


@register("dashboard", O.with_ctes(_CODE_FOUND + [_SUMMARY], O.dashboard_sql("summary")))
def q_dashboard(spark, sf_dir):
    """K5 + A7: dashboard dataset per repository."""
    disc = discovered_files(spark, sf_dir)
    return RP.dashboard(SM.summary(code_findings(spark, sf_dir), disc))


@register("cbom_header", O.with_ctes(_CODE_FOUND + [_SUMMARY], O.cbom_header_sql("summary", CP.POLICY_NOW)))
def q_cbom_header(spark, sf_dir):
    """K2 header + F14: per-repository CBOM document header (name-based serial)."""
    disc = discovered_files(spark, sf_dir)
    return RP.cbom_header(SM.summary(code_findings(spark, sf_dir), disc), CP.POLICY_NOW)


@register("json_findings", O.with_ctes(_CODE_FOUND, O.json_findings_sql("deduped", CP.POLICY_NOW)))
def q_json_findings(spark, sf_dir):
    """K1: JSON-lines result (one object per finding, fixed timestamp)."""
    return RP.json_findings(code_findings(spark, sf_dir), CP.POLICY_NOW)


@register("json_summary", O.with_ctes(_CODE_FOUND + [_SUMMARY], O.json_summary_sql("summary", CP.POLICY_NOW)))
def q_json_summary(spark, sf_dir):
    """K1: the summary object of each repository as JSON."""
    disc = discovered_files(spark, sf_dir)
    return RP.json_summary(SM.summary(code_findings(spark, sf_dir), disc), CP.POLICY_NOW)


@register("violation_labels", O.with_ctes(_CODE_FOUND + [_VIOL], O.violation_labels_sql("violations")))
def q_violation_labels(spark, sf_dir):
    """the label of every violation."""
    label = PL.violation_label(F.col("action"), F.col("policy_id"), F.col("message"), F.col("deadline"))
    return violations(spark, sf_dir).select("repo", "file", "rule_id", label.alias("label"))


# ------------------------------------------------- report order, documents

_ORDERED = ("ordered", O.ordered_sql("deduped"))


@register("findings_ordered", O.with_ctes(_CODE_FOUND + [_ORDERED], _finding_out_sql("ordered", ", occurrences, position")))
def q_findings_ordered(spark, sf_dir):
    """O1–O3: every finding with its place in its repository's report order."""
    return _bigint(OR.ordered(code_findings(spark, sf_dir)).select(*FINDING_OUT, "occurrences", "position"), ["line", "column", "phase"])


def _documents(parts: DataFrame) -> DataFrame:
    return _bigint(DOC.document_fragments(parts), ["section"])


def _with_summary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = shared_findings(spark, sf_dir)
    return found, SM.summary(found, discovered_files(spark, sf_dir))


_DOC_COLS = 'SELECT repo, format, CAST(section AS BIGINT) AS section, position, n_bytes, "offset", fragment FROM'


@register("documents_sarif", O.with_ctes(_CODE_FOUND + [_ORDERED, _SUMMARY], f"{_DOC_COLS} ({O.sarif_documents_sql()})"))
def q_documents_sarif(spark, sf_dir):
    """A17 + K3: the fragments of every repository's SARIF document, at their byte offsets."""
    return _documents(DOC.sarif_fragments(*_with_summary(spark, sf_dir)))


@register("documents_cbom", O.with_ctes(_CODE_FOUND + [_ORDERED, _SUMMARY], f"{_DOC_COLS} ({O.cbom_documents_sql(CP.POLICY_NOW)})"))
def q_documents_cbom(spark, sf_dir):
    """A17 + K2: the fragments of every repository's CycloneDX document."""
    return _documents(DOC.cbom_fragments(*_with_summary(spark, sf_dir), CP.POLICY_NOW))


@register("documents_json", O.with_ctes(_CODE_FOUND + [_ORDERED, _SUMMARY, ("violations_ordered", O.violations_ordered_sql())],
                                        f"{_DOC_COLS} ({O.json_documents_sql(CP.POLICY_NOW)})"))
def q_documents_json(spark, sf_dir):
    """A17 + K1: the fragments of every repository's JSON result, policy violations included."""
    found, summary = _with_summary(spark, sf_dir)
    against = PL.evaluate_policies(found, policies_frame(spark, CP.POLICIES), CP.POLICY_NOW, keep=DOC.FINDING_KEPT)
    return _documents(DOC.json_fragments(found, summary, CP.POLICY_NOW, against))


INCLUDE, EXCLUDE = [r"^src/", r"^app/.*\.ts$"], [r"doc[0-9]*7\."]


@register("scan_options", O.with_ctes(
    [_FILES, ("discovered", O.discovered_sql(include=INCLUDE, exclude=EXCLUDE)), _READ, _RAW_REGEX, _RAW_USAGE, _RAW_CODE,
     ("filtered", O.filtered_sql("raw_code", 80, "high")), ("deduped", O.dedupe_sql("filtered"))],
    _finding_out_sql("deduped", ", occurrences")))
def q_scan_options(spark, sf_dir):
    """Include and exclude patterns, least confidence and severity."""
    from .scan import scan
    found = scan(CP.corpus_files(spark, sf_dir), include=INCLUDE, exclude=EXCLUDE, min_confidence=80, min_severity="high").findings
    return _bigint(found.select(*FINDING_OUT, "occurrences"), ["line", "column", "phase"])


@register("sbom_undetected", "SELECT 'odd' || CAST(p_partkey AS VARCHAR) AS sbom_id FROM part WHERE p_partkey % 4 IN (0, 2)")
def q_sbom_undetected(spark, sf_dir):
    """Documents whose format is neither hinted nor detectable."""
    forms = F.array(*[F.lit(x) for x in ('{"name": "x"}', '{"bomFormat": "CycloneDX"}', "no JSON", '{"spdxVersion": "SPDX-2.3"}')])
    part = CP.read_table(spark, sf_dir, "part")
    docs = part.select(F.concat(F.lit("odd"), F.col("p_partkey").cast("string")).alias("sbom_id"), F.col("p_partkey").alias("doc_ord"),
                       F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int")).alias("content"))
    return SB.undetected_documents(docs).select("sbom_id")


# ------------------------------------------------------------------ rollups

@register("portfolio", O.with_ctes(_CODE_FOUND, O.portfolio_sql("deduped", "discovered")))
def q_portfolio(spark, sf_dir):
    """Per repository files, critical/high/safe, readiness, vulnerable algorithms."""
    return SM.portfolio(code_findings(spark, sf_dir), discovered_files(spark, sf_dir))


@register("portfolio_rollup", O.with_ctes(
    _CODE_FOUND + [("portfolio", O.portfolio_sql("deduped", "discovered"))], O.rollup_sql("portfolio")))
def q_portfolio_rollup(spark, sf_dir):
    """ROLLUP over repositories (grand total row has repo null)."""
    return SM.portfolio_rollup(SM.portfolio(code_findings(spark, sf_dir), discovered_files(spark, sf_dir)))


@register("finding_density", O.with_ctes(_CODE_FOUND, O.density_sql("deduped", "discovered")))
def q_finding_density(spark, sf_dir):
    """Findings per file and the densest repository."""
    return SM.density(shared_findings(spark, sf_dir), discovered_files(spark, sf_dir))


@register("path_groups", O.with_ctes(_CODE_FOUND, O.path_groups_sql("deduped")))
def q_path_groups(spark, sf_dir):
    """Findings by path group (vendor / compiled / test / core)."""
    return SM.by_path_group(code_findings(spark, sf_dir))


@register("algorithm_occurrences", O.with_ctes(_CODE_FOUND, O.occurrences_sql("deduped")))
def q_algorithm_occurrences(spark, sf_dir):
    """Occurrences before de-duplication per algorithm (Σ occurrences)."""
    return SM.occurrences_by_algorithm(code_findings(spark, sf_dir))


# -------------------------------------------------------------- user rules

@register("user_rules_join", O.with_ctes([_FILES, _DISC, _READ], O.user_rules_sql()))
def q_user_rules_join(spark, sf_dir):
    """E1 + J1 join form + P8: a user rule table through the broadcast
    nested-loop join (same-line duplicate ids suppressed)."""
    text = readable(discovered_files(spark, sf_dir))
    rules = rules_frame(spark, CP.USER_RULES)
    return _bigint(regex_findings_join(text, rules).select(*FINDING_OUT), ["line", "column", "phase"])


@register("user_rules_indexed")  # lines x rules takes minutes in SQL: tests/test_user_rules.py has the brute-force version
def q_user_rules_indexed(spark, sf_dir):
    """E1 + J1, indexed form: a user rule table of thousands of rules, drawn
    from the documents, through the inverted index of required literals."""
    text = readable(discovered_files(spark, sf_dir))
    found = regex_findings_join(text, CP.document_rules(spark, sf_dir))
    return _bigint(found.select("repo", "rule_id", "algorithm", "file", "line", "column", "snippet", "confidence", "rule_ord"), ["line", "column", "rule_ord"])


# ------------------------------------------------------------- full scan

_FULL = [_FILES, _DISC, _READ, _RAW_REGEX, _RAW_USAGE, _MFILES, ("obs", O.observations_sql()),
         ("raw_all", O.full_raw_sql()), ("filtered", O.filtered_sql("raw_all")),
         ("deduped", O.dedupe_sql("filtered"))]


@register("full_scan", O.with_ctes(_FULL, O.summary_sql("deduped", "discovered")))
def q_full_scan(spark, sf_dir):
    """X1 over all eight phases (regex, usage, npm, Cargo, Go, pip, Java,
    network) → filter → de-duplicate → readiness summary per repository."""
    disc = discovered_files(spark, sf_dir)
    text = readable(disc)
    raw = FD.union_findings(regex_findings(text), usage_findings(text),
                            DP.dependency_findings(CP.manifest_files(spark, sf_dir)),
                            endpoint_findings(CP.endpoint_observations(spark, sf_dir)))
    return SM.summary(FD.dedupe(FD.filter_findings(raw)), disc)


@register("sbom_properties", O.with_ctes(
    _CODE_FOUND + [_COMPS], "SELECT * FROM (" + O.sbom_properties_sql("deduped", "comps") + ")"))
def q_sbom_properties(spark, sf_dir):
    """A18 (CycloneDX): the name/value properties each finding adds to its
    component, one row per property (no per-component array)."""
    p = EN.cyclonedx_properties(shared_components(spark, sf_dir), shared_findings(spark, sf_dir))
    return p.select("sbom_id", "is_new", "doc_ord", "pos", "file", "rule_id", F.col("prop_idx").cast("long").alias("prop_idx"),
                    "name", "value")


@register("spdx_annotations", O.with_ctes(
    _CODE_FOUND + [_COMPS], "SELECT * FROM (" + O.spdx_annotations_sql("deduped", "comps") + ")"))
def q_spdx_annotations(spark, sf_dir):
    """A18 (SPDX): one annotation row per finding attached to a package."""
    return EN.spdx_annotations(shared_components(spark, sf_dir), shared_findings(spark, sf_dir))


FLAGSHIP = "readiness"
