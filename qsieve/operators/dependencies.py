"""Manifest dependencies ⋈ the known packages → findings.

All ecosystems go one way: one scan of the files table for the manifests, one
broadcast hash join with the known packages (a fixed-size dimension keyed by
ecosystem and name; Java: group, with the artifact pattern as residual), one
window over a repository's hits of a rule.  The window sees the entries of at
most four manifests: J10 keeps a pyproject hit only where requirements.txt
has none, J12 keeps the first Java hit (gradle → kts → pom).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.scalars import dependency_rule_id
from ..sources import manifests as M
from .lines import FINDING_COLS

# manifest → (ecosystem, rule id prefix, phase)
_KINDS = {
    M.NPM: ("npm", "DEP_", C.PHASE_NPM), M.CARGO: ("cargo", "DEP_CRATE_", C.PHASE_CARGO),
    M.GO: ("go", "DEP_GO_", C.PHASE_GO), M.PIP: ("pip", "DEP_PIP_", C.PHASE_PIP),
    M.PYPROJECT: ("pip", "DEP_PIP_", C.PHASE_PIP), M.GRADLE: ("java", "DEP_MAVEN_", C.PHASE_JAVA),
    M.GRADLE_KTS: ("java", "DEP_MAVEN_", C.PHASE_JAVA), M.POM: ("java", "DEP_MAVEN_", C.PHASE_JAVA)}


def known(spark: SparkSession) -> DataFrame:
    """Every known package: (eco, name, known_ord, artifact_rx, attributes)."""
    from ..session import dimension
    named = {"npm": C.NPM_PACKAGES, "cargo": C.CARGO_CRATES, "go": C.GO_MODULES, "pip": C.PIP_PACKAGES}
    rows = [(eco, name, i, None, *rest) for eco, table in named.items() for i, (name, *rest) in enumerate(table)]
    rows += [("java", group, i, rx, *rest) for i, (group, rx, *rest) in enumerate(C.JAVA_PACKAGES)]
    return dimension(spark, "known", lambda: spark.createDataFrame(
        rows, "eco string, name string, k_ord int, artifact_rx string, algorithm string, severity string, "
              "category string, description string, replacement string"))


def _by_path(i: int) -> Column:
    return F.element_at(F.create_map(*[x for k, v in _KINDS.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("path"))


def _snippet() -> Column:
    def mid(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    name, version, path = F.col("name"), F.col("version"), F.col("path")
    return (F.when(path == M.NPM, mid('"', name, '": "', version, '"')).when(path == M.CARGO, mid(name, ' = "', version, '"'))
            .when(path == M.GO, mid(name, " ", version)).when(path == M.PIP, mid(name, "==", version))
            .when(path == M.PYPROJECT, mid(name, ">=", version)).otherwise(mid(name, ":", F.col("artifact"), ":", version)))


def dependency_findings(files: DataFrame, ecosystems: list[str] | None = None) -> DataFrame:
    """Findings of the root manifests of the given ecosystems (default: all)."""
    names = [m for m in M.MANIFESTS if ecosystems is None or _KINDS[m][0] in ecosystems]
    deps = M.manifest_entries(files, names).withColumn("eco", _by_path(0))
    hits = deps.join(F.broadcast(known(files.sparkSession)), ["eco", "name"]).where(
        F.when(F.col("eco") != "java", F.lit(True))
        .otherwise(F.coalesce(F.col("known_ord") == F.col("k_ord"), F.expr("artifact rlike artifact_rx"))))
    java_id = F.upper(F.concat(F.lit("DEP_MAVEN_"), F.regexp_replace("name", "[^a-zA-Z0-9]", "_"), F.lit("_"),
                               F.regexp_replace("artifact", "[^a-zA-Z0-9]", "_")))
    rule_id = F.when(F.col("eco") == "java", java_id)
    for eco, prefix, _ in _KINDS.values():
        if eco != "java":
            rule_id = rule_id.when(F.col("eco") == eco, dependency_rule_id(prefix, F.col("name")))
    source = F.array_position(F.array(*[F.lit(m) for m in M.MANIFESTS]), F.col("path"))
    hits = hits.select("*", rule_id.alias("rule_id"), source.alias("source"), F.struct(source.alias("source"), "pos", "k_ord").alias("at"))
    if ecosystems is None or {"pip", "java"} & set(ecosystems):
        same = Window.partitionBy("repo", "rule_id")
        hits = (hits.withColumn("first", F.min("at").over(same))
                .where(F.when(F.col("eco") == "java", F.col("at") == F.col("first"))
                       .when(F.col("eco") == "pip", F.col("source") == F.col("first.source")).otherwise(F.lit(True))))
    return hits.select(
        "repo", "rule_id", "description", "severity", "category", "algorithm", "replacement",
        F.lit("complex").alias("effort"), F.col("path").alias("file"), F.lit(None).cast("int").alias("line"),
        F.lit(None).cast("int").alias("column"), _snippet().alias("snippet"),
        F.lit("dependency").alias("detection_method"), F.lit(C.CONF_DEPENDENCY).alias("confidence"),
        _by_path(2).alias("phase"), F.col("pos").cast("int").alias("rule_ord")).select(*FINDING_COLS)
