"""Per-repository summaries and portfolio rollups.

All aggregates are partial-aggregatable (count_if / sum / bool_or / min_by),
so a repository holding a large share of the rows is combined map-side and
never lands in one reducer as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C

SEV_COLS = list(C.SEVERITIES)
CAT_COLS = list(C.CATEGORIES)


def files_scanned(discovered: DataFrame) -> DataFrame:
    """A5: distinct discovered paths per repo (binary, unreadable and oversize
    files included).  Only `repo`/`path` are read: content is pruned."""
    return discovered.groupBy("repo").agg(F.count_distinct("path").cast("long").alias("files_scanned"))


def counts(findings: DataFrame) -> DataFrame:
    """A2/A3/A4 per repo: zero-filled severity and category counts, total."""
    aggs = [F.count(F.lit(1)).cast("long").alias("findings_total")]
    aggs += [F.count_if(F.col("severity") == s).cast("long").alias(s) for s in SEV_COLS]
    aggs += [F.count_if(F.col("category") == c).cast("long").alias(c) for c in CAT_COLS]
    return findings.groupBy("repo").agg(*aggs)


def summary(findings: DataFrame, discovered: DataFrame) -> DataFrame:
    """One row per repository that has discovered files or findings."""
    cnt_cols = ["findings_total"] + SEV_COLS + CAT_COLS
    out = (files_scanned(discovered).join(counts(findings), "repo", "full")
           .na.fill(0, ["files_scanned"] + cnt_cols))
    return out.select(
        "repo", "files_scanned", *cnt_cols,
        ((F.col("critical") == 0) & (F.col("high") == 0)).alias("pqc_ready"),
        readiness_score(F.col("safe"), F.col("findings_total")).alias("pqc_score"))


def readiness_score(safe: F.Column, total: F.Column) -> F.Column:
    """round(100·safe/total), 100 when there are no findings."""
    return F.when(total == 0, F.lit(100)).otherwise(
        F.floor(F.lit(100.0) * safe / total + 0.5)).cast("long")


def score_band(score: F.Column) -> F.Column:
    """K5 colour band of the score: ≥80, ≥50, below."""
    return F.when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor")


def portfolio(findings: DataFrame, discovered: DataFrame) -> DataFrame:
    """Per repository files, critical, high, safe, readiness and the
    sorted list of vulnerable algorithms (critical or high)."""
    vuln = F.when(F.col("severity").isin("critical", "high"), F.col("algorithm"))
    per = findings.groupBy("repo").agg(
        F.count_if(F.col("severity") == "critical").cast("long").alias("critical"),
        F.count_if(F.col("severity") == "high").cast("long").alias("high"),
        F.count_if(F.col("severity") == "safe").cast("long").alias("safe"),
        F.array_join(F.array_sort(F.collect_set(vuln)), ", ").alias("vulnerable_algorithms"))
    out = files_scanned(discovered).join(per, "repo", "full").na.fill(0)
    return out.select("repo", "files_scanned", "critical", "high", "safe",
                      ((F.col("critical") + F.col("high")) == 0).alias("pqc_ready"),
                      F.coalesce("vulnerable_algorithms", F.lit("")).alias("vulnerable_algorithms"))


def portfolio_rollup(portfolio_df: DataFrame) -> DataFrame:
    """Per-repo rows plus the grand total via ROLLUP (repo null =
    total): files, critical, high, safe, repositories, not-ready count."""
    return (portfolio_df.rollup("repo").agg(
        F.sum("files_scanned").cast("long").alias("files_scanned"),
        F.sum("critical").cast("long").alias("critical"),
        F.sum("high").cast("long").alias("high"),
        F.sum("safe").cast("long").alias("safe"),
        F.count(F.lit(1)).cast("long").alias("repositories"),
        F.count_if(~F.col("pqc_ready")).cast("long").alias("not_ready"),
        F.grouping_id().cast("long").alias("is_total")))


def density(findings: DataFrame, discovered: DataFrame) -> DataFrame:
    """Findings per file per repository, with the densest repository
    flagged (max_by over the per-repo rows)."""
    per = (files_scanned(discovered)
           .join(findings.groupBy("repo").agg(F.count(F.lit(1)).cast("long").alias("findings")),
                 "repo", "left").na.fill(0, ["findings"])
           .withColumn("density", F.round(F.col("findings") / F.col("files_scanned"), 4)))
    densest = per.agg(F.max_by("repo", F.struct("density", F.col("repo")))).scalar()
    return per.select("repo", "files_scanned", "findings", "density",
                      (F.col("repo") == densest).alias("is_densest"))


PATH_GROUP_RE = [
    ("vendor", r"(^|/)(vendor|node_modules|third_party|external)/"),
    ("compiled", r"(^|/)(compiled|dist|build|bundle)/|\.min\.js$"),
    ("test", r"(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[^/]*$"),
]


def path_group(path: F.Column) -> F.Column:
    """Vendor / compiled / test / core by path."""
    expr = None
    for name, rx in PATH_GROUP_RE:
        expr = F.when(path.rlike(rx), name) if expr is None else expr.when(path.rlike(rx), name)
    return expr.otherwise("core")


def by_path_group(findings: DataFrame) -> DataFrame:
    return (findings.groupBy("repo", path_group(F.col("file")).alias("path_group"))
            .agg(F.count(F.lit(1)).cast("long").alias("findings"),
                 F.count_if(F.col("severity").isin("critical", "high")).cast("long")
                 .alias("vulnerable")))


def occurrences_by_algorithm(findings: DataFrame) -> DataFrame:
    """Occurrences before de-duplication per algorithm: Σ coalesce(n, 1)."""
    return (findings.groupBy("repo", "algorithm")
            .agg(F.sum(F.coalesce("occurrences", F.lit(1))).cast("long").alias("occurrences"),
                 F.count(F.lit(1)).cast("long").alias("findings")))
