"""Union, filters, de-duplication (order: operators/order.py).

De-duplication is an aggregate, not a window: `min_by(row, order_key)` and
`count(*)` per (repo, rule_id, file) are both partially aggregated map-side,
so the shuffle carries one row per key per map task instead of every hit, and
a hot key cannot pile its rows into one reducer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.scalars import severity_rank
from .lines import FINDING_COLS

DEDUPE_KEY = ["repo", "rule_id", "file"]


def union_findings(*branches: DataFrame) -> DataFrame:
    """UNION ALL of detection branches; `phase` keeps their order."""
    cols = FINDING_COLS
    return reduce(lambda a, b: a.unionByName(b), [b.select(*cols) for b in branches])


def filter_findings(findings: DataFrame, min_confidence: float = C.DEFAULT_MIN_CONFIDENCE,
                    min_severity: str = "safe") -> DataFrame:
    """P11 (confidence·100 ≥ n, in double arithmetic) and P12 (rank ≤ level)."""
    level = C.SEVERITY_RANK[min_severity]
    return findings.where((F.col("confidence") * 100 >= F.lit(float(min_confidence)))
                          & (severity_rank("severity") <= F.lit(level)))


def order_key() -> F.Column:
    """Insertion order, of one file, after the stable severity/file sort (O1)."""
    return F.struct(severity_rank("severity").alias("sev_rank"), "phase", "rule_ord", "line", "column")


def dedupe(findings: DataFrame) -> DataFrame:
    """W1 + A1: per (repo, rule_id, file) keep the highest confidence, ties to
    the earliest in sorted order; `occurrences` = group size when > 1.
    `first_pos` is the group's first appearance (O3 output order).  The key's
    hash leads the groups: Spark sorts by it (`min_by` of a row is no hash
    aggregate), and repositories agree in the bytes that its sort looks at first."""
    cols = [c for c in FINDING_COLS]
    best_key = F.struct((-F.col("confidence")).alias("neg_conf"), order_key().alias("k"))
    agg = (findings.groupBy(F.xxhash64(*DEDUPE_KEY).alias("key"), *DEDUPE_KEY)
           .agg(F.min_by(F.struct(*[c for c in cols if c not in DEDUPE_KEY]), best_key).alias("b"),
                F.count(F.lit(1)).alias("n"),
                F.min(F.struct("phase", "rule_ord", "line", "column")).alias("first_pos")))
    return agg.select(*DEDUPE_KEY, "b.*",
                      F.when(F.col("n") > 1, F.col("n")).cast("long").alias("occurrences"),
                      "first_pos")


def no_dedupe(findings: DataFrame) -> DataFrame:
    return findings.select("*", F.lit(None).cast("long").alias("occurrences"),
                           F.struct("phase", "rule_ord", "line", "column").alias("first_pos"))


def finalize(findings: DataFrame, dedupe_on: bool = True) -> DataFrame:
    return dedupe(findings) if dedupe_on else no_dedupe(findings)
