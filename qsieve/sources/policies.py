"""The policy table.

Scalar-or-array fields (algorithm, category, severity) are normalised to
arrays; null or an empty string means "no filter", an empty array matches
nothing.  Each policy
needs an id and an action in {warn, block}.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLICY_SCHEMA = ("policy_ord int, id string, description string, algorithm array<string>, "
                 "category array<string>, severity array<string>, min_confidence double, "
                 "action string, deadline string, message string")


def _arr(v):
    if v is None or v == "":
        return None
    return list(v) if isinstance(v, (list, tuple)) else [v]


def policy_rows(policies: list[dict]) -> list[tuple]:
    out = []
    for i, p in enumerate(policies):
        if not p.get("id"):
            raise ValueError('Policy missing "id"')
        if p.get("action") not in ("warn", "block"):
            raise ValueError(f'Policy "{p["id"]}" has invalid action (must be "warn" or "block")')
        mc = p.get("min_confidence")
        out.append((i, p["id"], p.get("description"), _arr(p.get("algorithm")),
                    _arr(p.get("category")), _arr(p.get("severity")),
                    None if mc is None else float(mc), p["action"],
                    None if p.get("deadline") is None else str(p["deadline"]), p.get("message")))
    return out


def policies_frame(spark: SparkSession, policies: list[dict]) -> DataFrame:
    from ..session import dimension
    rows = policy_rows(policies)
    return dimension(spark, "policies:" + repr(rows),
                     lambda: spark.createDataFrame(rows, POLICY_SCHEMA))


def invalid_policies(policies: DataFrame) -> DataFrame:
    """Rows that make a policy table invalid (must be empty)."""
    return policies.where(F.col("id").isNull() | ~F.coalesce(F.col("action").isin("warn", "block"),
                                                             F.lit(False)))


def checked_policies(policies: DataFrame) -> DataFrame:
    """A user policy table whose invalid rows fail the job when it is read."""
    bad = F.col("id").isNull() | (F.col("id") == "") | ~F.coalesce(F.col("action").isin("warn", "block"), F.lit(False))
    return policies.withColumn("action", F.when(bad, F.raise_error(F.concat(
        F.lit("Invalid policy "), F.coalesce("id", F.lit("without id"))))).otherwise(F.col("action")))
