"""Policy evaluation, violation counts and the CI gate.

J13 is a theta join (substring, membership and date predicates), so it is a
broadcast nested-loop join against the policy table.  The policy table is a
configuration dimension: its row count is checked, and a table larger than
MAX_BROADCAST_POLICIES is evaluated in bounded chunks (one broadcast each,
unioned) — never as a shuffled cartesian product.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import policy_message
from ..sources.policies import checked_policies

MAX_BROADCAST_POLICIES = 10_000


def policy_matches(f_alg: Column, f_cat: Column, f_sev: Column, f_conf: Column, now: Column) -> Column:
    """`matches(policy, finding, now)` over joined columns (policy columns
    unqualified: algorithm_p, category_p, severity_p, …)."""
    dl = F.try_to_timestamp(F.col("deadline"))
    deadline_ok = F.col("deadline").isNull() | (F.col("deadline") == "") | dl.isNull() | (now >= dl)
    conf_ok = F.col("min_confidence").isNull() | (f_conf >= F.col("min_confidence"))
    alg_ok = F.col("algorithm_p").isNull() | F.exists(
        "algorithm_p", lambda a: F.lower(f_alg).contains(F.lower(a)))
    cat_ok = F.col("category_p").isNull() | F.array_contains("category_p", f_cat)
    sev_ok = F.col("severity_p").isNull() | F.array_contains("severity_p", f_sev)
    return deadline_ok & conf_ok & alg_ok & cat_ok & sev_ok


def evaluate_policies(findings: DataFrame, policies: DataFrame, now: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (non-safe finding, matching policy).  keep: more columns
    of the findings; there, `description` is the finding's and the policy's is
    `policy_description`."""
    now_c = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    pol = checked_policies(policies).select("policy_ord", F.col("id").alias("policy_id"), "description",
                          F.col("algorithm").alias("algorithm_p"),
                          F.col("category").alias("category_p"),
                          F.col("severity").alias("severity_p"), "min_confidence", "action",
                          "deadline", "message")
    f = findings.where(F.col("severity") != "safe").select(
        "repo", "rule_id", "severity", "category", "algorithm", "file", "line", "confidence",
        *(F.col(c).alias(f"kept_{c}") for c in keep))
    cond = policy_matches(F.col("algorithm"), F.col("category"), F.col("severity"),
                          F.col("confidence"), now_c)
    n = policies.count()  # a configuration table; bounded by construction
    if n <= MAX_BROADCAST_POLICIES:
        chunks = [pol]
    else:
        k = (n + MAX_BROADCAST_POLICIES - 1) // MAX_BROADCAST_POLICIES
        part = F.pmod(F.xxhash64("policy_id", "policy_ord"), F.lit(k))  # any ordinal, null too
        chunks = [pol.where(part == i) for i in range(k)]
    joined = reduce(lambda a, b: a.unionByName(b),
                    [f.join(F.broadcast(c), cond) for c in chunks])
    return joined.select(
        "repo", "policy_id", F.coalesce("description", "policy_id").alias("policy_description" if "description" in keep else "description"),
        *(F.col(f"kept_{c}").alias(c) for c in keep), "action", policy_message(F.col("policy_id"), F.col("message")).alias("message"),
        "deadline", "rule_id", "severity", "category", "algorithm", "file", "line",
        "confidence", "policy_ord")


def violation_counts(violations: DataFrame) -> DataFrame:
    """Violations per repository, policy and action."""
    return (violations.groupBy("repo", "policy_id", "action")
            .agg(F.count(F.lit(1)).cast("long").alias("violations")))


def gate(summary: DataFrame, violations: DataFrame) -> DataFrame:
    """A10: exit code per repository — 2 if any blocking violation, else 1 if
    critical + high > 0, else 0."""
    blocks = violations.groupBy("repo").agg(
        F.bool_or(F.col("action") == "block").alias("has_block"))
    s = summary.join(blocks, "repo", "left")
    code = (F.when(F.coalesce("has_block", F.lit(False)), F.lit(2))
            .when((F.col("critical") + F.col("high")) > 0, F.lit(1)).otherwise(F.lit(0)))
    return s.select("repo", F.col("critical"), F.col("high"),
                    F.coalesce("has_block", F.lit(False)).alias("has_block"),
                    code.cast("long").alias("exit_code"))


def violation_label(action: Column, policy_id: Column, message: Column, deadline: Column) -> Column:
    """`[BLOCK] id: message (deadline: d)`."""
    icon = F.when(action == "block", F.lit("BLOCK")).otherwise(F.lit("WARN"))
    dl = F.when(deadline.isNotNull() & (deadline != ""),
                F.concat(F.lit(" (deadline: "), deadline, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), icon, F.lit("] "), policy_id, F.lit(": "), message, dl)
