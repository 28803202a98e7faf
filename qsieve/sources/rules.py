"""The rule table — default catalogue or a user table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog as C

RULE_SCHEMA = T.StructType([
    T.StructField("rule_ord", T.IntegerType(), False),
    T.StructField("rule_id", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("algorithm", T.StringType(), True),
    T.StructField("replacement", T.StringType(), True),
    T.StructField("effort", T.StringType(), True),
    T.StructField("languages", T.ArrayType(T.StringType()), True),
    T.StructField("patterns", T.ArrayType(T.StringType()), True),
])


def rule_rows(rules: list[dict] | None = None) -> list[dict]:
    """Validated rule dicts with an explicit `rule_ord`: their own, or their
    1-based place in the list."""
    rules = C.RULES if rules is None else rules
    out = []
    for i, r in enumerate(rules, start=1):
        if not r.get("id") or not r.get("patterns"):
            raise ValueError("Invalid rule: missing id or patterns")
        out.append(dict(rule_ord=i if r.get("rule_ord") is None else r["rule_ord"], rule_id=r["id"], description=r.get("description"),
                        severity=r.get("severity"), category=r.get("category"),
                        algorithm=r.get("algorithm"), replacement=r.get("replacement"),
                        effort=r.get("effort"), languages=list(r.get("languages") or []),
                        patterns=list(r["patterns"])))
    return out


def rules_frame(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """The rule dimension as a DataFrame (28 rows by default; size is that of
    the catalogue, independent of the scanned data)."""
    rows = [tuple(r[f.name] for f in RULE_SCHEMA.fields) for r in rule_rows(rules)]
    from ..session import dimension
    return dimension(spark, "rules:" + repr(rows), lambda: spark.createDataFrame(rows, RULE_SCHEMA))


def validate_rules(rules: DataFrame) -> DataFrame:
    """Rows that make a user rule table invalid (must be empty)."""
    return rules.where(_bad())


def _bad():
    """No id, no pattern, or no place in the order of rules."""
    return F.col("rule_id").isNull() | F.col("rule_ord").isNull() | (F.coalesce(F.size("patterns"), F.lit(0)) <= 0)


def checked_rules(rules: DataFrame) -> DataFrame:
    """A user rule table whose invalid rows fail the job when it is read."""
    return rules.withColumn("patterns", F.when(_bad(), F.raise_error(F.lit("Invalid rule: missing id, order or patterns")))
                            .otherwise(F.col("patterns")))
