"""The indexed form of user rules: lines stay in their task, equal rules are tested once."""

from qsieve.operators import lines as LN
from qsieve.sources.files import with_file_meta
from qsieve.sources.rules import RULE_SCHEMA

from .conftest import files_df
from .test_user_rules import FILES, brute, rule

RULES = [rule(5, "A", ["md5"]), rule(3, "A", ["md5"]), rule(3, "A", ["MD5"]), rule(4, "A", ["md5"], ["python"]), rule(9, "B", ["x?"]), rule(8, "B", ["x?"]), rule(7, "B", [r"sha-?1\b"])]


def test_only_findings_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(LN, "MAX_BROADCAST_BYTES", 150)  # several chunks, by their bytes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # nothing is broadcast unless the operator says so
    try:
        found = LN.regex_findings_join(with_file_meta(files_df(spark, FILES)).where("content is not null"), spark.createDataFrame(RULES, RULE_SCHEMA))
        plan = found._jdf.queryExecution().sparkPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") > 1
    got = {(r.repo, r.file, r.rule_id, r.line, r.rule_ord, r.column) for r in rows}
    assert got == brute(RULES, FILES) and len(rows) == len(got) > 5


def test_equal_rules_are_one(spark):
    r = spark.createDataFrame(RULES, RULE_SCHEMA)
    kept = {(x.rule_id, x.rule_ord, tuple(x.patterns), tuple(x.languages)) for x in LN._one_of_equals(r).collect()}
    assert kept == {("A", 3, ("md5",), ()), ("A", 3, ("MD5",), ()), ("A", 4, ("md5",), ("python",)), ("B", 8, ("x?",), ()), ("B", 7, (r"sha-?1\b",), ())}
