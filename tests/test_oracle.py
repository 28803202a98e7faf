"""Registered queries vs their DuckDB oracle on the smallest tables."""

import pytest

from tests.oracle_check import compare

SMOKE = ["file_inventory", "regex_hits", "usage_findings", "readiness", "deps_java", "deps_pip",
         "endpoint_findings", "policy_violations", "sbom_cyclonedx", "sarif_rules", "portfolio_rollup",
         "json_findings", "json_summary", "violation_labels", "scan_options", "sbom_undetected"]


@pytest.mark.parametrize("name", SMOKE)
def test_query_matches_oracle(spark, name):
    assert compare(spark, name, "/root/testdata/sf0.001", verbose=False)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
