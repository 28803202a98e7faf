"""Tables of few bytes and much work a row are read by all cores, SBOM documents are parsed once."""

import pytest

from qsieve.plans import corpus as CP
from qsieve.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("read", [CP.manifest_files, CP.endpoint_observations, CP.endpoint_specs, CP.sbom_documents])
def test_inputs_are_spread(spark, read):
    assert read(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["sbom_component_members", "sbom_cyclonedx", "sbom_spdx", "sbom_properties", "spdx_annotations"])
def test_documents_are_parsed_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "part.parquet" not in plan and "bomFormat" not in plan
