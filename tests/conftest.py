import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FIXTURE_DIR = os.path.join(ROOT, "tests", "fixtures")
FIXTURE_FILES = ["ledger.ts", "capsule.ts", "edge.conf", "sbom.json"]


@pytest.fixture(scope="session")
def spark():
    from qsieve.session import local_session
    s = local_session(4, shuffle_partitions=4, app="qsieve-tests")
    yield s


@pytest.fixture(scope="session")
def fixture_files(spark):
    """The files of tests/fixtures as a files table."""
    rows = [("fx", name, open(os.path.join(FIXTURE_DIR, name), encoding="utf-8").read())
            for name in FIXTURE_FILES]
    return spark.createDataFrame(rows, "repo string, path string, content string")


def files_df(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")
