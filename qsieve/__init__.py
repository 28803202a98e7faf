"""qsieve — cryptographic inventory and post-quantum readiness on Spark.

Library surface (E4): `scan` composes the detection branches and returns
DataFrames; the report functions turn findings into SARIF / CBOM / JSON /
tabular datasets.
"""

__version__ = "0.1.0"

from .plans.scan import ScanResult, scan  # noqa: E402,F401
from .operators.reports import (  # noqa: E402,F401
    cbom_components, dashboard, json_findings, report_rows, sarif_results, sarif_rules,
)
