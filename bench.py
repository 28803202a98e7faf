"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion through the `noop` sink (every row is
computed, nothing is collected to the driver).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["readiness", "regex_hits", "usage_findings", "findings", "deps_npm", "deps_pip",
            "deps_java", "endpoint_findings", "policy_violations", "sbom_cyclonedx",
            "sarif_results", "portfolio_rollup", "full_scan"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from qsieve.session import local_session
    from qsieve.plans.queries import QUERIES

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="qsieve-bench")
    names = sys.argv[1:] or HEADLINE
    # warm-up (not counted): JVM start, JIT of the regex/usage paths and
    # first code generation, on the smallest tables next to the bench input
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm):
        warm = sf_dir
    for name in ("readiness", "deps_java", "endpoint_findings"):
        QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
