"""`scan()` with every optional branch: manifests, endpoints, policies, SBOM."""

from qsieve import scan
from qsieve.sources.endpoints import OBS_SCHEMA
from qsieve.sources.policies import policies_frame
from tests.conftest import files_df


def test_scan_all_branches(spark):
    files = files_df(spark, [
        ("r", "src/a.ts", 'import { sign } from "@noble/ed25519";\nconst h = crypto.createHash("md5");\n'),
        ("r", "package.json", '{"dependencies": {"node-rsa": "1.1.1"}}'),
        ("r", "requirements.txt", "cryptography>=41\n"),
    ])
    obs = spark.createDataFrame(
        [("r", "h", 443, "tls", "TLSv1.2", "AES128-SHA", True, None, 256, None)], OBS_SCHEMA)
    comps = spark.createDataFrame(
        [("r", 0, 0, "cyclonedx", "node-rsa", "1.1.1", "pkg:npm/node-rsa@1.1.1", "library", "{}"),
         ("s", 1, 0, "spdx", "web3", "4", "pkg:npm/web3@4", "library", '{"SPDXID": "SPDXRef-w"}')],
        "sbom_id string, doc_ord long, pos long, format string, name string, version string, purl string, "
        "type string, original string")
    pol = policies_frame(spark, [dict(id="no-rsa", algorithm="RSA", action="block")])
    r = scan(files, dependencies=True, endpoints=obs, policies=pol, now="2026-12-01",
             sbom_components=comps, materialize=True)
    assert {x.phase for x in r.raw_findings.collect()} == {0, 1, 2, 5, 7}
    # usage hits (0.98 / 0.95) beat the regex hits (0.9 / 0.85) of the same rule and file
    assert {x.phase for x in r.findings.collect()} == {1, 2, 5, 7}
    s = r.summary.collect()[0]
    assert s.repo == "r" and s.pqc_ready is False and s.files_scanned == 2
    assert r.violations.where("policy_id = 'no-rsa'").count() >= 2
    enriched = {x.name: x for x in r.enriched_components.collect()}
    assert enriched["node-rsa"].n_findings >= 1
    assert [(x.sbom_id, x.spdx_id) for x in r.enriched_packages.collect()] == [("s", "SPDXRef-w")]
