"""Report formatting on a literal findings table."""

import json

from qsieve.operators import reports as RP
from qsieve.operators import summary as SM


def _findings(spark):
    rows = [
        ("r", "RSA_SIGN", "RSA signature", "critical", "signature", "RSA", "ML-DSA-65", "complex",
         "src/a.ts", 31, 15, "jwt.sign(x)", "ast", 0.96, 1, 0, 3),
        ("r", "MD5_USAGE", "MD5", "medium", "hash", "MD5", "SHA-256", "trivial",
         "src/a.ts", 22, 14, "createHash('md5')", "ast", 0.95, 1, 0, None),
        ("r", "NET_TLS_PROTOCOL", "TLSv1.3 negotiated", "safe", "protocol", "TLSv1.3", None, "moderate",
         "tls://h:443", None, None, "TLSv1.3 X", "network", 1.0, 7, 0, None),
    ]
    return spark.createDataFrame(rows, "repo string, rule_id string, description string, severity string, "
                                       "category string, algorithm string, replacement string, effort string, "
                                       "file string, line int, column int, snippet string, detection_method string, "
                                       "confidence double, phase int, rule_ord int, occurrences long")


def test_sarif(spark):
    f = _findings(spark)
    res = {r.rule_id: r for r in RP.sarif_results(f).collect()}
    assert set(res) == {"RSA_SIGN", "MD5_USAGE"}                      # safe excluded
    assert res["RSA_SIGN"].level == "error" and res["MD5_USAGE"].level == "warning"
    assert res["RSA_SIGN"].message == "RSA: RSA signature. Replace with: ML-DSA-65"
    rules = {r.rule_id: r for r in RP.sarif_rules(f).collect()}
    assert rules["NET_TLS_PROTOCOL"].level == "note"                  # safe kept in the rule list
    assert rules["NET_TLS_PROTOCOL"].help_text == "No migration needed"


def test_cbom(spark):
    rows = {r.name: r for r in RP.cbom_components(_findings(spark)).collect()}
    rsa = rows["RSA"]
    assert rsa.bom_ref == "crypto-RSA_SIGN-src-a-ts-31"
    assert (rsa.asset_type, rsa.primitive, rsa.crypto_function) == ("algorithm", "signature", "sign")
    assert (rsa.classical_security_level, rsa.nist_quantum_security_level) == (0, 0)
    tls = rows["TLSv1.3"]
    assert tls.bom_ref == "crypto-NET_TLS_PROTOCOL-tls---h-443-0" and tls.asset_type == "protocol"
    assert "qsieve:confidence=1;" in tls.properties and tls.additional_context is None
    assert (tls.classical_security_level, tls.nist_quantum_security_level) == (128, 3)


def test_report_rows_and_dashboard(spark):
    f = _findings(spark)
    rows = {r.rule_id: r for r in RP.report_rows(f).collect()}
    assert rows["RSA_SIGN"].label == "[!!] RSA — RSA signature (3 occurrences)"
    assert rows["RSA_SIGN"].location == "src/a.ts:31" and rows["RSA_SIGN"].confidence_pct == "96%"
    assert rows["NET_TLS_PROTOCOL"].location == "tls://h:443"
    assert rows["MD5_USAGE"].group_header == "--- MEDIUM (1) ---"
    disc = spark.createDataFrame([("r", "src/a.ts")], "repo string, path string")
    d = RP.dashboard(SM.summary(f, disc)).collect()[0]
    assert (d.pqc_score, d.score_band, d.status) == (33, "poor", "NOT PQC READY")


def test_json_lines(spark):
    j = [json.loads(r.json) for r in RP.json_findings(_findings(spark), "2026-12-01").collect()]
    net = [x for x in j if x["ruleId"] == "NET_TLS_PROTOCOL"][0]
    assert net["location"] == {"file": "tls://h:443", "snippet": "TLSv1.3 X"}   # nulls dropped
    assert "replacement" not in net
