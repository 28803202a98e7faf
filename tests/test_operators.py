"""Operator tests on tiny literal tables: usage extraction, gates, join form,
discovery, policies, endpoints, manifests, SBOM."""

import json

import pytest
from pyspark.sql import functions as F

from qsieve import catalog as C
from qsieve.operators import enrich as EN
from qsieve.operators import policy as PL
from qsieve.operators.dependencies import dependency_findings
from qsieve.operators.lines import (explode_lines, match_compiled, regex_findings,
                                    regex_findings_join)
from qsieve.operators.network import endpoint_findings
from qsieve.operators.usage import usage_findings
from qsieve.sources import sbom as SB
from qsieve.sources.endpoints import OBS_SCHEMA, parse_endpoint_spec
from qsieve.sources.files import discover, readable, with_file_meta
from qsieve.sources.policies import policies_frame
from qsieve.sources.rules import rules_frame
from tests.conftest import files_df


def test_usage_hits(fixture_files):
    text = readable(with_file_meta(fixture_files))
    got = {(r.file, r.line, r.column, r.rule_id, r.confidence) for r in usage_findings(text).collect()}
    a, b = "ledger.ts", "capsule.ts"
    assert got == {
        (a, 1, 1, "ED25519_USAGE", .98), (a, 5, 14, "MD5_USAGE", .95), (a, 6, 14, "RSA_KEY_GEN", .96),
        (a, 10, 16, "RSA_SIGN", .96), (a, 13, 13, "AES_256", .95),
        (b, 1, 1, "ML_KEM", .98), (b, 2, 16, "SHA256_SAFE", .95), (b, 3, 15, "SHA256_SAFE", .95)}


@pytest.mark.parametrize("src,expected", [
    ('x = createHash(\n  "md5"\n)', [(1, 5, "MD5_USAGE")]),
    ('a.replace(/`/g, "").split(/[/*]/); createHash("md5")', [(1, 36, "MD5_USAGE")]),
    ('n = a / b / createHash("sha1").length', [(1, 13, "SHA1_USAGE")]),
    ('jwt.sign({ s: f(g(h(u))) }, k(p(q())), { algorithm: "RS256" })', [(1, 1, "RSA_SIGN")]),
    ('jwt.sign(p, k, { a: { algorithm: "RS256" } }); x.jwt.sign(p, k, { algorithm: "RS256" })', []),
    ('jwt.sign(p, k, { "algorithm": "RS256" }); jwt.sign(p, k, { algorithm: `RS256` })', []),
    ("`${createHash(`md5`)} createHash('sha1')`", [(1, 4, "MD5_USAGE")]),
    ('createHash<Hash<A>>("md5"); createHash?.("sha1")', [(1, 1, "MD5_USAGE"), (1, 29, "SHA1_USAGE")]),
    ('function publicEncrypt(a) {} new c.publicEncrypt(a); class A { publicEncrypt(a) { } }', []),
    ('new Foo(1).b[2].publicEncrypt(a)', [(1, 1, "RSA_ENCRYPT")]),
    ('return (a || b).publicEncrypt(a)', [(1, 8, "RSA_ENCRYPT")]),
    ('createHash(/* c */ "md5"); createHash("md5" + x); createHash(x)', []),
    ('import e = require("elliptic"); import("ethers"); import.meta.x', []),
    ('import type { A } from "ethers"; import "web3/x"', [(1, 1, "ECDSA_USAGE"), (1, 34, "ECDSA_USAGE")]),
    ('((( [ createHash("md5")', [(1, 7, "MD5_USAGE")]),
    (')}] "open\ncreateHash("md5', []),
    ("\U0001F511; createHash('md5')", [(1, 5, "MD5_USAGE")]),
    ("`\U0001F511\n\U0001F511` + x;\n\U0001F511.y(); createHash('md5')", [(3, 9, "MD5_USAGE")]),
    ('const a = b++ / 2; const h = crypto.createHash("md5"); const z = 1 / 2;', [(1, 30, "MD5_USAGE")]),
    ('if (x) /[`"]/.test(y); createHash("md5"); a.if (x) / b / createHash("sha1").length', [(1, 24, "MD5_USAGE"), (1, 58, "SHA1_USAGE")]),
    ('publicEncrypt<A>(1).createHash("md5"); a?.b!.c.createHash("sha1")', [(1, 1, "MD5_USAGE"), (1, 1, "RSA_ENCRYPT"), (1, 40, "SHA1_USAGE")]),
    ('import a, { b as c, type D } from "ethers"; import x y z, * as w from "web3"', [(1, 1, "ECDSA_USAGE"), (1, 45, "ECDSA_USAGE")]),
    ('import { a } "ethers"; import from from "web3"; export { x } from "ethers"', [(1, 24, "ECDSA_USAGE")]),
])
def test_usage_forms(spark, src, expected):
    text = with_file_meta(files_df(spark, [("r", "a.ts", src), ("r", "b.ts", None), ("r", "c.ts", "")]))
    assert sorted((r.line, r.column, r.rule_id) for r in usage_findings(text).collect()) == expected


def test_usage_long_file(spark):
    """One pass whatever the length: 20,000 sites on lines and in one line."""
    line = 'createHash("md5"); '
    text = with_file_meta(files_df(spark, [("r", "a.js", (line + "\n") * 10000), ("r", "b.js", line * 10000)]))
    assert usage_findings(text).count() == 20000


def test_usage_comments_and_multiline(spark):
    src = "\n".join([
        "/* block",
        "   crypto.createHash('md5')",
        "*/ const x = 1;",
        "import {",
        "  a,",
        '} from "@noble/secp256k1";',
        "const v = jwt.verify(t, k, { algorithms: ['RS256', 'ES256'] });",
        "const s = 'crypto.createHash(\"sha1\")'; // createHash('md5')",
        "const h = require('crypto').createHash('sha1');",
    ])
    text = readable(with_file_meta(files_df(spark, [("r", "a.js", src)])))
    got = sorted((r.line, r.column, r.rule_id) for r in usage_findings(text).collect())
    assert (4, 1, "ECDSA_USAGE") in got          # multi-line import, reported at `import`
    assert (7, 11, "RSA_SIGN") in got            # verify list: first pattern (RS*) wins
    assert all(r[0] not in (2,) for r in got)     # nothing from the block comment
    assert (9, 11, "SHA1_USAGE") in got          # chained call takes the chain's column


def test_token_gates_sound(spark, fixture_files):
    """Gated and ungated compiled matching give the same hits."""
    from qsieve.plans.corpus import corpus_files
    for files in (fixture_files, corpus_files(spark, "/root/testdata/sf0.001")):
        lines = explode_lines(readable(with_file_meta(discover(files))))
        gated = match_compiled(lines).select("path", "line_no", "rule_ord")
        ungated = match_compiled(lines, use_gates=False).select("path", "line_no", "rule_ord")
        assert gated.exceptAll(ungated).count() == 0 and ungated.exceptAll(gated).count() == 0


def test_join_form_equals_compiled(spark, fixture_files):
    text = readable(with_file_meta(fixture_files))
    cols = ["file", "line", "column", "rule_id", "confidence", "snippet"]
    a = regex_findings(text).select(*cols)
    b = regex_findings_join(text, rules_frame(spark)).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_discovery(spark):
    paths = ["src/a.ts", "node_modules/x/a.js", "lib/a.min.js", ".github/w.yml", "a/.env",
             "deploy/Dockerfile", "deploy/Dockerfile.prod", "home/.ssh/config", "x/.hidden/.ssh/config",
             "docs/readme.md", "Cargo.lock", "dist/b.js", "pkg/build.gradle", "conf/nginx.conf"]
    df = files_df(spark, [("r", p, "x") for p in paths])
    got = {r.path: r.language for r in with_file_meta(discover(df)).collect()}
    assert set(got) == {"src/a.ts", "deploy/Dockerfile", "deploy/Dockerfile.prod",
                        "home/.ssh/config", "conf/nginx.conf"}
    assert got["deploy/Dockerfile.prod"] == "config" and got["home/.ssh/config"] == "config"


def _finding_df(spark, rows):
    return spark.createDataFrame(
        [("r", "TEST", sev, cat, alg, "test.ts", 1, conf) for sev, cat, alg, conf in rows],
        "repo string, rule_id string, severity string, category string, algorithm string, "
        "file string, line int, confidence double")


@pytest.mark.parametrize("policies,rows,expected", [
    ([dict(id="no-rsa", algorithm="RSA", action="block")],
     [("critical", "kem", "RSA", .9), ("safe", "kem", "AES-256", .9), ("critical", "kem", "ECDSA", .9)], 1),
    ([dict(id="w", algorithm=["MD5", "SHA-1"], action="block")],
     [("medium", "hash", "MD5", .9), ("medium", "hash", "SHA-1", .9), ("critical", "kem", "RSA", .9)], 2),
    ([dict(id="f", algorithm="RSA", action="block", deadline="2099-01-01")], [("critical", "kem", "RSA", .9)], 0),
    ([dict(id="p", algorithm="RSA", action="block", deadline="2020-01-01")], [("critical", "kem", "RSA", .9)], 1),
    ([dict(id="all", action="warn")], [("safe", "kem", "ML-KEM", .9)], 0),
    ([dict(id="s", category="signature", action="warn")],
     [("critical", "signature", "ECDSA", .9), ("critical", "kem", "RSA", .9)], 1),
    ([dict(id="h", algorithm="RSA", min_confidence=0.95, action="block")],
     [("critical", "kem", "RSA", .7), ("critical", "kem", "RSA", .98)], 1),
    ([dict(id="none", algorithm=[], action="block")], [("critical", "kem", "RSA", .9)], 0),
])
def test_policy_evaluator(spark, policies, rows, expected):
    v = PL.evaluate_policies(_finding_df(spark, rows), policies_frame(spark, policies), "2026-12-01")
    assert v.count() == expected


def test_policy_action_and_message(spark):
    pol = policies_frame(spark, [dict(id="warn-rsa", algorithm="RSA", action="warn", message="RSA is deprecated"),
                                 dict(id="block-md5", algorithm="MD5", action="block")])
    v = {r.policy_id: r for r in PL.evaluate_policies(
        _finding_df(spark, [("critical", "kem", "RSA", .9), ("medium", "hash", "MD5", .9)]), pol,
        "2026-12-01").collect()}
    assert v["warn-rsa"].action == "warn" and v["warn-rsa"].message == "RSA is deprecated"
    assert v["block-md5"].action == "block" and v["block-md5"].message == 'Violates policy "block-md5"'


def test_endpoint_findings(spark):
    obs = spark.createDataFrame([
        ("r", "h1", 443, "tls", "TLSv1.3", "TLS_AES_256_GCM_SHA384", True, None, 294, None),
        ("r", "h2", 443, "tls", "TLSv1.2", "ECDHE-RSA-AES128-GCM-SHA256", True, "prime256v1", 65, None),
        ("r", "h3", 443, "tls", "TLSv1.2", "AES128-SHA", True, None, 128, None),
        ("r", "h4", 443, "tls", "TLSv1.2", "AES128-GCM-SHA256", False, None, None, None),
        ("r", "h5", 22, "ssh", None, None, False, None, None, "SSH-2.0-OpenSSH_9.6\r\n"),
        ("r", "h6", 22, "ssh", None, None, False, None, None, "HTTP/1.1 400"),
    ], OBS_SCHEMA)
    got = {(r.file, r.rule_id, r.severity, r.algorithm) for r in endpoint_findings(obs).collect()}
    assert got == {
        ("tls://h1:443", "NET_TLS_PROTOCOL", "safe", "TLSv1.3"),
        ("tls://h1:443", "NET_TLS_CERT_KEY", "critical", "RSA"),
        ("tls://h2:443", "NET_TLS_PROTOCOL", "critical", "TLSv1.2"),
        ("tls://h2:443", "NET_TLS_KEX", "critical", "ECDH"),
        ("tls://h2:443", "NET_TLS_CERT_KEY", "critical", "ECDSA"),
        ("tls://h3:443", "NET_TLS_PROTOCOL", "critical", "TLSv1.2"),
        ("tls://h3:443", "NET_TLS_KEX", "critical", "RSA"),
        ("tls://h3:443", "NET_TLS_CERT_KEY", "critical", "RSA"),
        ("tls://h4:443", "NET_TLS_PROTOCOL", "critical", "TLSv1.2"),
        ("ssh://h5:22", "NET_SSH_SERVER", "high", "SSH")}
    snip = {r.file: r.snippet for r in endpoint_findings(obs).where("rule_id = 'NET_TLS_CERT_KEY'").collect()}
    assert snip["tls://h1:443"] == "RSA 2352-bit key, TLSv1.3"


def test_endpoint_specs(spark):
    df = spark.createDataFrame([("ssh://a",), ("b:22",), ("tls://c:22",), ("d",), ("e:8443",)], "spec string")
    got = [tuple(r) for r in df.select(parse_endpoint_spec(F.col("spec")).alias("p")).select("p.*").collect()]
    assert got == [("a", 22, "ssh"), ("b", 22, "ssh"), ("c", 22, "tls"), ("d", 443, "tls"), ("e", 8443, "tls")]


def test_manifests(spark):
    rows = [
        ("r", "package.json", '{"dependencies": {"node-rsa": "1.1.1", "express": "4"},'
                              ' "devDependencies": {"node-rsa": "2.0.0"}}'),
        ("r", "Cargo.toml", 'rsa = "0.9"\nring = { version = "0.17" }\np256.workspace = true\n'),
        ("r", "go.mod", "require (\n\tgolang.org/x/crypto v0.14.0\n\tgithub.com/cloudflare/circl/v2 v2.0.0\n)\n"
                        "require filippo.io/edwards25519 v1.0.0\n"),
        ("r", "requirements.txt", "cryptography>=41\n# rsa\nPyNaCl\nparamiko[all]==3\n"),
        ("r", "pyproject.toml", 'deps = ["cryptography>=42", "ecdsa==0.18"]'),
        ("r", "build.gradle", "implementation 'org.bouncycastle:bcprov-jdk18on:1.77'\n"
                              'api("com.google.crypto.tink:tink-android:1.0")\n'),
        ("r", "pom.xml", "<groupId>org.bouncycastle</groupId><artifactId>bcprov-jdk18on</artifactId>"
                         "<version>1.78</version><groupId>com.google.crypto.tink</groupId>"
                         "<artifactId>tink-android</artifactId>"),
        ("r", "sub/package.json", '{"dependencies": {"jose": "1"}}'),
    ]
    got = {(r.rule_id, r.snippet) for r in dependency_findings(files_df(spark, rows)).collect()}
    assert got == {
        ("DEP_NODE_RSA", '"node-rsa": "2.0.0"'),
        ("DEP_CRATE_RSA", 'rsa = "0.9"'), ("DEP_CRATE_RING", 'ring = "0.17"'),
        ("DEP_GO_GOLANG_ORG_X_CRYPTO", "golang.org/x/crypto v0.14.0"),
        ("DEP_GO_GITHUB_COM_CLOUDFLARE_CIRCL", "github.com/cloudflare/circl v2.0.0"),
        ("DEP_PIP_CRYPTOGRAPHY", "cryptography==41"), ("DEP_PIP_PYNACL", "pynacl==unknown"),
        ("DEP_PIP_PARAMIKO", "paramiko==unknown"), ("DEP_PIP_ECDSA", "ecdsa>=0.18"),
        ("DEP_MAVEN_ORG_BOUNCYCASTLE_BCPROV_JDK18ON", "org.bouncycastle:bcprov-jdk18on:1.77"),
        ("DEP_MAVEN_COM_GOOGLE_CRYPTO_TINK_TINK_ANDROID", "com.google.crypto.tink:tink-android:unknown")}


def test_sbom_parse_and_enrich(spark, fixture_files):
    doc = fixture_files.where("path = 'sbom.json'").select(
        F.lit("fx").alias("sbom_id"), F.lit(2_000_000).cast("long").alias("doc_ord"), "content")
    comps = SB.components(doc)
    assert [(r.name, r.purl) for r in comps.orderBy("pos").collect()] == [
        ("rsa-vault", "pkg:npm/rsa-vault@0.4.2"), ("left-align", "pkg:npm/left-align@2.1.0"),
        ("curve-kit", "pkg:npm/%40keys/ed25519-kit@3.0.1")]
    f = spark.createDataFrame(
        [("fx", "R1", "critical", "kem", "RSA", "a.ts", 1, 0.9, "d", None, "regex", 0, 1, 1, "s"),
         ("fx", "R2", "critical", "signature", "Ed25519", "a.ts", 2, 0.9, "d", None, "regex", 0, 2, 1, "s"),
         ("fx", "R3", "medium", "hash", "MD5", "b.ts", 3, 0.9, "d", None, "regex", 0, 3, 1, "s")],
        "repo string, rule_id string, severity string, category string, algorithm string, file string, "
        "line int, confidence double, description string, replacement string, detection_method string, "
        "phase int, rule_ord int, column int, snippet string")
    rows = EN.enrich_cyclonedx(comps, f).collect()
    out = {r.name: r for r in rows}
    assert len(rows) == 4 and out["rsa-vault"].variant == "RSA" and out["curve-kit"].variant == "Ed25519"
    assert out["left-align"].variant is None and out["MD5"].origin == "new"
    vault = json.loads(out["rsa-vault"].component)
    assert vault["properties"] == [{"name": "team", "value": "ledger"}]
    assert vault["cryptoProperties"] == {"assetType": "algorithm", "algorithmProperties": {"variant": "RSA"}}
    assert json.loads(out["left-align"].component)["version"] == "2.1.0"
    assert json.loads(out["MD5"].component)["evidence"]["occurrences"][0]["location"] == "b.ts"


def test_catalog_sizes():
    assert len(C.RULES) == 28 and sum(len(r["patterns"]) for r in C.RULES) == 178
    assert (len(C.NPM_PACKAGES), len(C.CARGO_CRATES), len(C.GO_MODULES), len(C.PIP_PACKAGES),
            len(C.JAVA_PACKAGES)) == (12, 9, 5, 10, 4)


def test_join_form_chunked_broadcast(spark, fixture_files, monkeypatch):
    """A rule table above the broadcast bound is joined in bounded chunks
    with the same result."""
    from qsieve.operators import lines as LN
    text = readable(with_file_meta(fixture_files))
    cols = ["file", "line", "column", "rule_id"]
    one = regex_findings_join(text, rules_frame(spark)).select(*cols)
    monkeypatch.setattr(LN, "MAX_BROADCAST_RULES", 5)
    chunked = regex_findings_join(text, rules_frame(spark)).select(*cols)
    assert one.exceptAll(chunked).count() == 0 and chunked.exceptAll(one).count() == 0


def test_crypto_properties_are_replaced(spark):
    """One cryptoProperties member, whether or not the component had one."""
    from qsieve.operators.enrich import _with_crypto
    rows = [(1, '{"name":"a","cryptoProperties":{"assetType":"protocol"},"n":[1,{"x":null}],"s":"q\\"}"}', "RSA"), (2, '{"name":"a","cryptoProperties":null}', "RSA"),
            (3, '{"name":"a"}', "RSA"), (4, "{}", "RSA"), (5, '{"cryptoProperties":{"assetType":"protocol"}}', "RSA"), (6, '{"cryptoProperties":{"assetType":"protocol"}}', None)]
    df = spark.createDataFrame(rows, "i int, original string, algorithm string")
    for r in df.withColumn("out", _with_crypto(F.col("original"), F.col("algorithm"))).collect():
        want = json.loads(r.original) | ({"cryptoProperties": {"assetType": "algorithm", "algorithmProperties": {"variant": "RSA"}}} if r.algorithm else {})
        assert json.loads(r.out) == want and r.out.count("cryptoProperties") == 1, r.out
