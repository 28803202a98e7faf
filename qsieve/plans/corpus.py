"""Planted corpora derived from the driver's tables.

The test tables hold prose, web pages and TPC-H-like rows but no code, so the
registered queries derive their inputs with Spark from those tables: every
document becomes one source file whose body is the document text followed by
one planted snippet (chosen by `doc_id % len(PLANTS)`), every web page a
config file, every supplier a repository with manifests, every event an
endpoint observation and every part an SBOM component.  All rows of every
table are used; the plant tables are fixed-size dimensions (broadcast).

The oracle SQL (plans/oracle.py) rebuilds the same inputs from the same
constants in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dimension
from ..sources.files import ensure_parallelism

# Directory of a document file, by doc_id % len(DIRS): every document is
# scanned.  compiled/ and test/ feed the path-group rollup.
DIRS = ["src/", "lib/", "test/", "packages/compiled/", "services/pkg/", "docs/", "app/"]

# Paths of `file_inventory` only, by doc_id % len: plain, excluded, binary and
# hidden ones, and names that start with an underscore.
INVENTORY_PATHS = ["src/a%.ts", "node_modules/pkg/a%.js", "web/_app%.tsx", "pkg/__init__.d%/__init__%.py", "docs/a%.md",
                   "img/a%.png", "home%/.ssh/config", ".cache/a%.ts", "__tests__/a%.js", "dist/a%.js", "lib/a%.min.js",
                   "certs/_document%.pem"]

# (suffix appended to 'doc<id>', planted text).  Suffixes carry the
# extension or the config file name that decides the file's language.
PLANTS = [
    (".ts", """import * as ed from "@noble/ed25519";
import { createHash as digestOf, generateKeyPairSync } from "node:crypto";
export async function stamp(order: Order, seed: Uint8Array) {
  const mark = await ed.signAsync(order.bytes, seed); // Ed25519 mark
  return { mark, etag: crypto.createHash("md5").update(order.bytes).digest("base64") };
}
const pair = generateKeyPairSync(
  "rsa",
  { modulusLength: 3072, publicExponent: 65537 },
);
const agreed = createECDH("prime256v1");
const legacy = createCipheriv("aes-128-ctr", vaultKey, nonce);
const vault = createCipheriv("aes-256-cbc", vaultKey, nonce);
const bearer = jwt.sign({ sub: order.owner }, pem, { expiresIn: 900, algorithm: "RS384" });"""),
    (".conf", """# edge proxy of the billing stack
ssl_protocols TLSv1.1 TLSv1.2;
ssl_ciphers AES128-SHA:ECDHE-ECDSA-AES256-SHA:DHE-RSA-AES256-SHA256;
ssl_certificate /etc/edge/billing.crt; # RSA-2048
HostKeyAlgorithms ecdsa-sha2-nistp384,ssh-ed25519,rsa-sha2-512
KexAlgorithms curve25519-sha256,diffie-hellman-group16-sha512
secretName: billing-edge
TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384"""),
    (".tsx", """import { ml_kem1024 } from "@noble/post-quantum/ml-kem";
import { slh_dsa_sha2_128f as slh } from "@noble/post-quantum/slh-dsa";
// key capsules for the archive, ML-KEM throughout
export const capsule = (peer: Uint8Array) => ml_kem1024.encapsulate(peer);
export const seal = (seed: Uint8Array, body: Uint8Array) => slh.sign(seed, body);
const sum = createHash("sha3-512");
const stream = createCipheriv("chacha20-poly1305", k, n);"""),
    (".js", """/* kept for the old batch jobs:
   crypto.createHash("md5") is only mentioned here
*/
const box = require("tweetnacl");
const Rsa = require('node-rsa');
const short = jwt.sign(body, ecKey, { algorithm: "ES384" });
jwt.verify(short, anyKey, { algorithms: ["RS512", "ES512"] });
const modp = crypto.createDiffieHellman(3072); /* group */ const sealed = crypto.publicEncrypt(pub, buf);
// crypto.createHash("sha1") was replaced
const dsa = crypto.generateKeyPairSync("dsa", { modulusLength: 3072 });"""),
    (".py", """import hashlib
from Crypto.PublicKey import RSA
key = RSA.generate(2048)
digest = hashlib.md5(data).hexdigest()
h = hashlib.sha1(data)
# TODO: move key exchange to ML-KEM (kyber)
cipher = AES.new(key, AES.MODE_GCM)  # aes-256 key"""),
    (".java", """KeyPairGenerator kpg = KeyPairGenerator.getInstance("RSA");
Cipher c = Cipher.getInstance("AES/GCM/NoPadding"); // 128-bit key
Signature s = Signature.getInstance("SHA256withECDSA");
MessageDigest md = MessageDigest.getInstance("SHA-512");
KeyAgreement ka = KeyAgreement.getInstance("ECDH");
KeyPairGenerator dsa = KeyPairGenerator.getInstance("DSA");"""),
    (".go", """import "crypto/ecdsa"
priv, _ := ecdsa.GenerateKey(elliptic.P256(), rand.Reader)
k, _ := rsa.GenerateKey(rand.Reader, 2048)
h := sha3.New256()
x := curve25519.X25519(scalar, point)"""),
    (".yaml", """kind: Issuer
metadata:
  name: ledger-ca
spec:
  secretName: ledger-ca-pair
  keyAlgorithm: rsa
  keySize: 4096
tls.crt: LS0tLS1CRUdJTg=="""),
    ("/Dockerfile", """FROM debian:12
RUN apt-get update && apt-get install -y openssl libssl-dev
RUN pip install cryptography pycryptodome
RUN gem install rbnacl"""),
    ("/sshd_config", """HostKey /etc/ssh/ssh_host_rsa_key
KexAlgorithms diffie-hellman-group14-sha1,ecdh-sha2-nistp256
PubkeyAcceptedKeyTypes ecdsa-sha2-nistp384
HostKeyAlgorithms ecdsa-sha2-nistp521"""),
    (".rs", """use ed25519_dalek::Signer;
use x25519_dalek::PublicKey; // X25519 key agreement
let kem = pqcrypto::kem::kyber768::keypair();
let h = Sha3_256::new(); // sha-3
let sphincs = slh_dsa::keygen();"""),
    (".cts", """const plain = text.replace(/`/g, "'").split(/[/*"]/); const sum = createHash("sha1");
const ratio = total / count / 2; const again = createHash("md5");
const label = `id ${crypto.createHash("sha256").update(`k${n}`).digest("hex")} // kept`;
const typed = createHash<Buffer>("md5");
const glued = createHash("md5" + suffix), named = createHash(algorithm);
new Vault(1).open[0].createCipheriv("des-ede3-cbc", key, iv);
new crypto.createHash("md5");"""),
    (".ts", """import { xchacha20poly1305 } from "@noble/ciphers/chacha";
const lane = createCipheriv("chacha20-poly1305", laneKey, laneNonce);
const tree = crypto.createHash("sha3-384");
const vote = Dilithium5.sign(ballot); // ML-DSA
const root = sphincs.keygen(); // SLH-DSA
const old3 = createCipheriv("des-ede3", key, iv);"""),
    ("/haproxy.cfg", """ssl-default-bind-ciphers ECDHE-ECDSA-AES256-GCM-SHA384:AES128-SHA
ssl-min-ver TLSv1.0
tls_version = TLSv1.1
SSLProtocol all -SSLv3 +TLSv1
MinProtocol = TLSv1.2"""),
    (".json", """{
  "name": "svc",
  "dependencies": { "jsonwebtoken": "^9.0.0", "node-forge": "1.3.1" },
  "crypto": { "alg": "ES256", "curve": "P-256", "hash": "sha1" }
}"""),
    (".ts", """import {
  sign as edSign,
  verify as edVerify,
} from "@noble/ed25519";
import { schnorr } from '@noble/secp256k1';
import "@noble/post-quantum/ml-dsa";
export { ec } from "elliptic";
const h2 = require("crypto").createHash("sha1").update(x);
const sjs = await import("jose");
const web3 = require("web3/lib/accounts"); const e = require(`ethers`);"""),
    (".mjs", """import jwt from "jsonwebtoken";
import { Keypair } from "@solana/web3.js";
import sodium from "libsodium-wrappers";
const kp = crypto.generateKeyPair("ec", { namedCurve: "P-384" }, cb);
const dec = crypto.privateDecrypt(priv, data);
const c1 = crypto.createCipheriv("aes-128-gcm", k, iv), c2 = crypto.createCipheriv("aes-256-ctr", k, iv);
const sig = jwt.sign(claims, pem, { expiresIn: "1h", algorithm: "PS384" });"""),
    (".ts", """import {
  part01,
  part02,
  part03,
  part04,
  part05,
  part06,
  part07,
  part08,
  part09,
  part10,
  part11,
  part12,
  part13,
  part14,
  part15,
  part16,
  part17,
  part18,
  part19,
  part20,
  part21,
  part22,
  part23,
  part24,
  part25,
  part26,
  part27,
  part28,
  part29,
  part30,
} from "@noble/secp256k1";
const h = crypto
  .createHash(
    "md5",
  );
const e = createECDH(
  "secp384r1"
);"""),
    (".mts", """const long = jwt.sign(
  {
    claim01: pick(row, at(1)),
    claim02: pick(row, at(2)),
    claim03: pick(row, at(3)),
    claim04: pick(row, at(4)),
    claim05: pick(row, at(5)),
    claim06: pick(row, at(6)),
    claim07: pick(row, at(7)),
    claim08: pick(row, at(8)),
    claim09: pick(row, at(9)),
    claim10: pick(row, at(10)),
    claim11: pick(row, at(11)),
    claim12: pick(row, at(12)),
    claim13: pick(row, at(13)),
    claim14: pick(row, at(14)),
    claim15: pick(row, at(15)),
    claim16: pick(row, at(16)),
    claim17: pick(row, at(17)),
    claim18: pick(row, at(18)),
    claim19: pick(row, at(19)),
    claim20: pick(row, at(20)),
  },
  await load(pem(env("KEY"))),
  {
    header: { kid: id(hash(x)) },
    algorithm: "PS512",
  },
);
const deep = jwt.verify(jwt.sign(a, b, { algorithm: "ES256" }), k, { nested: { algorithms: ["RS256"] }, algorithms: [
  "ES512",
] });"""),
    # divisions that look like regex literals, and regex literals that hold quotes
    (".ts", """let n = 4; const half = n++ / 2; const ha = crypto.createHash("md5"); const one = 1 / 2;
if (/[`"']/.test(name) || n-- / 3 > 1) { const hb = crypto.createHash("sha1"); }
while (n) /['"`]/.exec(name), n -= 1;
if (n) /[`"]/.test(name) && check(crypto.createHash("sha256"));
const hd = (n + 1) / 2 / crypto.createHash("md5").digest().length;"""),
]

PLANT_SCHEMA = T.StructType([T.StructField("k", T.LongType(), False),
                             T.StructField("suffix", T.StringType(), False),
                             T.StructField("body", T.StringType(), False)])
DIR_SCHEMA = T.StructType([T.StructField("d", T.LongType(), False),
                           T.StructField("dir", T.StringType(), False)])

N_PAGE_REPOS = 5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose per-row work (regex over every line, a repository's
    manifests, an SBOM's JSON) dwarfs its bytes: spread it over the cores when
    the scan yields too few splits."""
    return ensure_parallelism(read_table(spark, sf_dir, name), key)


def plants(spark: SparkSession) -> DataFrame:
    return dimension(spark, "plants", lambda: spark.createDataFrame(
        [(i, s, b) for i, (s, b) in enumerate(PLANTS)], PLANT_SCHEMA))


def dirs(spark: SparkSession) -> DataFrame:
    return dimension(spark, "dirs", lambda: spark.createDataFrame(list(enumerate(DIRS)), DIR_SCHEMA))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents → files(repo, path, content): repo = document source, one
    file per document, the planted snippet appended after a newline."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", "source")
    n, m = len(PLANTS), len(DIRS)
    return (docs.join(F.broadcast(plants(spark)), (F.col("doc_id") % n) == F.col("k"))
            .join(F.broadcast(dirs(spark)), (F.col("doc_id") % m) == F.col("d"))
            .select(F.col("source").alias("repo"),
                    F.concat(F.col("dir"), F.lit("doc"), F.col("doc_id").cast("string"),
                             F.col("suffix")).alias("path"),
                    F.concat(F.col("text"), F.lit("\n"), F.col("body")).alias("content")))


def inventory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents → files under the paths of INVENTORY_PATHS, texts unplanted."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", "source")
    rows = dimension(spark, "inventory_paths", lambda: spark.createDataFrame(
        list(enumerate(INVENTORY_PATHS)), "k long, form string"))
    return (docs.join(F.broadcast(rows), (F.col("doc_id") % len(INVENTORY_PATHS)) == F.col("k"))
            .select(F.col("source").alias("repo"),
                    F.replace(F.col("form"), F.lit("%"), F.col("doc_id").cast("string")).alias("path"),
                    F.col("text").alias("content")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages → files: each page is an XML-like config file, unplanted."""
    pages = read_text_table(spark, sf_dir, "pages", "page_id")
    return pages.select(
        F.concat(F.lit("site"), (F.col("page_id") % N_PAGE_REPOS).cast("string")).alias("repo"),
        F.concat(F.lit("pages/p"), F.col("page_id").cast("string"), F.lit(".xml")).alias("path"),
        F.col("html").alias("content"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full planted corpus: documents and pages."""
    return document_files(spark, sf_dir).unionByName(page_files(spark, sf_dir))


# Root manifests per supplier repository: file name → variants (chosen by
# s_suppkey % len(variants)); %NAME% is replaced by the supplier name.
MANIFEST_VARIANTS = {
    "package.json": [
        '{\n  "name": "%NAME%",\n  "dependencies": { "node-rsa": "1.1.1", "express": "4" },\n'
        '  "devDependencies": { "node-rsa": "2.0.0" }\n}\n',
        '{"name": "%NAME%", "dependencies": {"@noble/ed25519": "^2.0.0", "jsonwebtoken": "9.0.2",'
        ' "@noble/post-quantum": "0.2.0"}}',
        '{"name": "%NAME%", "dependencies": {"ethers": "6.9.0"',
        '{"name": "%NAME%", "devDependencies": {"web3": "4.0.0", "tweetnacl": "1.0.3",'
        ' "lodash": "4.17.21"}}',
    ],
    "Cargo.toml": [
        '[package]\nname = "%NAME%"\n\n[dependencies]\nrsa = "0.9"\nring = { version = "0.17" }\n'
        'p256.workspace = true\n',
        '[dependencies]\ned25519-dalek = { version = "2.1", features = ["rand_core"] }\n'
        'x25519-dalek = "2"\npqcrypto = "0.17"\n# %NAME%\n',
        '[package]\nname = "%NAME%"\n[dependencies.rsa]\nversion = "0.9"\n',
    ],
    "go.mod": [
        'module example.com/%NAME%\n\ngo 1.21\n\nrequire (\n\tgolang.org/x/crypto v0.14.0\n'
        '\tgithub.com/cloudflare/circl/v2 v2.0.0\n)\n\nrequire filippo.io/edwards25519 v1.0.0\n',
        'module example.com/%NAME%\n\nrequire (\n\tgithub.com/btcsuite/btcd v0.24.0\n'
        '\tgo.dedis.ch/kyber/v3 v3.1.0\n)\n',
    ],
    "requirements.txt": [
        'cryptography>=41\n# rsa\nPyNaCl\nparamiko[all]==3\n',
        '# %NAME%\nrequests==2.31\nrsa == 4.9\necdsa~=0.18\n  pycryptodome>=3.19  \n',
    ],
    "pyproject.toml": [
        '[project]\nname = "%NAME%"\ndependencies = [\n  "cryptography>=42",\n  "ecdsa==0.18",\n]\n',
        '[project]\nname = "%NAME%"\ndependencies = ["liboqs-python>=0.9", "RSA>=4", "pqcrypto"]\n',
    ],
    "build.gradle": [
        "dependencies {\n    implementation 'org.bouncycastle:bcprov-jdk18on:1.77'\n"
        '    api("com.google.crypto.tink:tink-android:1.0")\n}\n',
        'dependencies {\n  compileOnly "org.bouncycastle:bcpkix-jdk18on:1.78"\n'
        '  runtimeOnly("com.google.crypto.tink:tink:1.12.0")\n}\n',
    ],
    "build.gradle.kts": [
        'dependencies {\n    implementation("org.bouncycastle:bcprov-jdk18on:1.78")\n'
        '    implementation("org.bouncycastle:bcpqc-jdk18on:1.78")\n}\n',
        '',
    ],
    "pom.xml": [
        '<project><name>%NAME%</name><dependencies>\n<dependency>\n'
        '  <groupId>org.bouncycastle</groupId>\n  <artifactId>bcprov-jdk18on</artifactId>\n'
        '  <version>1.78</version>\n</dependency>\n<dependency>\n'
        '  <groupId>com.google.crypto.tink</groupId>\n  <artifactId>tink-android</artifactId>\n'
        '</dependency>\n</dependencies></project>\n',
        '<project><dependencies><dependency><groupId> org.bouncycastle </groupId>'
        '<artifactId>bcpkix-jdk18on</artifactId><version>1.77</version></dependency>'
        '</dependencies></project>',
    ],
}


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier → one repository per supplier with the eight root manifests."""
    sup = read_text_table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", "s_name")
    rows = [(name, i, body) for name, vs in MANIFEST_VARIANTS.items() for i, body in enumerate(vs)]
    var = dimension(spark, "manifest_variants",
                    lambda: spark.createDataFrame(rows, "path string, k long, body string"))
    picks = F.array(*[F.struct(F.lit(n).alias("path"), (F.col("s_suppkey") % len(v)).alias("k"))
                      for n, v in MANIFEST_VARIANTS.items()])
    return (sup.select("s_suppkey", "s_name", F.explode(picks).alias("p"))
            .select("s_suppkey", "s_name", "p.path", "p.k")
            .join(F.broadcast(var), ["path", "k"])
            .select(F.concat(F.lit("supp"), F.col("s_suppkey").cast("string")).alias("repo"),
                    "path", F.replace(F.col("body"), F.lit("%NAME%"), F.col("s_name"))
                    .alias("content")))


# Endpoint observation variants, chosen by event_id % len: (protocol,
# tls_version, cipher, has_subject, asn1_curve, pubkey_len, banner).
OBS_VARIANTS = [
    ("tls", "TLSv1.3", "TLS_AES_256_GCM_SHA384", True, None, 294, None),
    ("tls", "TLSv1.2", "ECDHE-RSA-AES128-GCM-SHA256", True, "prime256v1", 65, None),
    ("tls", "TLSv1.2", "AES128-SHA", True, None, 128, None),
    ("tls", "TLSv1.2", "AES128-GCM-SHA256", False, None, None, None),
    ("ssh", None, None, False, None, None, "SSH-2.0-OpenSSH_9.6\r\nKEXINIT"),
    ("ssh", None, None, False, None, None, "HTTP/1.1 400 Bad Request\r\n"),
    ("tls", "TLSv1.1", "TLS_RSA_WITH_AES_128_CBC_SHA", True, "secp384r1", 97, None),
    ("tls", None, None, True, "brainpoolP256r1", 65, None),
    ("tls", "TLSv1.3", "TLS_CHACHA20_POLY1305_SHA256", True, None, 100, None),
    ("tls", "TLSv1.2", "ECDHE-ECDSA-AES256-GCM-SHA384", True, "P-521", 133, None),
    ("ssh", None, None, False, None, None, "  SSH-1.99-Cisco-1.25  "),
]
N_NET_REPOS = 4


def endpoint_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → endpoint_obs: one observation per event; host from user_id."""
    ev = read_text_table(spark, sf_dir, "events", "event_id").select("event_id", "user_id")
    var = dimension(spark, "obs_variants", lambda: spark.createDataFrame(
        [(i,) + v for i, v in enumerate(OBS_VARIANTS)],
        "k long, protocol string, tls_version string, cipher string, "
        "has_subject boolean, asn1_curve string, pubkey_len int, banner string"))
    port = F.when(F.col("protocol") == "ssh", F.lit(22)) \
        .otherwise(F.when(F.col("event_id") % 2 == 0, F.lit(443)).otherwise(F.lit(8443)))
    return (ev.join(F.broadcast(var), (F.col("event_id") % len(OBS_VARIANTS)) == F.col("k"))
            .select(F.concat(F.lit("net"), (F.col("user_id") % N_NET_REPOS).cast("string")).alias("repo"),
                    F.concat(F.lit("host"), F.col("user_id").cast("string")).alias("host"),
                    port.cast("int").alias("port"), "protocol", "tls_version", "cipher",
                    "has_subject", "asn1_curve", "pubkey_len", "banner"))


SPEC_FORMS = ["ssh://host{u}", "tls://host{u}:8443", "host{u}:22", "host{u}", "tls://host{u}:22",
              "ssh://host{u}:2222", "host{u}:abc", "host{u}:443:extra"]


def endpoint_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → endpoint spec strings (S20 input), form by event_id % len."""
    ev = read_text_table(spark, sf_dir, "events", "event_id").select("event_id", "user_id")
    forms = dimension(spark, "spec_forms", lambda: spark.createDataFrame(
        [(i, f.split("{u}")[0], f.split("{u}")[1]) for i, f in enumerate(SPEC_FORMS)],
        "k long, pre string, post string"))
    return (ev.join(F.broadcast(forms), (F.col("event_id") % len(SPEC_FORMS)) == F.col("k"))
            .select("event_id", F.concat("pre", F.col("user_id").cast("string"), "post").alias("spec")))


# Policy table used by the policy queries (configuration, not data) and the
# evaluation instant that makes deadlines deterministic.
POLICIES = [
    dict(id="rsa-sunset", description="RSA keys had to go by spring 2025", algorithm="RSA", action="block",
         deadline="2025-03-31", message="Replace RSA keys"),
    dict(id="broken-digests", description="Digests with known collisions",
         algorithm=["MD5", "SHA-1"], action="block"),
    dict(id="signature-plan", description="Signatures move by autumn 2028",
         category="signature", severity=["critical", "high"], action="warn",
         deadline="2028-09-30", message="Plan the move of this signature"),
    dict(id="ecc-high-confidence", algorithm=["ecdsa", "ed25519", "ECDH"], min_confidence=0.9,
         action="warn", deadline="2026-06-30"),
    dict(id="tls-config", category=["protocol"], severity="high", action="block",
         deadline="not a date"),
    dict(id="never", algorithm=[], action="block"),
    dict(id="all-vulnerable", min_confidence=0.95, action="warn"),
]
POLICY_NOW = "2026-12-01 00:00:00"


# SBOM component variants by p_partkey % len: (name, version, purl); None
# name → the part's own name and size.  Every third part is an SPDX package.
COMPONENT_VARIANTS = [
    ("rsa-vault", "0.4.2", "pkg:npm/rsa-vault@0.4.2"),
    ("left-align", "2.1.0", "pkg:npm/left-align@2.1.0"),
    ("curve-kit", "3.0.1", "pkg:npm/%40keys/ed25519-kit@3.0.1"),
    (None, None, None),
    ("curves", "6.0.0", "pkg:npm/ecdsa-curves@6.0.0"),
    ("point-math", "5.2.0", "pkg:npm/secp256-points@5.2.0"),
    ("tls-tools", "3.1.4", None),
    ("md5", "9.9.1", "pkg:npm/md5-stream@9.9.1"),
]
N_SBOM_REPOS = 20
DOC_BASE = 2_000_000  # document ordinals of a large SBOM table


def sbom_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part → one small SBOM document per part (CycloneDX, or SPDX for every
    third part), owned by repository src<p_partkey % 20>."""
    part = read_text_table(spark, sf_dir, "part", "p_partkey").select("p_partkey", "p_name", "p_size")
    var = dimension(spark, "component_variants", lambda: spark.createDataFrame(
        [(i,) + v for i, v in enumerate(COMPONENT_VARIANTS)],
        "k long, v_name string, v_version string, v_purl string"))
    j = part.join(F.broadcast(var), (F.col("p_partkey") % len(COMPONENT_VARIANTS)) == F.col("k"))
    name = F.coalesce("v_name", "p_name")
    version = F.coalesce(F.col("v_version"), F.col("p_size").cast("string"))
    cdx = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"),
                             F.array(F.struct(F.lit("library").alias("type"), name.alias("name"),
                                              version.alias("version"),
                                              F.col("v_purl").alias("purl"))).alias("components")))
    refs = F.when(F.col("v_purl").isNotNull(), F.array(F.struct(
        F.lit("purl").alias("referenceType"), F.col("v_purl").alias("referenceLocator"))))
    spdx = F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"),
                              F.array(F.struct(F.concat(F.lit("SPDXRef-"), F.col("p_partkey").cast("string"))
                                             .alias("SPDXID"), name.alias("name"), version.alias("versionInfo"),
                                               refs.alias("externalRefs"))).alias("packages")))
    return j.select(F.concat(F.lit("src"), (F.col("p_partkey") % N_SBOM_REPOS).cast("string")).alias("sbom_id"),
                    (F.col("p_partkey") + DOC_BASE).alias("doc_ord"),
                    F.when(F.col("p_partkey") % 3 == 2, spdx).otherwise(cdx).alias("content"))


# A user rule table (E1) for the join-form query: a duplicated id (P8) and a
# language-restricted rule.
USER_RULES = [
    dict(id="CUSTOM_RSA", description="Any RSA mention", severity="critical", category="kem",
         algorithm="RSA", replacement="ML-KEM-768", effort="complex", languages=[],
         patterns=[r"rsa\b", r"RSA_sign"]),
    dict(id="CUSTOM_RSA", description="RSA key generation", severity="high", category="kem",
         algorithm="RSA", replacement="ML-KEM-768", effort="complex", languages=[],
         patterns=[r"generateKeyPair\s*\(", r"keypairgenerator"]),
    dict(id="CONFIG_TLS_FILES", description="TLS key material in config", severity="high",
         category="protocol", algorithm="TLS", replacement=None, effort="moderate",
         languages=["config"], patterns=[r"tls\.(crt|key)", r"secretName:"]),
    dict(id="SAFE_HASH", description="SHA-2 family", severity="safe", category="hash",
         algorithm="SHA-2", replacement=None, effort="trivial", languages=[],
         patterns=[r"sha-?(256|384|512)"]),
]


# ------------------------------------------------------- large rule table

#: Patterns of a rule over two words of a document.
RULE_FORMS = ["{0}\\s+{1}", "(?:{0}|{1})[.,;]", "{0}[a-z]*\\W+{1}", "(?:{0})+ .*{1}"]
RULES_PER_DOCUMENT = 3


def document_rules(spark, sf_dir):
    """A user rule table that grows with the corpus: for each document up to
    three rules, each over two neighbouring words of its text, in four forms."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+").alias("w"))
    pairs = docs.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.lit(RULES_PER_DOCUMENT - 1))).alias("i")).select(
        "doc_id", "i", F.get("w", F.col("i") * 5 + 2).alias("a"), F.get("w", F.col("i") * 5 + 3).alias("b"))
    plain = "^[A-Za-z]{3,20}$"
    form = F.element_at(F.array(*[F.lit(x) for x in RULE_FORMS]), ((F.col("doc_id") + F.col("i")) % len(RULE_FORMS) + 1).cast("int"))
    pattern = F.replace(F.replace(form, F.lit("{0}"), F.col("a")), F.lit("{1}"), F.col("b"))
    text = lambda v: F.lit(v)
    return pairs.where(F.col("a").rlike(plain) & F.col("b").rlike(plain)).select(
        (F.col("doc_id") * 100 + F.col("i")).cast("int").alias("rule_ord"), F.concat(F.lit("DOC_"), F.upper("a")).alias("rule_id"), F.concat(F.lit("Words of document "), F.col("doc_id")).alias("description"),
        text("low").alias("severity"), text("hash").alias("category"), F.col("a").alias("algorithm"), F.lit(None).cast("string").alias("replacement"),
        text("trivial").alias("effort"), F.array().cast("array<string>").alias("languages"), F.array(pattern).alias("patterns"))
