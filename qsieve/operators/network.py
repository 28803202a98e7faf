"""Endpoint observations → findings (stateless projection + explode).

Each TLS observation yields a protocol finding (N1), a key-exchange finding
when the cipher suite reveals one (N2) and a certificate-key finding when a
certificate subject and public key were seen (N3/N4); an SSH observation
yields a server finding when its banner's first line starts with `SSH-`
(N5).  N6: the up-to-three findings are exploded, failures give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..sources.endpoints import endpoint_label
from .lines import FINDING_COLS


def _f(rule_id, description, severity, category, algorithm, replacement, effort, snippet,
       confidence, ord_) -> Column:
    return F.struct(F.lit(rule_id).alias("rule_id"), description.alias("description"),
                    severity.alias("severity"), F.lit(category).alias("category"),
                    algorithm.alias("algorithm"), replacement.alias("replacement"),
                    F.lit(effort).alias("effort"), snippet.alias("snippet"),
                    F.lit(confidence).alias("confidence"), F.lit(ord_).alias("rule_ord"))


def cert_key(curve: Column, pubkey_len: Column) -> Column:
    """(algorithm, bits) from the curve name or the public-key length."""
    ec_bits = (F.when(curve.isin("prime256v1", "P-256"), 256)
               .when(curve.isin("secp384r1", "P-384"), 384)
               .when(curve.isin("secp521r1", "P-521"), 521))
    has_curve = curve.isNotNull() & (curve != "")
    alg = F.when(has_curve, "ECDSA").when(pubkey_len >= 128, "RSA") \
        .when(pubkey_len <= 65, "ECDSA").otherwise("RSA")
    bits = F.when(has_curve, ec_bits).when(pubkey_len >= 128, pubkey_len * 8) \
        .when(pubkey_len <= 65, F.lit(None)).otherwise(pubkey_len * 8)
    return F.struct(alg.alias("algorithm"), bits.cast("int").alias("bits"))


def endpoint_findings(obs: DataFrame) -> DataFrame:
    """Findings (phase 7, method 'network') from `endpoint_obs` rows."""
    from ..functions.regex import JS_SPACE_JAVA
    tls = F.col("protocol") == "tls"
    proto = F.coalesce(F.col("tls_version"), F.lit("unknown"))
    cipher = F.col("cipher")
    vuln = proto != "TLSv1.3"
    snip = F.when(cipher.isNotNull(), F.concat(proto, F.lit(" "), cipher)).otherwise(proto)
    n1 = _f("NET_TLS_PROTOCOL",
            F.concat(proto, F.when(vuln, F.lit(" negotiated — key exchange is quantum-vulnerable"))
                     .otherwise(F.lit(" negotiated — uses ephemeral key exchange"))),
            F.when(vuln, F.lit("critical")).otherwise(F.lit("safe")), "protocol", proto,
            F.when(vuln, F.lit(C.NET_REPLACEMENT_TLS)), "moderate", snip, C.CONF_TLS, 0)
    is_rsa = cipher.startswith("TLS_RSA_") | cipher.rlike(r"^AES\d+-SHA")
    is_ecdh = cipher.rlike("ECDHE|X25519") | cipher.rlike(r"^TLS_.*_WITH_")
    kex_snip = F.concat(proto, F.lit(" "), cipher)
    n2 = F.when(cipher.isNotNull() & is_rsa, _f(
        "NET_TLS_KEX", F.lit(C.NET_KEX_RSA[0]), F.lit("critical"), "kem", F.lit("RSA"),
        F.lit(C.NET_KEX_RSA[1]), "moderate", kex_snip, C.CONF_TLS, 1)) \
        .when(cipher.isNotNull() & is_ecdh, _f(
            "NET_TLS_KEX", F.lit(C.NET_KEX_ECDH[0]), F.lit("critical"), "kem", F.lit("ECDH"),
            F.lit(C.NET_KEX_ECDH[1]), "moderate", kex_snip, C.CONF_TLS, 1))
    key = cert_key(F.col("asn1_curve"), F.col("pubkey_len"))
    bits_txt = F.when(key["bits"].isNotNull(), F.concat(key["bits"].cast("string"), F.lit("-bit ")))\
        .otherwise(F.lit(""))
    bits_snip = F.when(key["bits"].isNotNull(), F.concat(F.lit(" "), key["bits"].cast("string"),
                                                         F.lit("-bit"))).otherwise(F.lit(""))
    n4 = F.when(F.col("has_subject") & F.col("pubkey_len").isNotNull(), _f(
        "NET_TLS_CERT_KEY",
        F.concat(F.lit("Certificate uses "), key["algorithm"], F.lit(" "), bits_txt,
                 F.lit("key — vulnerable to Shor's algorithm")),
        F.lit("critical"), "signature", key["algorithm"], F.lit(C.NET_CERT_REPLACEMENT),
        "complex", F.concat(key["algorithm"], bits_snip, F.lit(" key, "), proto), C.CONF_TLS, 2))
    first_line = F.regexp_replace(F.substring_index(F.coalesce(F.col("banner"), F.lit("")), "\n", 1),
                                  f"^{JS_SPACE_JAVA}+|{JS_SPACE_JAVA}+$", "")
    n5 = F.when(first_line.startswith("SSH-"), _f(
        "NET_SSH_SERVER", F.lit(C.NET_SSH[0]), F.lit("high"), "protocol", F.lit("SSH"),
        F.lit(C.NET_SSH[1]), "moderate", first_line, C.CONF_SSH, 0))
    found = F.when(tls, F.array(n1, n2, n4)).otherwise(F.array(n5))
    out = (obs.select("repo", endpoint_label(F.col("protocol"), F.col("host"), F.col("port"))
                      .alias("file"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
           .select("repo", "file", "f.*"))
    return out.select("repo", "rule_id", "description", "severity", "category", "algorithm",
                      "replacement", "effort", "file", F.lit(None).cast("int").alias("line"),
                      F.lit(None).cast("int").alias("column"), "snippet",
                      F.lit("network").alias("detection_method"), "confidence",
                      F.lit(C.PHASE_NETWORK).alias("phase"), "rule_ord").select(*FINDING_COLS)
