"""Dimension content: detection rules, usage patterns, known packages, path lists.

Everything between the FIXED VALUES markers must equal the values of the
scanner whose results we reproduce; it is stated plainly, in its natural
order.  Everything after the markers is our own derived data (token gates).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — begin.  Must equal the reference values for identical results.
# ---------------------------------------------------------------------------

SEVERITIES = ["critical", "high", "medium", "low", "safe"]  # rank 0..4
CATEGORIES = ["kem", "signature", "hash", "symmetric", "protocol", "kdf"]
EFFORTS = ["trivial", "moderate", "complex", "breaking"]

CATEGORY_LABELS = {
    "kem": "KEM",
    "signature": "Signature",
    "hash": "Hash",
    "symmetric": "Symmetric",
    "protocol": "Protocol",
    "kdf": "KDF",
}

# Detection rules, in file order.  Fields: id, description, severity, category,
# algorithm, replacement, effort, languages (empty = all), patterns.
RULES = [
    dict(id="RSA_KEY_GEN",
         description="RSA key generation — all RSA key sizes are vulnerable to Shor's algorithm",
         severity="critical", category="kem", algorithm="RSA",
         replacement="ML-KEM-768 (FIPS 203) for encryption, ML-DSA-65 (FIPS 204) for signatures",
         effort="complex", languages=[],
         patterns=[r"rsa\.GenerateKey", r"RSA\.generate", r"rsa_generate_key",
                   r"generateKeyPair\s*\(.*['\"]RSA['\"]",
                   r"KeyPairGenerator\.getInstance\s*\(.*['\"]RSA['\"]",
                   r"crypto\.generateKeyPairSync\s*\(.*['\"]rsa['\"]",
                   r"new\s+RSAKeyGenParameterSpec", r"RSA_generate_key_ex",
                   r"openssl_pkey_new.*RSA"]),
    dict(id="RSA_ENCRYPT",
         description="RSA encryption — vulnerable to quantum factoring",
         severity="critical", category="kem", algorithm="RSA",
         replacement="ML-KEM-768 (FIPS 203)", effort="complex", languages=[],
         patterns=[r"RSA/ECB/", r"RSA/NONE/", r"RSAES-OAEP", r"RSA_public_encrypt",
                   r"rsa\.encrypt", r"PKCS1_OAEP", r"PKCS1_v1_5",
                   r"crypto\.publicEncrypt", r"crypto\.privateDecrypt"]),
    dict(id="RSA_SIGN",
         description="RSA signature — vulnerable to quantum factoring",
         severity="critical", category="signature", algorithm="RSA",
         replacement="ML-DSA-65 (FIPS 204)", effort="complex", languages=[],
         patterns=[r"SHA256withRSA", r"SHA384withRSA", r"SHA512withRSA", r"RS256",
                   r"RS384", r"RS512", r"PS256", r"PS384", r"PS512", r"RSASSA-PSS",
                   r"RSA_sign", r"rsa\.sign"]),
    dict(id="ECDSA_USAGE",
         description="ECDSA signatures — vulnerable to Shor's algorithm on elliptic curves",
         severity="critical", category="signature", algorithm="ECDSA",
         replacement="ML-DSA-65 (FIPS 204)", effort="complex", languages=[],
         patterns=[r"ECDSA", r"ES256", r"ES384", r"ES512", r"SHA256withECDSA",
                   r"ec\.sign", r"ec\.verify", r"ECDSA_sign", r"ECDSA_verify",
                   r"secp256k1", r"secp256r1", r"secp384r1", r"prime256v1",
                   r"P-256", r"P-384", r"P-521"]),
    dict(id="ED25519_USAGE",
         description="Ed25519 signatures — elliptic curve, vulnerable to Shor's algorithm",
         severity="critical", category="signature", algorithm="Ed25519",
         replacement="ML-DSA-65 (FIPS 204) or hybrid Ed25519+ML-DSA-65",
         effort="moderate", languages=[],
         patterns=[r"ed25519", r"Ed25519", r"ED25519", r"@noble/ed25519",
                   r"ed25519-dalek", r"crypto\.sign\s*\(.*ed25519", r"nacl\.sign",
                   r"tweetnacl.*sign", r"sodium.*sign", r"EdDSA"]),
    dict(id="ECDH_KEY_EXCHANGE",
         description="ECDH key exchange — vulnerable to Shor's algorithm",
         severity="critical", category="kem", algorithm="ECDH",
         replacement="ML-KEM-768 (FIPS 203) or hybrid X25519+ML-KEM-768",
         effort="complex", languages=[],
         patterns=[r"ECDH", r"ecdh\.computeSecret", r"X25519", r"x25519",
                   r"Curve25519", r"curve25519", r"createECDH", r"diffieHellman",
                   r"DiffieHellman", r"KeyAgreement.*EC"]),
    dict(id="DH_KEY_EXCHANGE",
         description="Diffie-Hellman key exchange — vulnerable to Shor's algorithm",
         severity="critical", category="kem", algorithm="DH",
         replacement="ML-KEM-768 (FIPS 203)", effort="complex", languages=[],
         patterns=[r"DiffieHellman", r"createDiffieHellman", r"DH_generate_key",
                   r"DHParameterSpec", r"dh\.generateKeys", r"dh\.computeSecret"]),
    dict(id="DSA_USAGE",
         description="DSA signatures — vulnerable to Shor's algorithm",
         severity="critical", category="signature", algorithm="DSA",
         replacement="ML-DSA-65 (FIPS 204)", effort="complex", languages=[],
         patterns=[r"DSA\.generate", r"KeyPairGenerator.*DSA", r"SHA256withDSA",
                   r"DSA_generate_key"]),
    dict(id="SSH_RSA_KEY_TYPE",
         description="SSH RSA host/user key — vulnerable to Shor's algorithm",
         severity="critical", category="kem", algorithm="RSA",
         replacement="SSH keys using ML-DSA or hybrid PQ/traditional algorithms",
         effort="moderate", languages=["config"],
         patterns=[r"ssh-rsa", r"HostKey.*rsa", r"HostKeyAlgorithms.*ssh-rsa",
                   r"PubkeyAcceptedKeyTypes.*ssh-rsa", r"PubkeyAcceptedAlgorithms.*ssh-rsa"]),
    dict(id="SSH_ECDSA_KEY_TYPE",
         description="SSH ECDSA key type — vulnerable to Shor's algorithm",
         severity="critical", category="signature", algorithm="ECDSA",
         replacement="SSH keys using ML-DSA or hybrid PQ/traditional algorithms",
         effort="moderate", languages=["config"],
         patterns=[r"ecdsa-sha2-nistp256", r"ecdsa-sha2-nistp384", r"ecdsa-sha2-nistp521",
                   r"HostKeyAlgorithms.*ecdsa", r"PubkeyAcceptedKeyTypes.*ecdsa",
                   r"PubkeyAcceptedAlgorithms.*ecdsa"]),
    dict(id="SSH_VULNERABLE_KEX",
         description="SSH key exchange using DH or ECDH — vulnerable to Shor's algorithm",
         severity="critical", category="kem", algorithm="DH",
         replacement="Post-quantum hybrid key exchange (e.g. sntrup761x25519-sha512)",
         effort="moderate", languages=["config"],
         patterns=[r"KexAlgorithms.*diffie-hellman", r"KexAlgorithms.*ecdh-sha2",
                   r"diffie-hellman-group-exchange", r"diffie-hellman-group14",
                   r"diffie-hellman-group16", r"diffie-hellman-group18"]),
    dict(id="TLS_RSA_KEY_EXCHANGE",
         description="TLS cipher suite with RSA key exchange — no forward secrecy, quantum-vulnerable",
         severity="critical", category="kem", algorithm="RSA",
         replacement="TLS 1.3 (uses ephemeral key exchange only)",
         effort="moderate", languages=["config"],
         patterns=[r"TLS_RSA_WITH_", r"AES128-SHA(?!\d)", r"AES256-SHA(?!\d)",
                   r"AES128-GCM-SHA256", r"AES256-GCM-SHA384"]),
    dict(id="TLS_ECDHE_CIPHER",
         description="TLS cipher suite with ECDHE key exchange — quantum-vulnerable ephemeral keys",
         severity="critical", category="kem", algorithm="ECDH",
         replacement="TLS 1.3 with post-quantum hybrid key exchange (e.g. X25519Kyber768)",
         effort="moderate", languages=["config"],
         patterns=[r"ECDHE-RSA-", r"ECDHE-ECDSA-", r"TLS_ECDHE_"]),
    dict(id="K8S_RSA_PRIVATE_KEY",
         description="Kubernetes cert-manager RSA private key — quantum-vulnerable certificates",
         severity="critical", category="kem", algorithm="RSA",
         replacement="Post-quantum certificate algorithms when supported by cert-manager",
         effort="complex", languages=["config"],
         patterns=[r"algorithm:\s*RSA", r"privateKey:[\s\S]*algorithm:\s*RSA"]),
    dict(id="TLS_VULNERABLE_PROTOCOL",
         description="TLS 1.0/1.1 or SSLv3 — deprecated protocols with known vulnerabilities",
         severity="high", category="protocol", algorithm="TLS",
         replacement="TLS 1.3", effort="moderate", languages=["config"],
         patterns=[r"ssl_protocols.*TLSv1(?:[^.]|$)", r"ssl_protocols.*TLSv1\.1",
                   r"SSLProtocol.*SSLv3", r"SSLProtocol.*TLSv1(?:[^.]|$)",
                   r"MinProtocol.*TLSv1\.0", r"MinProtocol.*TLSv1\.1",
                   r"ssl-min-ver.*TLSv1\.0", r"ssl-min-ver.*TLSv1\.1",
                   r"tls_version.*TLSv1(?:\.0|\.1)?(?!\.[2-9])"]),
    dict(id="DOCKER_CRYPTO_INSTALL",
         description="Dockerfile installs crypto library — review for quantum-vulnerable algorithms",
         severity="high", category="protocol", algorithm="OpenSSL",
         replacement="Ensure installed crypto libraries support post-quantum algorithms",
         effort="moderate", languages=["config"],
         patterns=[r"(?:apt-get|apk add|yum|dnf).*(?:install|add).*(?:openssl|libssl|libcrypto|gnutls)",
                   r"pip install.*(?:cryptography|pycryptodome|pyOpenSSL)",
                   r"gem install.*(?:openssl|rbnacl)"]),
    dict(id="K8S_TLS_SECRET",
         description="Kubernetes TLS secret — may contain quantum-vulnerable certificates",
         severity="high", category="protocol", algorithm="TLS",
         replacement="Rotate TLS certificates to post-quantum algorithms when available",
         effort="complex", languages=["config"],
         patterns=[r"type:\s*kubernetes\.io/tls", r"secretName:.*tls", r"tls\.crt", r"tls\.key"]),
    dict(id="AES_128",
         description="AES-128 — Grover's algorithm reduces effective security to 64 bits",
         severity="high", category="symmetric", algorithm="AES-128",
         replacement="AES-256 (trivial upgrade — same API, different key size)",
         effort="trivial", languages=[],
         patterns=[r"AES-128", r"aes-128", r"AES/.*128", r"createCipheriv\s*\(.*aes-128",
                   r"Cipher\.getInstance.*AES.*128"]),
    dict(id="MD5_USAGE",
         description="MD5 — broken classically, trivially broken by quantum",
         severity="medium", category="hash", algorithm="MD5",
         replacement="SHA-256 or SHA-3", effort="trivial", languages=[],
         patterns=[r"md5", r"MD5", r"createHash\s*\(.*['\"]md5['\"]", r"MessageDigest.*MD5",
                   r"hashlib\.md5"]),
    dict(id="SHA1_USAGE",
         description="SHA-1 — collision attacks known, should migrate regardless of quantum",
         severity="medium", category="hash", algorithm="SHA-1",
         replacement="SHA-256 or SHA-3", effort="trivial", languages=[],
         patterns=[r"sha-?1(?!\d)", r"SHA-?1(?!\d)", r"createHash\s*\(.*['\"]sha1['\"]",
                   r"MessageDigest.*SHA.1", r"hashlib\.sha1"]),
    dict(id="DES_3DES",
         description="DES/3DES — deprecated, 64-bit block size",
         severity="medium", category="symmetric", algorithm="3DES",
         replacement="AES-256", effort="moderate", languages=[],
         patterns=[r"DES", r"3DES", r"DESede", r"TripleDES", r"des-ede3", r"des-cbc"]),
    dict(id="ML_KEM",
         description="ML-KEM (Kyber) — NIST FIPS 203 post-quantum key encapsulation",
         severity="safe", category="kem", algorithm="ML-KEM",
         replacement=None, effort="trivial", languages=[],
         patterns=[r"ml.kem", r"ML-KEM", r"ML_KEM", r"mlKem", r"kyber", r"KYBER",
                   r"Kyber768", r"Kyber1024", r"@noble/post-quantum.*kem"]),
    dict(id="ML_DSA",
         description="ML-DSA (Dilithium) — NIST FIPS 204 post-quantum signatures",
         severity="safe", category="signature", algorithm="ML-DSA",
         replacement=None, effort="trivial", languages=[],
         patterns=[r"ml.dsa", r"ML-DSA", r"ML_DSA", r"mlDsa", r"dilithium", r"DILITHIUM",
                   r"Dilithium", r"@noble/post-quantum.*dsa"]),
    dict(id="SLH_DSA",
         description="SLH-DSA (SPHINCS+) — NIST FIPS 205 hash-based post-quantum signatures",
         severity="safe", category="signature", algorithm="SLH-DSA",
         replacement=None, effort="trivial", languages=[],
         patterns=[r"slh.dsa", r"SLH-DSA", r"SLH_DSA", r"sphincs", r"SPHINCS"]),
    dict(id="AES_256",
         description="AES-256 — 128-bit post-quantum security, sufficient",
         severity="safe", category="symmetric", algorithm="AES-256",
         replacement=None, effort="trivial", languages=[],
         patterns=[r"AES-256", r"aes-256", r"aes-256-gcm", r"aes-256-cbc"]),
    dict(id="CHACHA20",
         description="ChaCha20-Poly1305 — symmetric AEAD, quantum-resistant",
         severity="safe", category="symmetric", algorithm="ChaCha20-Poly1305",
         replacement=None, effort="trivial", languages=[],
         patterns=[r"chacha20", r"ChaCha20", r"CHACHA20", r"chacha20-poly1305", r"xchacha20"]),
    dict(id="SHA256_SAFE",
         description="SHA-256 — quantum-resistant hash (Grover reduces to 128-bit, still safe)",
         severity="safe", category="hash", algorithm="SHA-256",
         replacement=None, effort="trivial", languages=[],
         patterns=[r"sha-?256", r"SHA-?256", r"createHash\s*\(.*['\"]sha256['\"]"]),
    dict(id="SHA3_SAFE",
         description="SHA-3 — quantum-resistant hash",
         severity="safe", category="hash", algorithm="SHA-3",
         replacement=None, effort="trivial", languages=[],
         patterns=[r"sha-?3(?!\d)", r"SHA-?3(?!\d)", r"keccak", r"KECCAK"]),
]

# Regex confidence tests (case-sensitive) and the confidence constants.
CONF_KEYWORD_RE = r"(?:import|require|from|include|use)\b"
CONF_CALL_RE = r"\(.*['\"].*['\"]\)"
CONF_COMMENT_RE = r"^\s*(?:\/\/|#|\/\*|\*|--|;)"
CONF_BASE, CONF_KEYWORD, CONF_CALL, CONF_COMMENT = 0.7, 0.9, 0.85, 0.3
CONF_NULL_LANG_FACTOR, CONF_SAFE_FLOOR = 0.8, 0.8
CONF_DEPENDENCY, CONF_TLS, CONF_SSH = 0.95, 1.0, 0.85
DEFAULT_MIN_CONFIDENCE = 50
MAX_REGEX_CHARS = 1_000_000
SNIPPET_CHARS = 120

# File discovery.
SOURCE_EXTENSIONS = ["js", "mjs", "cjs", "jsx", "ts", "tsx", "mts", "cts", "py", "go", "rs",
                     "java", "kt", "kts", "cs", "c", "h", "cpp", "cc", "hpp", "swift", "rb",
                     "php", "toml", "yaml", "yml", "json", "xml", "conf", "cfg", "ini", "env",
                     "pem", "crt", "cer"]
CONFIG_FILE_NAMES = ["Dockerfile", "Dockerfile.*", "sshd_config", "ssh_config", "nginx.conf",
                     "haproxy.cfg", ".ssh/config"]
DEFAULT_EXCLUDE_DIRS = ["node_modules", "dist", "build", ".git", "vendor", "target",
                        "__pycache__", ".venv", "coverage"]
DEFAULT_EXCLUDE_SUFFIXES = [".min.js", ".map"]
DEFAULT_EXCLUDE_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock"]

LANG_MAP = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin",
    ".kts": "kotlin", ".cs": "csharp", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp",
    ".hpp": "cpp", ".swift": "swift", ".rb": "ruby", ".php": "php", ".toml": "config",
    ".yaml": "config", ".yml": "config", ".json": "config", ".xml": "config",
    ".conf": "config", ".cfg": "config", ".ini": "config", ".env": "config",
    ".pem": "certificate", ".crt": "certificate", ".cer": "certificate",
}
FILENAME_MAP = {"dockerfile": "config", "sshd_config": "config", "ssh_config": "config",
                "config": "config"}
BINARY_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".ttf",
                     ".eot", ".zip", ".gz", ".tar", ".jar", ".class", ".so", ".dylib",
                     ".dll", ".exe", ".o", ".a", ".wasm", ".mp3", ".mp4", ".pdf"]

# Usage patterns.  Imports: (packages, rule id, confidence).
IMPORT_PATTERNS = [
    (["@noble/ed25519"], "ED25519_USAGE", 0.98),
    (["@noble/secp256k1"], "ECDSA_USAGE", 0.98),
    (["node-rsa"], "RSA_KEY_GEN", 0.95),
    (["tweetnacl"], "ED25519_USAGE", 0.95),
    (["elliptic"], "ECDSA_USAGE", 0.95),
    (["jsonwebtoken"], "RSA_SIGN", 0.90),
    (["jose"], "RSA_SIGN", 0.90),
    (["@solana/web3.js"], "ED25519_USAGE", 0.95),
    (["ethers"], "ECDSA_USAGE", 0.95),
    (["web3"], "ECDSA_USAGE", 0.95),
    (["libsodium-wrappers"], "ED25519_USAGE", 0.90),
    (["@noble/post-quantum"], "ML_KEM", 0.98),
]
# Calls: (method name, algorithm argument prefixes, rule id, confidence).
CALL_PATTERNS = [
    ("createHash", ["md5"], "MD5_USAGE", 0.95),
    ("createHash", ["sha1"], "SHA1_USAGE", 0.95),
    ("createHash", ["sha256"], "SHA256_SAFE", 0.95),
    ("createHash", ["sha3"], "SHA3_SAFE", 0.95),
    ("createCipheriv", ["aes-128-cbc", "aes-128-gcm", "aes-128-ctr"], "AES_128", 0.95),
    ("createCipheriv", ["aes-256-gcm", "aes-256-cbc", "aes-256-ctr"], "AES_256", 0.95),
    ("createCipheriv", ["chacha20-poly1305"], "CHACHA20", 0.95),
    ("createCipheriv", ["des", "des-cbc", "des-ede3", "des3"], "DES_3DES", 0.95),
    ("generateKeyPairSync", ["rsa"], "RSA_KEY_GEN", 0.96),
    ("generateKeyPair", ["rsa"], "RSA_KEY_GEN", 0.96),
    ("generateKeyPairSync", ["ec", "ed25519"], "ED25519_USAGE", 0.96),
    ("generateKeyPair", ["ec", "ed25519"], "ED25519_USAGE", 0.96),
    ("generateKeyPairSync", ["dsa"], "DSA_USAGE", 0.96),
    ("createECDH", ["secp256k1", "prime256v1", "secp384r1", "secp521r1"], "ECDH_KEY_EXCHANGE", 0.96),
    ("createDiffieHellman", [], "DH_KEY_EXCHANGE", 0.95),
    ("publicEncrypt", [], "RSA_ENCRYPT", 0.95),
    ("privateDecrypt", [], "RSA_ENCRYPT", 0.95),
]
# Option objects: (object, method, option key, option values, rule id, confidence).
OPTION_PATTERNS = [
    ("jwt", "sign", "algorithm", ["RS256", "RS384", "RS512", "PS256", "PS384", "PS512"], "RSA_SIGN", 0.96),
    ("jwt", "sign", "algorithm", ["ES256", "ES384", "ES512"], "ECDSA_USAGE", 0.96),
    ("jwt", "verify", "algorithms", ["RS256", "RS384", "RS512"], "RSA_SIGN", 0.96),
    ("jwt", "verify", "algorithms", ["ES256", "ES384", "ES512"], "ECDSA_USAGE", 0.96),
]

# Known packages: (name, algorithm, severity, category, description, replacement).
NPM_PACKAGES = [
    ("@noble/post-quantum", "ML-KEM / ML-DSA", "safe", "kem",
     "Post-quantum cryptography library (ML-KEM, ML-DSA, SLH-DSA)", None),
    ("@noble/ed25519", "Ed25519", "critical", "signature",
     "Ed25519 signatures — vulnerable to Shor's algorithm", "ML-DSA-65 via @noble/post-quantum"),
    ("@noble/secp256k1", "secp256k1 (ECDSA)", "critical", "signature",
     "secp256k1 ECDSA — vulnerable to Shor's algorithm", "ML-DSA-65 via @noble/post-quantum"),
    ("tweetnacl", "Ed25519 / X25519", "critical", "signature",
     "NaCl crypto (Ed25519 signatures, X25519 key exchange) — both quantum-vulnerable",
     "ML-DSA-65 + ML-KEM-768 via @noble/post-quantum"),
    ("elliptic", "ECDSA / ECDH", "critical", "signature",
     "Elliptic curve library — all ECC is quantum-vulnerable", "ML-DSA-65 + ML-KEM-768"),
    ("node-rsa", "RSA", "critical", "kem",
     "RSA encryption/signatures — vulnerable to Shor's algorithm", "ML-KEM-768 + ML-DSA-65"),
    ("jsonwebtoken", "RS256/ES256 (likely)", "critical", "signature",
     "JWT library — likely uses RSA or ECDSA for signing",
     "Consider ML-DSA-based JWT signing when IETF PQC JWT standards emerge"),
    ("jose", "RS256/ES256 (configurable)", "critical", "signature",
     "JOSE/JWT library — supports RSA and ECDSA signing", "Monitor IETF PQC JWT standards progress"),
    ("@solana/web3.js", "Ed25519 (Solana)", "critical", "signature",
     "Solana Web3 — all Solana keys are Ed25519, quantum-vulnerable",
     "Blocked by Solana ecosystem PQC migration. Monitor Solana PQC proposals."),
    ("ethers", "secp256k1 (Ethereum)", "critical", "signature",
     "Ethers.js — Ethereum uses secp256k1 ECDSA, quantum-vulnerable",
     "Blocked by Ethereum PQC migration. Monitor EIP proposals."),
    ("web3", "secp256k1 (Ethereum)", "critical", "signature",
     "Web3.js — Ethereum uses secp256k1 ECDSA, quantum-vulnerable",
     "Blocked by Ethereum PQC migration. Monitor EIP proposals."),
    ("libsodium-wrappers", "XChaCha20-Poly1305 / Ed25519", "critical", "signature",
     "libsodium — symmetric crypto is safe but Ed25519/X25519 are quantum-vulnerable",
     "Audit usage: keep symmetric ops, migrate asymmetric to PQC"),
]
CARGO_CRATES = [
    ("ed25519-dalek", "Ed25519", "critical", "signature",
     "Ed25519 signatures — vulnerable to Shor's algorithm", "ML-DSA-65 via pqcrypto crate"),
    ("rsa", "RSA", "critical", "kem",
     "RSA encryption/signatures — vulnerable to Shor's algorithm",
     "ML-KEM-768 + ML-DSA-65 via pqcrypto crate"),
    ("p256", "ECDSA (P-256)", "critical", "signature",
     "ECDSA P-256 signatures — vulnerable to Shor's algorithm", "ML-DSA-65 via pqcrypto crate"),
    ("p384", "ECDSA (P-384)", "critical", "signature",
     "ECDSA P-384 signatures — vulnerable to Shor's algorithm", "ML-DSA-65 via pqcrypto crate"),
    ("x25519-dalek", "X25519", "critical", "kem",
     "X25519 key exchange — vulnerable to Shor's algorithm", "ML-KEM-768 via pqcrypto crate"),
    ("ring", "RSA/ECDSA/Ed25519", "critical", "signature",
     "ring crypto library — contains quantum-vulnerable RSA, ECDSA, Ed25519",
     "Audit usage: migrate asymmetric operations to pqcrypto crate"),
    ("secp256k1", "secp256k1", "critical", "signature",
     "secp256k1 ECDSA — vulnerable to Shor's algorithm", "ML-DSA-65 via pqcrypto crate"),
    ("pqcrypto", "ML-KEM/ML-DSA", "safe", "kem",
     "Post-quantum cryptography library (ML-KEM, ML-DSA)", None),
    ("oqs", "PQC", "safe", "kem", "Open Quantum Safe — post-quantum cryptography bindings", None),
]
GO_MODULES = [
    ("golang.org/x/crypto", "Ed25519/Curve25519 (mixed)", "critical", "signature",
     "Go extended crypto — contains quantum-vulnerable Ed25519, Curve25519",
     "Audit usage: migrate asymmetric operations to github.com/cloudflare/circl"),
    ("github.com/btcsuite/btcd", "secp256k1", "critical", "signature",
     "btcd Bitcoin library — secp256k1 ECDSA, quantum-vulnerable",
     "Blocked by Bitcoin ecosystem PQC migration"),
    ("filippo.io/edwards25519", "Ed25519", "critical", "signature",
     "Ed25519 curve implementation — vulnerable to Shor's algorithm",
     "ML-DSA-65 via github.com/cloudflare/circl"),
    ("github.com/cloudflare/circl", "PQC (Kyber/Dilithium)", "safe", "kem",
     "Cloudflare CIRCL — post-quantum cryptography support (Kyber, Dilithium)", None),
    ("go.dedis.ch/kyber", "Kyber", "safe", "kem", "DEDIS Kyber — post-quantum key encapsulation", None),
]
PIP_PACKAGES = [
    ("cryptography", "RSA/ECDSA/DH", "critical", "kem",
     "Python cryptography library — default algorithms (RSA, ECDSA, DH) are quantum-vulnerable",
     "Audit usage: migrate asymmetric operations to pqcrypto or liboqs-python"),
    ("pycryptodome", "RSA/AES/DH", "critical", "kem",
     "PyCryptodome — RSA and DH are quantum-vulnerable",
     "Audit usage: keep symmetric ops, migrate asymmetric to pqcrypto"),
    ("pycryptodomex", "RSA/AES/DH", "critical", "kem",
     "PyCryptodomex — RSA and DH are quantum-vulnerable",
     "Audit usage: keep symmetric ops, migrate asymmetric to pqcrypto"),
    ("pynacl", "Ed25519/X25519", "critical", "signature",
     "PyNaCl — Ed25519 signatures and X25519 key exchange are quantum-vulnerable",
     "ML-DSA-65 + ML-KEM-768 via pqcrypto"),
    ("ecdsa", "ECDSA", "critical", "signature",
     "ECDSA library — all elliptic curve signatures are quantum-vulnerable", "ML-DSA-65 via pqcrypto"),
    ("rsa", "RSA", "critical", "kem", "RSA library — vulnerable to Shor's algorithm",
     "ML-KEM-768 + ML-DSA-65 via pqcrypto"),
    ("paramiko", "RSA/ECDSA SSH", "critical", "kem",
     "Paramiko SSH library — uses RSA and ECDSA for SSH, quantum-vulnerable",
     "Monitor OpenSSH PQC migration for Paramiko support"),
    ("pyopenssl", "RSA/ECDSA", "critical", "kem",
     "pyOpenSSL — RSA and ECDSA operations are quantum-vulnerable",
     "Audit usage: migrate asymmetric operations to pqcrypto or liboqs-python"),
    ("pqcrypto", "PQC", "safe", "kem", "Post-quantum cryptography library for Python", None),
    ("liboqs-python", "PQC", "safe", "kem",
     "Open Quantum Safe Python bindings — post-quantum cryptography", None),
]
# Java: (group, artifact regex, algorithm, severity, category, description, replacement).
JAVA_PACKAGES = [
    ("org.bouncycastle", r"bcprov-jdk\w*", "RSA/ECDSA/DH", "critical", "kem",
     "Bouncy Castle provider — RSA, ECDSA, DH are quantum-vulnerable",
     "Migrate to org.bouncycastle:bcpqc-jdk* for post-quantum algorithms"),
    ("org.bouncycastle", r"bcpkix-jdk\w*", "RSA/ECDSA certificates", "critical", "signature",
     "Bouncy Castle PKIX — RSA and ECDSA certificate operations are quantum-vulnerable",
     "Migrate to PQC certificate algorithms when available"),
    ("org.bouncycastle", r"bcpqc-jdk\w*", "PQC (Kyber/Dilithium)", "safe", "kem",
     "Bouncy Castle PQC — post-quantum cryptography (Kyber, Dilithium)", None),
    ("com.google.crypto.tink", r"tink", "RSA/ECDSA (configurable)", "critical", "signature",
     "Google Tink — default configurations use RSA and ECDSA, quantum-vulnerable",
     "Monitor Tink PQC support progress"),
]
# Manifest files and the patterns of their entries ({} is a known name, escaped).
MANIFEST_FILES = ["package.json", "Cargo.toml", "go.mod", "requirements.txt", "pyproject.toml",
                  "build.gradle", "build.gradle.kts", "pom.xml"]
CARGO_LINE = r"(?m)^\s*{}\s*=\s*(.+)"
CARGO_QUOTED = r'^"([^"]*)"'
CARGO_VERSION = r'version\s*=\s*"([^"]*)"'
GO_LINE = r"(?m)^\s*{}(?:/\S*)?\s+(v\S+)"
REQUIREMENT = r"^([a-zA-Z0-9_-]+)\s*(?:[><=!~]+\s*(\S+))?"
PYPROJECT_ENTRY = r"(?i)[\"']{}\s*(?:[><=!~]+\s*([^\"']+))?[\"']"
POM_DEPENDENCY = (r"<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>"
                  r"(?:\s*<version>([^<]+)</version>)?")
GRADLE_CONFIGURATIONS = ["implementation", "api", "compile", "runtimeOnly", "compileOnly"]

# Severity → report levels; category → CycloneDX crypto properties.
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note",
               "safe": "note"}
CLASSICAL_LEVEL = {"critical": 0, "high": 64, "medium": 0, "low": 128, "safe": 128}
NIST_QUANTUM_LEVEL = {"critical": 0, "high": 1, "medium": 0, "low": 3, "safe": 3}
ASSET_TYPE = {"kem": "algorithm", "signature": "algorithm", "hash": "algorithm",
              "symmetric": "algorithm", "protocol": "protocol", "kdf": "algorithm"}
PRIMITIVE = {"kem": "pke", "signature": "signature", "hash": "hash", "symmetric": "ae",
             "protocol": "other", "kdf": "kdf"}
CRYPTO_FUNCTION = {"kem": "encapsulate", "signature": "sign", "hash": "digest",
                   "symmetric": "encrypt", "protocol": "other", "kdf": "keygen"}
TOOL_VERSION = "0.1.0"

# Endpoint findings.
NET_REPLACEMENT_TLS = "TLS 1.3 with post-quantum hybrid key exchange (e.g. X25519Kyber768)"
NET_KEX_RSA = ("TLS RSA static key exchange — no forward secrecy, quantum-vulnerable",
               "TLS 1.3 (ephemeral key exchange only)")
NET_KEX_ECDH = ("ECDHE/X25519 key exchange — quantum-vulnerable ephemeral keys",
                "Post-quantum hybrid key exchange (e.g. X25519Kyber768)")
NET_CERT_REPLACEMENT = "Post-quantum certificate algorithms when available"
NET_SSH = ("SSH server detected — uses DH/ECDH key exchange (quantum-vulnerable)",
           "Enable post-quantum key exchange (e.g. sntrup761x25519-sha512@openssh.com)")

# ---------------------------------------------------------------------------
# FIXED VALUES — end.
# ---------------------------------------------------------------------------

# Our own: the tool identity written into report strings (property-name
# prefix, annotation tag, SPDX id prefix) is this package's name.
TOOL_NAME = "qsieve"
PROPERTY_PREFIX = TOOL_NAME + ":"
ANNOTATION_TAG = "[" + TOOL_NAME + "] "
SPDX_ID_PREFIX = "SPDXRef-" + TOOL_NAME + "-"

# Our own derived data: lower-case literals of which every match of a rule
# contains at least one (a cheap `contains` gate evaluated before the regex).
# tests/test_lines.py asserts gated == ungated hits.
TOKEN_GATES = {
    "RSA_KEY_GEN": ["rsa"],
    "RSA_ENCRYPT": ["rsa", "pkcs1_", "crypto.p"],
    "RSA_SIGN": ["rsa", "s256", "s384", "s512"],
    "ECDSA_USAGE": ["ecdsa", "es256", "es384", "es512", "ec.", "secp", "prime256v1",
                    "p-256", "p-384", "p-521"],
    "ED25519_USAGE": ["ed25519", "nacl.sign", "tweetnacl", "sodium", "eddsa"],
    "ECDH_KEY_EXCHANGE": ["ecdh", "x25519", "curve25519", "diffiehellman", "keyagreement"],
    "DH_KEY_EXCHANGE": ["diffiehellman", "dh_generate_key", "dhparameterspec", "dh."],
    "DSA_USAGE": ["dsa"],
    "SSH_RSA_KEY_TYPE": ["rsa"],
    "SSH_ECDSA_KEY_TYPE": ["ecdsa"],
    "SSH_VULNERABLE_KEX": ["diffie-hellman", "ecdh-sha2"],
    "TLS_RSA_KEY_EXCHANGE": ["tls_rsa_with_", "aes128-", "aes256-"],
    "TLS_ECDHE_CIPHER": ["ecdhe"],
    "K8S_RSA_PRIVATE_KEY": ["algorithm:"],
    "TLS_VULNERABLE_PROTOCOL": ["tlsv1", "sslv3"],
    "DOCKER_CRYPTO_INSTALL": ["openssl", "libssl", "libcrypto", "gnutls", "cryptography",
                              "pycryptodome", "rbnacl"],
    "K8S_TLS_SECRET": ["kubernetes.io/tls", "secretname:", "tls."],
    "AES_128": ["aes-128", "aes/", "cipher.getinstance"],
    "MD5_USAGE": ["md5"],
    "SHA1_USAGE": ["sha1", "sha-1", "messagedigest"],
    "DES_3DES": ["des"],
    "ML_KEM": ["kem", "kyber"],
    "ML_DSA": ["dsa", "dilithium"],
    "SLH_DSA": ["slh", "sphincs"],
    "AES_256": ["aes-256"],
    "CHACHA20": ["chacha20"],
    "SHA256_SAFE": ["sha256", "sha-256"],
    "SHA3_SAFE": ["sha3", "sha-3", "keccak"],
}

SEVERITY_RANK = {s: i for i, s in enumerate(SEVERITIES)}

# Detection phases: the order in which branches append findings.
PHASE_REGEX, PHASE_USAGE, PHASE_NPM, PHASE_CARGO, PHASE_GO, PHASE_PIP, PHASE_JAVA, PHASE_NETWORK = range(8)
