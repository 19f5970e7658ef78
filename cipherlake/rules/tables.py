"""Detection rules, in the order in which they are tried.

Everything in this module is a fixed value: keys, names, classes and severities must be what they are for results to
match. A row is `key | algorithm | class | severity`; a row that ends with `| safe` is not quantum-vulnerable.
"""

from __future__ import annotations

from typing import NamedTuple

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CLASSES = {"SHOR": "SHOR_VULNERABLE", "GROVER": "GROVER_WEAKENED", "SAFE": "QUANTUM_SAFE", "UNKNOWN": "UNKNOWN"}
COMPLEXITIES = ("LOW", "MEDIUM", "HIGH")


class Rule(NamedTuple):
    ord: int
    key: str
    algorithm: str
    vulnerability_class: str
    severity: str
    is_vulnerable: bool


def _rules(text: str) -> tuple[Rule, ...]:
    rows = []
    for line in text.strip().splitlines():
        key, algorithm, kind, severity, *safe = (x.strip() for x in line.split("|"))
        rows.append(Rule(len(rows) + 1, key, algorithm, CLASSES[kind], severity, not safe))
    return tuple(rows)


PYTHON_MODULES = _rules("""
Crypto       | PyCryptodome      | SHOR    | HIGH
Cryptodome   | PyCryptodome      | SHOR    | HIGH
cryptography | PyCA/cryptography | SHOR    | HIGH
rsa          | RSA               | SHOR    | CRITICAL
hashlib      | Hash/hashlib      | GROVER  | MEDIUM
hmac         | HMAC              | GROVER  | MEDIUM
jwt          | JWT               | SHOR    | HIGH
jose         | JOSE              | SHOR    | HIGH
ssl          | TLS/SSL           | SHOR    | HIGH
OpenSSL      | OpenSSL           | SHOR    | CRITICAL
ecdsa        | ECDSA             | SHOR    | CRITICAL
fastecdsa    | ECDSA             | SHOR    | CRITICAL
tinyec       | ECC               | SHOR    | CRITICAL
dh           | DH                | SHOR    | CRITICAL
dhparam      | DH                | SHOR    | CRITICAL
bcrypt       | bcrypt            | GROVER  | MEDIUM
passlib      | passlib           | GROVER  | MEDIUM
pyaes        | AES               | GROVER  | MEDIUM
random       | PRNG/random       | UNKNOWN | INFO | safe
""")

#: Imported member or sub-module (lower case) to algorithm name.
PYTHON_MEMBERS = {
    "rsa": "RSA", "dsa": "DSA", "ecdsa": "ECDSA", "ec": "ECC", "ecdh": "ECDH", "elgamal": "ElGamal", "dh": "DH",
    "aes": "AES", "des": "DES-3", "blowfish": "Blowfish", "arc2": "RC2", "arc4": "RC4", "chacha20": "ChaCha20",
    "md5": "MD5", "sha1": "SHA-1", "sha256": "SHA-256", "sha512": "SHA-512", "sha3": "SHA-3", "blake2": "BLAKE2",
    "pkcs1": "RSA-PKCS1", "oaep": "RSA-OAEP", "pss": "RSA-PSS", "padding": "RSA", "x25519": "X25519",
    "x448": "X448", "ed25519": "Ed25519", "ed448": "Ed448",
}

#: Key sizes that refine an algorithm, by its base name.
PYTHON_SIZE_PATTERN = r"\b(512|1024|2048|3072|4096|8192)\b"
PYTHON_SIZES = {
    "RSA": {512: "CRITICAL", 1024: "CRITICAL", 2048: "CRITICAL", 3072: "HIGH", 4096: "HIGH"},
    "DH": {512: "CRITICAL", 1024: "CRITICAL", 2048: "CRITICAL"},
    "AES": {128: "MEDIUM", 192: "LOW", 256: "LOW"},
}
OTHER_SIZE_PATTERN = r"\b(512|1024|2048|3072|4096)\b"
OTHER_SIZES = {"RSA": PYTHON_SIZES["RSA"]}

JS_MODULES = _rules("""
crypto       | Node-crypto | SHOR   | HIGH
tls          | TLS         | SHOR   | HIGH
https        | HTTPS/TLS   | SHOR   | MEDIUM
jsonwebtoken | JWT         | SHOR   | HIGH
jose         | JOSE        | SHOR   | HIGH
jwk-to-pem   | RSA-JWK     | SHOR   | CRITICAL
node-rsa     | RSA         | SHOR   | CRITICAL
node-forge   | RSA/ECC/DES | SHOR   | HIGH
jsrsasign    | RSA/ECDSA   | SHOR   | CRITICAL
elliptic     | ECC         | SHOR   | CRITICAL
eccrypto     | ECC         | SHOR   | CRITICAL
crypto-js    | CryptoJS    | GROVER | MEDIUM
aes-js       | AES         | GROVER | MEDIUM
bcrypt       | bcrypt      | GROVER | MEDIUM
bcryptjs     | bcrypt      | GROVER | MEDIUM
argon2       | Argon2      | GROVER | LOW | safe
ssh2         | SSH         | SHOR   | HIGH
node-ssh     | SSH         | SHOR   | HIGH
openpgp      | PGP/RSA     | SHOR   | HIGH
""")

JS_LITERALS = _rules("""
rsa-oaep          | RSA-OAEP       | SHOR   | CRITICAL
rsassa-pkcs1-v1_5 | RSA-PKCS1      | SHOR   | CRITICAL
rsa-pss           | RSA-PSS        | SHOR   | CRITICAL
ecdsa             | ECDSA          | SHOR   | CRITICAL
ecdh              | ECDH           | SHOR   | CRITICAL
md5               | MD5            | GROVER | CRITICAL
sha1              | SHA-1          | GROVER | CRITICAL
sha-1             | SHA-1          | GROVER | CRITICAL
sha256            | SHA-256        | GROVER | MEDIUM
sha-256           | SHA-256        | GROVER | MEDIUM
sha512            | SHA-512        | SAFE   | LOW | safe
aes-128-cbc       | AES-128-CBC    | GROVER | MEDIUM
aes-128-gcm       | AES-128-GCM    | GROVER | MEDIUM
aes-256-cbc       | AES-256-CBC    | GROVER | LOW | safe
aes-256-gcm       | AES-256-GCM    | SAFE   | LOW | safe
des               | DES            | GROVER | CRITICAL
des-cbc           | DES-CBC        | GROVER | CRITICAL
des-ede3          | 3DES           | GROVER | HIGH
rc4               | RC4            | GROVER | CRITICAL
rs256             | RSA-SHA256     | SHOR   | CRITICAL
rs384             | RSA-SHA384     | SHOR   | CRITICAL
rs512             | RSA-SHA512     | SHOR   | CRITICAL
es256             | ECDSA-SHA256   | SHOR   | CRITICAL
es384             | ECDSA-SHA384   | SHOR   | CRITICAL
es512             | ECDSA-SHA512   | SHOR   | CRITICAL
ps256             | RSA-PSS-SHA256 | SHOR   | CRITICAL
p-256             | ECC-P256       | SHOR   | CRITICAL
p-384             | ECC-P384       | SHOR   | CRITICAL
p-521             | ECC-P521       | SHOR   | CRITICAL
secp256k1         | ECC-secp256k1  | SHOR   | CRITICAL
""")

JS_METHODS = (
    "createhash", "createhmac", "createcipher", "createcipheriv", "createdecipher", "createdecipheriv", "createsign",
    "createverify", "generatekeypair", "generatekeypairsync", "generatekey", "generatekeysync", "publicencrypt",
    "privateencrypt", "publicdecrypt", "privatedecrypt", "sign", "verify", "importkey", "exportkey", "derivekey",
    "derivebits", "encrypt", "decrypt", "digest",
)

JAVA_LITERALS = _rules("""
rsa                                   | RSA             | SHOR   | CRITICAL
rsa/ecb/pkcs1padding                  | RSA-PKCS1       | SHOR   | CRITICAL
rsa/ecb/oaepwithsha-256andmgf1padding | RSA-OAEP-SHA256 | SHOR   | CRITICAL
rsa/ecb/oaepwithsha-1andmgf1padding   | RSA-OAEP-SHA1   | SHOR   | CRITICAL
rsassa-pkcs1-v1_5                     | RSA-PKCS1       | SHOR   | CRITICAL
dsa                                   | DSA             | SHOR   | CRITICAL
sha1withdsa                           | DSA-SHA1        | SHOR   | CRITICAL
sha256withdsa                         | DSA-SHA256      | SHOR   | CRITICAL
ec                                    | ECC             | SHOR   | CRITICAL
ecdsa                                 | ECDSA           | SHOR   | CRITICAL
ecdh                                  | ECDH            | SHOR   | CRITICAL
sha256withecdsa                       | ECDSA-SHA256    | SHOR   | CRITICAL
sha384withecdsa                       | ECDSA-SHA384    | SHOR   | CRITICAL
sha512withecdsa                       | ECDSA-SHA512    | SHOR   | CRITICAL
sha1withecdsa                         | ECDSA-SHA1      | SHOR   | CRITICAL
dh                                    | DH              | SHOR   | CRITICAL
diffiehellman                         | DH              | SHOR   | CRITICAL
sha1withrsa                           | RSA-SHA1        | SHOR   | CRITICAL
sha256withrsa                         | RSA-SHA256      | SHOR   | CRITICAL
sha384withrsa                         | RSA-SHA384      | SHOR   | CRITICAL
sha512withrsa                         | RSA-SHA512      | SHOR   | CRITICAL
md5withrsa                            | RSA-MD5         | SHOR   | CRITICAL
aes                                   | AES             | GROVER | MEDIUM
aes/cbc/pkcs5padding                  | AES-128-CBC     | GROVER | MEDIUM
aes/ecb/pkcs5padding                  | AES-ECB         | GROVER | HIGH
aes/gcm/nopadding                     | AES-GCM         | GROVER | LOW
aes/ctr/nopadding                     | AES-CTR         | GROVER | MEDIUM
des                                   | DES             | GROVER | CRITICAL
desede                                | 3DES            | GROVER | HIGH
desede/cbc/pkcs5padding               | 3DES-CBC        | GROVER | HIGH
rc4                                   | RC4             | GROVER | CRITICAL
arcfour                               | RC4             | GROVER | CRITICAL
blowfish                              | Blowfish        | GROVER | HIGH
md5                                   | MD5             | GROVER | CRITICAL
sha-1                                 | SHA-1           | GROVER | CRITICAL
sha1                                  | SHA-1           | GROVER | CRITICAL
sha-256                               | SHA-256         | GROVER | MEDIUM
sha-384                               | SHA-384         | SAFE   | LOW | safe
sha-512                               | SHA-512         | SAFE   | LOW | safe
sha-3                                 | SHA-3           | SAFE   | LOW | safe
hmacmd5                               | HMAC-MD5        | GROVER | CRITICAL
hmacsha1                              | HMAC-SHA1       | GROVER | HIGH
hmacsha256                            | HMAC-SHA256     | GROVER | MEDIUM
hmacsha384                            | HMAC-SHA384     | SAFE   | LOW | safe
hmacsha512                            | HMAC-SHA512     | SAFE   | LOW | safe
ssl                                   | TLS/SSL         | SHOR   | HIGH
tls                                   | TLS             | SHOR   | HIGH
tlsv1                                 | TLS-1.0         | SHOR   | CRITICAL
tlsv1.1                               | TLS-1.1         | SHOR   | CRITICAL
tlsv1.2                               | TLS-1.2         | SHOR   | HIGH
sslv3                                 | SSL-3.0         | SHOR   | CRITICAL
""")

JAVA_IMPORTS = _rules("""
javax.crypto                        | JCA/JCE               | SHOR   | HIGH
java.security                       | Java-Security         | SHOR   | HIGH
org.bouncycastle                    | BouncyCastle          | SHOR   | HIGH
org.springframework.security.crypto | Spring-Crypto         | SHOR   | HIGH
com.google.crypto.tink              | Google-Tink           | GROVER | LOW | safe
javax.net.ssl                       | TLS/SSL               | SHOR   | HIGH
java.security.interfaces.RSAKey     | RSA                   | SHOR   | CRITICAL
java.security.interfaces.ECKey      | ECC                   | SHOR   | CRITICAL
org.apache.commons.crypto           | Apache-Commons-Crypto | GROVER | MEDIUM
""")

#: Substrings of an import (lower case) that name its algorithm, first match wins.
JAVA_HINTS = (
    ("rsa", "RSA"), ("ecdsa", "ECDSA"), ("ecdh", "ECDH"), ("ec", "ECC"), ("dsa", "DSA"), ("dh", "DH"),
    ("aes", "AES"), ("des", "DES"), ("hmac", "HMAC"), ("md5", "MD5"), ("sha", "SHA"),
)

JAVA_METHODS = (
    "getinstance", "generatekeypair", "generatekey", "getkeygenerator", "getalgorithm", "init", "getkeyfactory",
    "createcipher", "createdigest",
)

GO_IMPORTS = _rules("""
crypto/rsa                           | RSA          | SHOR    | CRITICAL
crypto/ecdsa                         | ECDSA        | SHOR    | CRITICAL
crypto/elliptic                      | ECC          | SHOR    | CRITICAL
crypto/dsa                           | DSA          | SHOR    | CRITICAL
crypto/tls                           | TLS          | SHOR    | HIGH
crypto/x509                          | X509/PKI     | SHOR    | HIGH
crypto/md5                           | MD5          | GROVER  | CRITICAL
crypto/sha1                          | SHA-1        | GROVER  | CRITICAL
crypto/sha256                        | SHA-256      | GROVER  | MEDIUM
crypto/sha512                        | SHA-512      | SAFE    | LOW  | safe
crypto/des                           | DES          | GROVER  | CRITICAL
crypto/rc4                           | RC4          | GROVER  | CRITICAL
crypto/hmac                          | HMAC         | GROVER  | MEDIUM
crypto/cipher                        | Block-Cipher | GROVER  | MEDIUM
crypto/aes                           | AES          | GROVER  | MEDIUM
crypto/rand                          | CSPRNG       | UNKNOWN | INFO | safe
crypto/ecdh                          | ECDH         | SHOR    | CRITICAL
crypto/ed25519                       | Ed25519      | SHOR    | CRITICAL
golang.org/x/crypto/bcrypt           | bcrypt       | GROVER  | MEDIUM
golang.org/x/crypto/ssh              | SSH/RSA      | SHOR    | HIGH
golang.org/x/crypto/chacha20poly1305 | ChaCha20     | GROVER  | LOW  | safe
golang.org/x/crypto/curve25519       | X25519       | SHOR    | CRITICAL
golang.org/x/crypto/ed25519          | Ed25519      | SHOR    | CRITICAL
golang.org/x/crypto/openpgp          | PGP/RSA      | SHOR    | HIGH
golang.org/x/crypto/ripemd160        | RIPEMD-160   | GROVER  | HIGH
github.com/dgrijalva/jwt-go          | JWT          | SHOR    | HIGH
github.com/golang-jwt/jwt            | JWT          | SHOR    | HIGH
github.com/golang-jwt/jwt/v4         | JWT          | SHOR    | HIGH
github.com/golang-jwt/jwt/v5         | JWT          | SHOR    | HIGH
github.com/square/go-jose            | JOSE         | SHOR    | HIGH
gopkg.in/square/go-jose.v2           | JOSE         | SHOR    | HIGH
github.com/ProtonMail/go-crypto      | PGP/ECC      | SHOR    | HIGH
""")

GO_CALLS = _rules("""
rsa.generatekey             | RSA       | SHOR   | CRITICAL
rsa.encryptoaep             | RSA-OAEP  | SHOR   | CRITICAL
rsa.encryptpkcs1v15         | RSA-PKCS1 | SHOR   | CRITICAL
rsa.signpkcs1v15            | RSA-PKCS1 | SHOR   | CRITICAL
rsa.signpss                 | RSA-PSS   | SHOR   | CRITICAL
ecdsa.generatekey           | ECDSA     | SHOR   | CRITICAL
ecdsa.sign                  | ECDSA     | SHOR   | CRITICAL
ecdh.generatekey            | ECDH      | SHOR   | CRITICAL
dsa.generatekey             | DSA       | SHOR   | CRITICAL
md5.new                     | MD5       | GROVER | CRITICAL
md5.sum                     | MD5       | GROVER | CRITICAL
sha1.new                    | SHA-1     | GROVER | CRITICAL
sha1.sum                    | SHA-1     | GROVER | CRITICAL
des.newcipher               | DES       | GROVER | CRITICAL
rc4.newcipher               | RC4       | GROVER | CRITICAL
bcrypt.generatefrompassword | bcrypt    | GROVER | MEDIUM
""")

#: Known suite names; no detection uses them.
GO_TLS_SUITES = _rules("""
tls_rsa_with_aes_128_cbc_sha         | TLS-RSA-AES128-SHA     | SHOR | CRITICAL
tls_rsa_with_aes_256_cbc_sha         | TLS-RSA-AES256-SHA     | SHOR | CRITICAL
tls_rsa_with_3des_ede_cbc_sha        | TLS-RSA-3DES           | SHOR | CRITICAL
tls_ecdhe_rsa_with_aes_128_cbc_sha   | TLS-ECDHE-RSA-AES128   | SHOR | CRITICAL
tls_ecdhe_ecdsa_with_aes_128_cbc_sha | TLS-ECDHE-ECDSA-AES128 | SHOR | CRITICAL
""")

CSHARP_NAMESPACES = _rules("""
System.Security.Cryptography                  | DotNet-Crypto    | SHOR   | HIGH
System.Security.Cryptography.X509Certificates | X509/PKI         | SHOR   | HIGH
Org.BouncyCastle                              | BouncyCastle.Net | SHOR   | HIGH
System.IdentityModel.Tokens.Jwt               | JWT/RSA          | SHOR   | HIGH
Microsoft.IdentityModel.Tokens                | MSAL-Tokens      | SHOR   | HIGH
System.Net.Security                           | TLS/SSL          | SHOR   | HIGH
Microsoft.AspNetCore.DataProtection           | DataProtection   | GROVER | MEDIUM
""")

#: `tripleDES` has capitals, while names are looked up in lower case: it never matches.
CSHARP_CLASSES = _rules("""
rsacryptoserviceprovider       | RSA          | SHOR   | CRITICAL
rsacng                         | RSA          | SHOR   | CRITICAL
rsa                            | RSA          | SHOR   | CRITICAL
dsacryptoserviceprovider       | DSA          | SHOR   | CRITICAL
dsacng                         | DSA          | SHOR   | CRITICAL
dsa                            | DSA          | SHOR   | CRITICAL
ecdsacng                       | ECDSA        | SHOR   | CRITICAL
ecdsaopenssl                   | ECDSA        | SHOR   | CRITICAL
ecdsa                          | ECDSA        | SHOR   | CRITICAL
ecdhcng                        | ECDH         | SHOR   | CRITICAL
ecdh                           | ECDH         | SHOR   | CRITICAL
aescryptoserviceprovider       | AES          | GROVER | MEDIUM
aescng                         | AES          | GROVER | MEDIUM
aesmanaged                     | AES          | GROVER | MEDIUM
aes                            | AES          | GROVER | MEDIUM
descryptoserviceprovider       | DES          | GROVER | CRITICAL
tripledescryptoserviceprovider | 3DES         | GROVER | HIGH
tripleDES                      | 3DES         | GROVER | HIGH
rc2cryptoserviceprovider       | RC2          | GROVER | CRITICAL
rijndaelmanaged                | AES-Rijndael | GROVER | MEDIUM
md5cryptoserviceprovider       | MD5          | GROVER | CRITICAL
md5                            | MD5          | GROVER | CRITICAL
sha1managed                    | SHA-1        | GROVER | CRITICAL
sha1cryptoserviceprovider      | SHA-1        | GROVER | CRITICAL
sha256managed                  | SHA-256      | GROVER | MEDIUM
sha256                         | SHA-256      | GROVER | MEDIUM
sha384managed                  | SHA-384      | SAFE   | LOW | safe
sha512managed                  | SHA-512      | SAFE   | LOW | safe
hmacmd5                        | HMAC-MD5     | GROVER | CRITICAL
hmacsha1                       | HMAC-SHA1    | GROVER | HIGH
hmacsha256                     | HMAC-SHA256  | GROVER | MEDIUM
hmacsha384                     | HMAC-SHA384  | SAFE   | LOW | safe
hmacsha512                     | HMAC-SHA512  | SAFE   | LOW | safe
sslstream                      | TLS/SSL      | SHOR   | HIGH
x509certificate                | X509/RSA     | SHOR   | HIGH
x509certificate2               | X509/RSA     | SHOR   | HIGH
""")

CSHARP_LITERALS = _rules("""
rsa     | RSA          | SHOR   | CRITICAL
dsa     | DSA          | SHOR   | CRITICAL
ecdsa   | ECDSA        | SHOR   | CRITICAL
md5     | MD5          | GROVER | CRITICAL
sha1    | SHA-1        | GROVER | CRITICAL
sha-1   | SHA-1        | GROVER | CRITICAL
sha256  | SHA-256      | GROVER | MEDIUM
sha-256 | SHA-256      | GROVER | MEDIUM
aes     | AES          | GROVER | MEDIUM
3des    | 3DES         | GROVER | HIGH
des     | DES          | GROVER | CRITICAL
rc2     | RC2          | GROVER | CRITICAL
rs256   | RSA-SHA256   | SHOR   | CRITICAL
rs512   | RSA-SHA512   | SHOR   | CRITICAL
es256   | ECDSA-SHA256 | SHOR   | CRITICAL
""")

CSHARP_METHODS = (
    "create", "createfromname", "getinstance", "generate", "sign", "verify", "encrypt", "decrypt", "computehash",
    "transformfinalblock", "importpkcs8privatekey", "importsubjectpublickeyinfo",
)

#: (pattern without case, algorithm, class, severity) of manifest lines and dependency names; the first match wins.
MANIFEST_RULES = tuple(
    Rule(k + 1, pattern, algorithm, CLASSES[kind], severity, True)
    for k, (pattern, algorithm, kind, severity) in enumerate(
        (
            (r"\brsa\b", "RSA", "SHOR", "CRITICAL"),
            (r"pycryptodome|pycrypto|cryptodome", "RSA/AES (PyCryptodome)", "SHOR", "CRITICAL"),
            (r"cryptography", "RSA/EC (cryptography lib)", "SHOR", "HIGH"),
            (r"\becdsa\b", "ECDSA", "SHOR", "CRITICAL"),
            (r"\bpyopenssl\b", "RSA/EC (PyOpenSSL)", "SHOR", "HIGH"),
            (r"\bnode-rsa\b", "RSA (node-rsa)", "SHOR", "CRITICAL"),
            (r"\bjsencrypt\b", "RSA (jsencrypt)", "SHOR", "CRITICAL"),
            (r"\bnodejs-rsa\b|\bforge\b", "RSA (node-forge)", "SHOR", "CRITICAL"),
            (r"\becies\b|\belliptic\b", "ECDSA/ECDH (elliptic)", "SHOR", "CRITICAL"),
            (r"bouncycastle|bcprov", "RSA/EC (Bouncy Castle)", "SHOR", "HIGH"),
            (r"\baes\b|\bdes\b|\b3des\b|\bblowfish\b", "AES/DES (symmetric)", "GROVER", "MEDIUM"),
            (r"\bmd5\b|\bsha1\b|\bsha-1\b", "MD5/SHA-1 (weak hash)", "GROVER", "MEDIUM"),
            (r"golang\.org/x/crypto", "RSA/EC (golang.org/x/crypto)", "SHOR", "HIGH"),
            (r"\brsa\s*=|openssl\s*=", "RSA (Rust crate)", "SHOR", "CRITICAL"),
        )
    )
)

# Files.
SOURCE_SKIP_DIRS = (
    "node_modules", "vendor", "venv", ".venv", "env", ".env", "site-packages", "__pypackages__", "__pycache__",
    ".mypy_cache", ".ruff_cache", ".pytest_cache", "dist", "build", "target", "out", ".gradle", "bin", "obj", ".git",
    ".svn", ".hg", ".idea", ".vscode", ".github", ".circleci", "coverage", "htmlcov",
)
MANIFEST_SKIP_DIRS = ("node_modules", "vendor", "venv", ".venv", "env", "__pycache__", ".git", "dist", "build", "target")
MANIFEST_EXTENSIONS = (".txt", ".toml", ".json", ".xml", ".gradle", ".mod", ".lock", ".cfg")
MANIFEST_NAMES = (
    "requirements.txt", "requirements-dev.txt", "requirements-test.txt", "constraints.txt", "package.json",
    "package-lock.json", "yarn.lock", "pom.xml", "build.gradle", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock",
    "pyproject.toml", "setup.cfg", "setup.py", "Gemfile", "Gemfile.lock", "composer.json", "composer.lock",
)
LANGUAGE_EXTENSIONS = {
    "python": (".py",), "javascript": (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), "java": (".java",), "go": (".go",), "csharp": (".cs",),
}
LANGUAGE_ORDER = ("python", "javascript", "java", "go", "csharp")
DEPENDENCY_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")

# Redaction: (name, pattern, token kind, text before the token, text after it); tried in order without case.
_NAMES = (
    r"(?:password|passwd|pwd|secret(?:_key)?|api[_-]?key|auth(?:_key|_token)?|access[_-]?token|refresh[_-]?token|bearer"
    r"|credential(?:s)?|private[_-]?key|signing[_-]?key|encryption[_-]?key|master[_-]?key|symmetric[_-]?key|hmac[_-]?key"
    r"|aes[_-]?key|rsa[_-]?key|ssh[_-]?(?:key|pass(?:phrase)?)|client[_-]?secret|consumer[_-]?secret|jwt[_-]?secret"
    r"|cookie[_-]?secret|session[_-]?secret|db[_-]?(?:pass(?:word)?|secret)|database[_-]?pass(?:word)?)"
)
_SHORT_NAMES = (
    r"(?:password|passwd|pwd|secret(?:_key)?|api[_-]?key|auth(?:_key|_token)?|access[_-]?token|private[_-]?key"
    r"|signing[_-]?key|encryption[_-]?key)"
)
_PEM_KINDS = r"(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+|ENCRYPTED\s+)?PRIVATE\s+KEY"
_OCTETS = r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
REDACTIONS = (
    ("pem_private_key_block", rf"-----BEGIN\s+{_PEM_KINDS}-----[\s\S]*?-----END\s+{_PEM_KINDS}-----", "PEM_BLOCK", "", ""),
    ("pem_certificate_block", r"-----BEGIN\s+CERTIFICATE-----[\s\S]*?-----END\s+CERTIFICATE-----", "PEM_BLOCK", "", ""),
    ("pem_generic_block", r"-----BEGIN\s+[\w\s]+-----[\s\S]*?-----END\s+[\w\s]+-----", "PEM_BLOCK", "", ""),
    ("aws_access_key_id", r"\b(AKIA|ABIA|ACCA|AIPA|AKIA|ANPA|ANVA|AROA|APKA|ASIA)[A-Z0-9]{16}\b", "AWS_CREDENTIAL", "", ""),
    ("aws_secret_access_key", r"(?:aws_secret(?:_access)?_key|AWS_SECRET(?:_ACCESS)?_KEY)\s*[=:]\s*['\"]?([A-Za-z0-9+/]{40})['\"]?", "AWS_CREDENTIAL", "aws_secret_access_key = ", ""),
    ("jwt_token", r"['\"]?(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)['\"]?", "JWT", "", ""),
    ("connection_string", r"(?:postgresql|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[^:]+:[^@\s'\"]+@[^\s'\"]+", "CONNECTION_STRING", "", ""),
    ("github_token", r"\b(ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{36}\b", "SECRET", "", ""),
    ("google_api_key", r"\bAIza[A-Za-z0-9_\-]{35}\b", "SECRET", "", ""),
    ("stripe_key", r"\b(sk_live_|pk_live_|sk_test_|pk_test_)[A-Za-z0-9]{24,}\b", "SECRET", "", ""),
    ("generic_bearer_token", r"(?:Authorization|auth(?:orization)?)\s*[=:]\s*['\"]?Bearer\s+[A-Za-z0-9\-._~+/]+=*['\"]?", "SECRET", "Authorization = Bearer ", ""),
    ("secret_variable_assignment", _NAMES + r"(\s*[=:]\s*)(?:b?['\"])[^'\"]*(?:['\"])", "SECRET", "", ""),
    ("secret_variable_multiline", _SHORT_NAMES + r"(\s*[=:]\s*)(?:b?['\"]{3})[\s\S]*?(?:['\"]{3})", "SECRET", "", ""),
    ("os_environ_secret", r"os\.environ(?:\.get)?\s*\[?\s*['\"](?:password|passwd|secret|api_key|auth_token|private_key|signing_key)['\"](?:\s*\]|\s*,\s*['\"][^'\"]*['\"]|\s*\)\s*)(?:\s*=\s*['\"][^'\"]*['\"])?", "SECRET", "os.environ[", "]"),
    ("md5_digest", r"['\"][0-9a-fA-F]{32}['\"]", "HASH_DIGEST", "", ""),
    ("sha1_digest", r"['\"][0-9a-fA-F]{40}['\"]", "HASH_DIGEST", "", ""),
    ("sha256_digest", r"['\"][0-9a-fA-F]{64}['\"]", "HASH_DIGEST", "", ""),
    ("sha512_digest", r"['\"][0-9a-fA-F]{128}['\"]", "HASH_DIGEST", "", ""),
    ("hex_encoded_key", r"(?:b?['\"]|0x)(?:[0-9A-Fa-f]{32,})['\"]?", "KEY_MATERIAL", "", ""),
    ("base64_key_material", r"(?<![eE][yY][jJ])['\"](?:[A-Za-z0-9+/]{44,}={0,2})['\"](?!\.[A-Za-z0-9])", "KEY_MATERIAL", "", ""),
    ("bytes_key_literal", r"b['\"](?:\\x[0-9A-Fa-f]{2}){8,}['\"]", "KEY_MATERIAL", "", ""),
    ("ipv4_address", rf"(?<![0-9])(?!127\.0\.0\.1)(?!0\.0\.0\.0){_OCTETS}(?![0-9])", "IP", "", ""),
)
#: What must not be left after redaction (with case).
HIGH_RISK = (
    r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----",
    r"\b(AKIA|ABIA|ASIA)[A-Z0-9]{16}\b",
    r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    r"(?:postgresql|mysql|mongodb)://[^:]+:[^@\s'\"]{8,}@",
)

# Enrichment.
RESPONSE_KEYS = ("usage_context", "pqc_replacement", "migration_complexity", "reasoning")
SYMMETRIC_PREFIXES = ("AES", "SHA", "HMAC", "ARGON2", "BLAKE")
#: Substrings of an upper-case algorithm name and its document; the first match wins.
NIST_DOCUMENTS = (
    (("ML-KEM", "KYBER"), "FIPS 203"),
    (("ML-DSA", "DILITHIUM"), "FIPS 204"),
    (("SLH-DSA", "SPHINCS"), "FIPS 205"),
    (("FN-DSA", "FALCON"), "NIST IR 8413"),
    (("AES-256",), "FIPS 197"),
    (("SHA-3", "SHA3"), "FIPS 202"),
    (("SHA-384", "SHA-512"), "FIPS 180-4"),
)
#: Background by substring of a lower-case algorithm name; the first match wins, else the last text.
STATIC_CONTEXT = (
    ("rsa", "NIST FIPS 203 (ML-KEM / CRYSTALS-Kyber) is the approved replacement for RSA key encapsulation. NIST FIPS 204 (ML-DSA / CRYSTALS-Dilithium) replaces RSA signatures. NSA CNSA 2.0 mandates migration by 2030. Hybrid mode (classical + PQC in parallel) is recommended during transition."),
    ("ecdsa", "NIST FIPS 204 (ML-DSA / CRYSTALS-Dilithium) replaces ECDSA for digital signatures. FIPS 205 (SLH-DSA / SPHINCS+) is a stateless hash-based alternative. Both are broken by Shor's algorithm on a sufficiently large quantum computer."),
    ("ec", "Elliptic Curve cryptography (ECDH, ECDSA, ECIES) is vulnerable to Shor's algorithm. Replace key agreement with ML-KEM-768 (CRYSTALS-Kyber) per NIST FIPS 203. Replace signatures with ML-DSA-65 (Dilithium) per FIPS 204."),
    ("aes", "AES is weakened (not broken) by Grover's algorithm — effective key length is halved. AES-128 → AES-256 upgrade is sufficient. AES-256 is considered quantum-safe per NIST SP 800-131A Rev 2."),
    ("golang.org/x/crypto", "golang.org/x/crypto provides RSA, ECDSA, and ECDH primitives, all vulnerable to Shor's algorithm. Replace with golang.org/x/crypto/mlkem (ML-KEM, available Go 1.23+) for key encapsulation. For signatures use a Dilithium library such as github.com/cloudflare/circl/sign/dilithium."),
    ("pycryptodome", "PyCryptodome's RSA and ECC modules use classical algorithms broken by Shor's algorithm. Replace RSA with ML-KEM (pip install pyca/cryptography >= 42 with experimental PQC support) or liboqs-python for CRYSTALS-Kyber."),
    ("bouncycastle", "Bouncy Castle provides classical RSA/EC. The Bouncy Castle PQC provider (bcprov-ext-jdk18on) includes ML-KEM, ML-DSA, and SLH-DSA per NIST FIPS 203/204/205. Migrate to org.bouncycastle:bcpqc-jdk18on."),
)
DEFAULT_CONTEXT = "NIST has standardised three PQC algorithms: ML-KEM (FIPS 203, key encapsulation), ML-DSA (FIPS 204, signatures), and SLH-DSA (FIPS 205, stateless hash signatures). NSA CNSA 2.0 requires migration away from classical asymmetric crypto by 2030. Hybrid classical+PQC mode is recommended during transition per NIST SP 800-227 (draft)."

# Discovery.
FILE_EXTENSIONS = (".py", ".js", ".ts", ".java", ".go", ".cs", ".rs", ".rb", ".txt", ".toml", ".json", ".xml", ".gradle", ".mod", ".lock", ".cfg", ".ini")
#: Searches for a company's files; None stands for its name.
SEARCHES = (
    ("site:github.com/", None, ' "requirements.txt" OR "package.json" crypto OR auth OR tls'),
    ("site:github.com/", None, ' "import rsa" OR "from cryptography" OR "pycryptodome"'),
    ("site:github.com/", None, ' "node-rsa" OR "elliptic" OR "bouncycastle" OR "bouncy-castle"'),
    ("site:github.com/", None, ' "go.mod" "golang.org/x/crypto"'),
)
MAX_SAVED_FILES, MAX_FILE_KB, MIN_FILE_CHARS, MAX_RESULTS, MAX_CONTEXT_CHARS, MAX_SNIPPET = 5, 150, 20, 8, 2000, 200
KNOWN_FILES = {
    "stripe": ("stripe/stripe-python/blob/master/requirements.txt", "stripe/stripe-node/blob/master/package.json", "stripe/stripe-java/blob/master/pom.xml", "stripe/stripe-go/blob/master/go.mod", "stripe/stripe-php/blob/master/composer.json"),
    "square": ("square/okhttp/blob/master/gradle/libs.versions.toml", "square/retrofit/blob/master/pom.xml", "square/wire/blob/master/gradle/libs.versions.toml", "square/leakcanary/blob/main/gradle/libs.versions.toml"),
    "palantir": ("palantir/conjure-java/blob/develop/gradle/libs.versions.toml", "palantir/atlasdb/blob/develop/gradle/libs.versions.toml", "palantir/hadoop-crypto/blob/develop/gradle/libs.versions.toml", "palantir/crypto-client-shim/blob/develop/pom.xml"),
    "hashicorp": ("hashicorp/vault/blob/main/go.mod", "hashicorp/consul/blob/main/go.mod", "hashicorp/go-tfe/blob/main/go.mod"),
    "coinbase": ("coinbase/coinbase-python/blob/master/requirements.txt", "coinbase/coinbase-node/blob/master/package.json", "coinbase/coinbase-java/blob/master/pom.xml", "coinbase/kryptology/blob/master/go.mod"),
    "twilio": ("twilio/twilio-python/blob/main/requirements.txt", "twilio/twilio-node/blob/main/package.json", "twilio/twilio-java/blob/main/pom.xml"),
    "shopify": ("Shopify/shopify-api-node/blob/main/package.json", "Shopify/shopify_python_api/blob/master/requirements.txt", "Shopify/ruby-jose/blob/master/Gemfile"),
    "mozilla": ("mozilla/python-jose/blob/master/requirements.txt", "mozilla/PyFxA/blob/master/requirements.txt", "mozilla/hawk/blob/master/package.json"),
    "elastic": ("elastic/elasticsearch-py/blob/main/requirements-dev.txt", "elastic/elasticsearch-js/blob/main/package.json", "elastic/elasticsearch/blob/main/build.gradle"),
    "mongodb": ("mongodb/mongo-python-driver/blob/master/requirements.txt", "mongodb/node-mongodb-native/blob/main/package.json", "mongodb/mongo-java-driver/blob/master/build.gradle"),
}
KNOWN_HOST = "https://github.com/"
