"""Queries of the rule catalogue: which rules calls match, and what the calls say.

The tables hold no calls; every line item makes one of those below, which stand with what the
rules' text says of them, so that the oracles know nothing of the catalogue.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postura import estate
from postura.operators import rules
from postura.plans import sql
from postura.plans.registry import query

# language, callee, the rules that match it
CALLS = """
java Cipher.getInstance java.jca.cipher
java org.x.MessageDigest.getInstance java.jca.message-digest
java Signature.getInstance java.jca.signature
java org.x.KeyPairGenerator.getInstance java.jca.key-pair-generator
java KeyGenerator.getInstance java.jca.key-generator
java org.x.KeyAgreement.getInstance java.jca.key-agreement
java KeyFactory.getInstance java.jca.key-factory
java org.x.Mac.getInstance java.jca.mac
java SecretKeyFactory.getInstance java.jca.secret-key-factory
java org.x.KEM.getInstance java.jca.kem
java SecretKeySpec java.jca.secret-key-spec
java org.x.RSAKeyGenParameterSpec java.jca.rsa-keygen-spec
java obj.initialize java.jca.initialize
java org.x.SSLContext.getInstance java.jsse.ssl-context
java obj.setEnabledProtocols java.jsse.enabled-protocols
java org.x.obj.setEnabledCipherSuites java.jsse.enabled-cipher-suites
java RSAEngine java.bouncycastle.engine
java .SHA224Digest java.bouncycastle.digest
java KyberKEMGenerator java.bouncycastle.pqc
c EVP_rc2_a c.openssl.evp-cipher
c EVP_md5 c.openssl.evp-digest
cpp EVP_get_digestbyname c.openssl.by-name
c EVP_KEYEXCH_fetch c.openssl3.fetch
c EVP_PKEY_Q_keygen c.openssl3.pkey-from-name
cpp EVP_PKEY_CTX_new_id c.openssl.pkey-ctx-id
c EVP_PKEY_CTX_set_dsa_paramgen_bits c.openssl.pkey-keygen-bits
c EVP_PKEY_CTX_set_ec_paramgen_curve_nid c.openssl.pkey-curve
cpp RSA_generate_key c.openssl.rsa-generate
c RSA_generate_key_ex c.openssl.rsa-generate-ex
c RSA_sign c.openssl.rsa-primitive
cpp DSA_generate_parameters_ex c.openssl.dsa
c DSA_sign c.openssl.dsa-primitive
c DH_generate_parameters_ex c.openssl.dh
cpp DH_get_2048_256 c.openssl.dh-primitive
c EC_KEY_new_by_curve_name c.openssl.ec-key-curve
c ECDSA_do_verify c.openssl.ecdsa
cpp ECDH_compute_key c.openssl.ecdh
c AES_set_decrypt_key c.openssl.aes-lowlevel
c AES_wrap_encrypt c.openssl.aes-lowlevel-mode
cpp DES_ncbc_encrypt c.openssl.des-lowlevel
c DES_ede3_cbc_encrypt c.openssl.3des-lowlevel
c MD5_Final c.openssl.digest-lowlevel
cpp RC2_ecb_encrypt c.openssl.stream-lowlevel
c HMAC_Init_ex c.openssl.hmac-init
c HMAC c.openssl.hmac-oneshot
cpp PKCS5_PBKDF2_HMAC c.openssl.pbkdf2
c PKCS5_PBKDF2_HMAC_SHA1 c.openssl.pbkdf2-sha1
c DTLSv1_server_method c.openssl.ssl-method
cpp SSL_CTX_set_min_proto_version c.openssl.proto-version
c SSL_set_cipher_list c.openssl.cipher-list
c SSL_CTX_set1_curves_list c.openssl.groups
cpp crypto_box_a c.sodium.box
c crypto_sign c.sodium.sign
c crypto_aead_aes256gcm_a c.sodium.aes-gcm
cpp crypto_aead_chacha20poly1305_a c.sodium.chacha
c crypto_generichash_a c.sodium.generichash
c crypto_pwhash c.sodium.pwhash
cpp mbedtls_aes_setkey_dec c.mbedtls.aes
c mbedtls_rsa_gen_key c.mbedtls.rsa-gen
c mbedtls_ecp_group_load c.mbedtls.ecp
cpp mbedtls_md5 c.mbedtls.digest
c BCryptOpenAlgorithmProvider c.cng.provider
python hashlib.sha3_224 python.hashlib.named
python hashlib.new python.hashlib.new
python hashlib.pbkdf2_hmac python.hashlib.pbkdf2
python hmac.digest python.hmac
python rsa.generate_private_key python.cryptography.rsa-generate
python dsa.generate_private_key python.cryptography.dsa-generate
python dh.generate_parameters python.cryptography.dh-generate
python ec.derive_private_key python.cryptography.ec-generate
python ec.ECDH python.cryptography.ecdh
python .X448PrivateKey.from_private_bytes python.cryptography.ed25519
python Cipher python.cryptography.cipher
python .AESGCMSIV python.cryptography.aead
python hashes.SM3 python.cryptography.hashes
python PBKDF2HMAC python.cryptography.pbkdf2
python HKDF python.cryptography.hkdf
python MultiFernet python.cryptography.fernet
python ChaCha20_Poly1305.new python.pycryptodome.new
python .SHA3_256.new python.pycryptodome.hash
python RSA.generate python.pycryptodome.rsa
python ECC.generate python.pycryptodome.ecc
python jwt.encode python.jwt
python jwt.decode python.jwt python.jwt.algorithms
python ssl.SSLContext python.ssl.context
python obj.set_ciphers python.ssl.ciphers
go sha1.Sum384 go.hash
go aes.NewCipher go.aes
go des.NewCipher go.des
go des.NewTripleDESCipher go.3des
go rc4.NewCipher go.rc4
go cipher.NewCBCEncrypter go.cipher-mode
go rsa.GenerateKey go.rsa-generate
go rsa.VerifyPKCS1v15 go.rsa-sign
go rsa.EncryptOAEP go.rsa-encrypt
go ecdsa.GenerateKey go.ecdsa
go ecdsa.Sign go.ecdsa-sign
go ecdh.P384 go.ecdh
go ed25519.Verify go.ed25519
go mlkem.GenerateKey1024 go.mlkem
go hmac.New go.hmac
go pbkdf2.Key go.pbkdf2
typescript crypto.createHash js.node.hash
javascript createHmac js.node.hmac
javascript createCipheriv js.node.cipher
typescript crypto.generateKeyPair js.node.keypair
javascript createSign js.node.sign
javascript createECDH js.node.ecdh
typescript crypto.createDiffieHellman js.node.dh
javascript crypto.pbkdf2Sync js.node.pbkdf2
javascript crypto.hkdf js.node.hkdf
typescript crypto.scryptSync js.node.scrypt
javascript subtle.encrypt js.webcrypto.algorithm-object
javascript subtle.digest js.webcrypto.digest
typescript jsonwebtoken.sign js.jsonwebtoken
javascript jsonwebtoken.verify js.jsonwebtoken js.jsonwebtoken.algorithms
javascript CryptoJS.SHA256 js.cryptojs
typescript tls.connect js.node.tls-options js.node.tls-min-version
javascript https.createServer js.node.tls-options js.node.tls-min-version
javascript rsa.generateKeyPair js.node.keypair js.forge.rsa
rust Aes128Gcm.new rust.rustcrypto.aead
rust .Sha384.digest rust.rustcrypto.hash
rust md5.compute rust.rustcrypto.md5-compute
rust RsaPrivateKey.new rust.rustcrypto.rsa
rust MlDsa65.a rust.rustcrypto.pqc
rust .Cipher.rc4 rust.openssl.symm
rust MessageDigest.md5 rust.openssl.digest
rust Rsa.generate rust.openssl.rsa
rust hmac.Key.new rust.ring.algorithm-constant
csharp .DES.Create csharp.create
csharp TripleDESCryptoServiceProvider csharp.constructor
csharp System.Rfc2898DeriveBytes.Pbkdf2 csharp.rfc2898
csharp MLKem.GenerateKey csharp.pqc
java initialize
java kpg.initialize java.jca.initialize
java Cipher.getInstance.go
java XCipher.getInstance
python Cipher.getInstance
c hashlib.new
cpp EVP_aes_256_gcm c.openssl.evp-cipher
go EVP_aes_256_gcm
rust a.b.hmac.Key.new rust.ring.algorithm-constant
csharp AesGcm csharp.constructor
cobol md5
javascript window.crypto.subtle.sign js.webcrypto.algorithm-object
c EVP_aesx
python x.hashlib.md5
"""
EXPECTED = [(i, *line.split(" ", 2)[:2], line.split(" ")[2:]) for i, line in enumerate(CALLS.strip("\n").split("\n"))]
MATCHES = [(i, language, callee, rule) for i, language, callee, hits in EXPECTED for rule in hits]


def drawn(spark, d, rows: list[tuple], schema: str):
    """A row of the given ones, as many as there are numbers, for each line item; the oracle does the same by the number."""
    table = spark.createDataFrame(rows, schema)  # some hundred rows
    items = estate.read(spark, d, "lineitem").select(F.expr(f"(l_partkey + l_suppkey + l_linenumber) % {len(rows)}").cast("int").alias("i"))
    return items.join(F.broadcast(table), "i")


def drawn_sql(rows: list[tuple], columns: str, n: int) -> str:
    return f"WITH li AS (SELECT CAST((l_partkey + l_suppkey + l_linenumber) % {n} AS INT) AS i FROM lineitem), e({columns}) AS (VALUES {sql.values(rows)})"


@query(drawn_sql(MATCHES, "i, language, callee, rule_id", len(EXPECTED)) + " SELECT language, callee, rule_id, count(*) AS uses FROM li JOIN e USING (i) GROUP BY ALL")
def rule_match(spark, d):
    """Calls by the rules of the whole catalogue that match them."""
    calls = drawn(spark, d, [x[:3] for x in EXPECTED], "i int, language string, callee string")
    return rules.matched(calls).groupBy("language", "callee", "rule_id").agg(F.count("*").alias("uses"))


# language, callee, arguments, keywords, an object's properties at an argument; then what is found: rule, algorithm, bits, set, curve, mode, padding, digest, version, list
FORMS = [
    ("java", "Cipher.getInstance", ["AES"], {}, {}, ("java.jca.cipher", "aes", None, None, None, "ecb", "pkcs5", None, None, None)),
    ("java", "Cipher.getInstance", ['"AES/GCM/NoPadding"'], {}, {}, ("java.jca.cipher", "aes", None, None, None, "gcm", "none", None, None, None)),
    ("java", "Cipher.getInstance", ["RSA/ECB/OAEPWithSHA-256AndMGF1Padding"], {}, {}, ("java.jca.cipher", "rsa", None, None, None, None, "oaep", "sha-256", None, None)),
    ("java", "Signature.getInstance", ["SHA384withECDSA"], {}, {}, ("java.jca.signature", "ecdsa", None, None, None, None, None, "sha-384", None, None)),
    ("java", "kpg.initialize", ["3072"], {}, {}, ("java.jca.initialize", None, 3072, None, None, None, None, None, None, None)),
    ("java", "kpg.initialize", ["secp384r1"], {}, {}, ("java.jca.initialize", None, None, None, "P-384", None, None, None, None, None)),
    ("java", "SSLContext.getInstance", ["TLSv1.2"], {}, {}, ("java.jsse.ssl-context", None, None, None, None, None, None, None, "1.2", None)),
    ("c", "EVP_aes_256_gcm", [], {}, {}, ("c.openssl.evp-cipher", "aes", 256, None, None, "gcm", None, None, None, None)),
    ("cpp", "EVP_sha512", [], {}, {}, ("c.openssl.evp-digest", "sha-512", None, None, None, None, None, None, None, None)),
    ("c", "RSA_generate_key_ex", ["rsa", "0x800", "e", "0"], {}, {}, ("c.openssl.rsa-generate-ex", "rsa", 2048, None, None, None, None, None, None, None)),
    ("c", "EC_KEY_new_by_curve_name", ["NID_X9_62_prime256v1"], {}, {}, ("c.openssl.ec-key-curve", "ecdsa", None, None, "P-256", None, None, None, None, None)),
    ("c", "PKCS5_PBKDF2_HMAC_SHA1", ["p"], {}, {}, ("c.openssl.pbkdf2-sha1", "pbkdf2", None, None, None, None, None, "sha-1", None, None)),
    ("c", "PKCS5_PBKDF2_HMAC", ["p", "n", "s", "m", "i", "EVP_sha256"], {}, {}, ("c.openssl.pbkdf2", "pbkdf2", None, None, None, None, None, "sha-256", None, None)),
    ("c", "SSL_CTX_set_cipher_list", ["ctx", '"HIGH:!aNULL"'], {}, {}, ("c.openssl.cipher-list", None, None, None, None, None, None, None, None, "HIGH:!aNULL")),
    ("c", "crypto_aead_aes256gcm_encrypt", [], {}, {}, ("c.sodium.aes-gcm", "aes", 256, None, None, "gcm", None, None, None, None)),
    ("c", "BCryptOpenAlgorithmProvider", ["h", "BCRYPT_SHA256_ALGORITHM"], {}, {}, ("c.cng.provider", "sha-256", None, None, None, None, None, None, None, None)),
    ("python", "hashlib.new", ["'md5'"], {}, {}, ("python.hashlib.new", "md5", None, None, None, None, None, None, None, None)),
    ("python", "rsa.generate_private_key", ["65537"], {"key_size": "1024"}, {}, ("python.cryptography.rsa-generate", "rsa", 1024, None, None, None, None, None, None, None)),
    ("python", "rsa.generate_private_key", ["65537", "4096"], {}, {}, ("python.cryptography.rsa-generate", "rsa", 4096, None, None, None, None, None, None, None)),
    ("python", "PBKDF2HMAC", [], {"algorithm": "hashes.SHA512"}, {}, ("python.cryptography.pbkdf2", "pbkdf2", None, None, None, None, None, "sha-512", None, None)),
    ("python", "jwt.encode", ["p", "k"], {"algorithm": "RS256"}, {}, ("python.jwt", "rsa", None, None, None, None, "pkcs1v15", "sha-256", None, None)),
    ("python", "AES.new", ["key", "AES.MODE_CBC"], {}, {}, ("python.pycryptodome.new", "aes", None, None, None, "cbc", None, None, None, None)),
    ("go", "ecdsa.GenerateKey", ["elliptic.P256"], {}, {}, ("go.ecdsa", "ecdsa", None, None, "P-256", None, None, None, None, None)),
    ("go", "mlkem.GenerateKey768", [], {}, {}, ("go.mlkem", "ml-kem", None, "768", None, None, None, None, None, None)),
    ("go", "cipher.NewCBCDecrypter", ["b", "iv"], {}, {}, ("go.cipher-mode", None, None, None, None, "cbc", None, None, None, None)),
    ("go", "ecdh.X25519", [], {}, {}, ("go.ecdh", "x25519", None, None, None, None, None, None, None, None)),
    ("typescript", "crypto.generateKeyPairSync", ["rsa"], {}, {1: {"modulusLength": "2048"}}, ("js.node.keypair", "rsa", 2048, None, None, None, None, None, None, None)),
    ("javascript", "subtle.generateKey", [], {}, {0: {"name": "ECDSA", "namedCurve": "P-384"}}, ("js.webcrypto.algorithm-object", "ecdsa", None, None, "P-384", None, None, None, None, None)),
    ("javascript", "crypto.createCipheriv", ["aes-128-cbc", "k", "iv"], {}, {}, ("js.node.cipher", "aes", 128, None, None, "cbc", None, None, None, None)),
    ("rust", "Aes256Gcm.new", ["k"], {}, {}, ("rust.rustcrypto.aead", "aes", 256, None, None, "gcm", None, None, None, None)),
    ("csharp", "RSA.Create", ["2048"], {}, {}, ("csharp.create", "rsa", 2048, None, None, None, None, None, None, None)),
    ("csharp", "Rfc2898DeriveBytes", ["p", "s"], {}, {}, ("csharp.rfc2898", "pbkdf2", None, None, None, None, None, "sha-1", None, None)),
    ("csharp", "Rfc2898DeriveBytes", ["p", "s", "i", "HashAlgorithmName.SHA256"], {}, {}, ("csharp.rfc2898", "pbkdf2", None, None, None, None, None, "sha-256", None, None)),
    ("go", "util.helper", ["aes"], {}, {}, None),
]
FIELDS = ["alg_id", "key_bits", "parameter_set", "curve", "mode", "padding", "digest", "version", "list"]
SAID = [(i, f[1], *f[5]) for i, f in enumerate(FORMS) if f[5]]


@query(drawn_sql(SAID, "i, callee, rule_id, " + ", ".join(FIELDS), len(FORMS)) + f" SELECT callee, rule_id, {', '.join(FIELDS)}, count(*) AS uses FROM li JOIN e USING (i) GROUP BY ALL")
def rule_findings(spark, d):
    """Algorithms and parameters that calls name by their arguments, keywords, properties or their own names."""
    rows = [(i, *f[:4], [f[4].get(k) for k in range(max(f[4], default=-1) + 1)]) for i, f in enumerate(FORMS)]
    calls = drawn(spark, d, rows, "i int, language string, callee string, args array<string>, keywords map<string,string>, properties array<map<string,string>>").groupBy("i", "language", "callee", "args").agg(F.count("*").alias("uses"), F.first("keywords").alias("keywords"), F.first("properties").alias("properties"))
    found = rules.found(rules.matched(calls), "i")
    return calls.select("i", "callee", "uses").join(found, "i").select("callee", "rule_id", *FIELDS, "uses")
