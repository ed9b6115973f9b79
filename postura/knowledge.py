"""Facts that the analysis rests on: algorithms, curves, data classes and the scoring policy.

Tables of at most a few dozen rows; they reach the executors as broadcast joins or literals.
"""

from __future__ import annotations

# Id, name, primitive, quantum class, classical status, how strength follows,
# fixed strength, output bits, least key bits, key sizes, weak modes, curve, parameter sets
# (name:category:strength), replacements by role.
ALGORITHMS = [
    ('rsa', 'RSA', 'pke', 'shor', 'acceptable', 'integer-factoring', None, None, 2048, '1024,2048,3072,4096,7680,8192,15360', '', '', '', 'signature=ml-dsa-65,encryption=x25519-mlkem768'),
    ('dh', 'DH', 'key-agree', 'shor', 'acceptable', 'integer-factoring', None, None, 2048, '1024,2048,3072,4096,6144,8192', '', '', '', 'key-agreement=x25519-mlkem768'),
    ('dsa', 'DSA', 'signature', 'shor', 'legacy', 'integer-factoring', None, None, 2048, '1024,2048,3072', '', '', '', 'signature=ml-dsa-65'),
    ('ecdsa', 'ECDSA', 'signature', 'shor', 'acceptable', 'curve', None, None, None, '', '', '', '', 'signature=ml-dsa-65'),
    ('ecdh', 'ECDH', 'key-agree', 'shor', 'acceptable', 'curve', None, None, None, '', '', '', '', 'key-agreement=x25519-mlkem768'),
    ('x25519', 'X25519', 'key-agree', 'shor', 'acceptable', 'fixed', 128, None, None, '', '', 'curve25519', '', 'key-agreement=x25519-mlkem768'),
    ('x448', 'X448', 'key-agree', 'shor', 'acceptable', 'fixed', 224, None, None, '', '', 'curve448', '', 'key-agreement=x25519-mlkem768'),
    ('ed25519', 'Ed25519', 'signature', 'shor', 'acceptable', 'fixed', 128, None, None, '', '', 'curve25519', '', 'signature=ml-dsa-65'),
    ('ed448', 'Ed448', 'signature', 'shor', 'acceptable', 'fixed', 224, None, None, '', '', 'curve448', '', 'signature=ml-dsa-87'),
    ('elgamal', 'ElGamal', 'pke', 'shor', 'legacy', 'integer-factoring', None, None, 2048, '', '', '', '', 'encryption=x25519-mlkem768'),
    ('sm2', 'SM2', 'signature', 'shor', 'acceptable', 'fixed', 128, None, None, '', '', '', '', 'signature=ml-dsa-65'),
    ('ml-kem', 'ML-KEM', 'kem', 'post-quantum', 'acceptable', 'parameter-set', None, None, None, '', '', '', '512:1:128 768:3:192 1024:5:256', ''),
    ('ml-dsa', 'ML-DSA', 'signature', 'post-quantum', 'acceptable', 'parameter-set', None, None, None, '', '', '', '44:2:128 65:3:192 87:5:256', ''),
    ('slh-dsa', 'SLH-DSA', 'signature', 'post-quantum', 'acceptable', 'parameter-set', None, None, None, '', '', '', 'sha2-128s:1:128 sha2-128f:1:128 sha2-192s:3:192 sha2-192f:3:192 sha2-256s:5:256 sha2-256f:5:256 shake-128s:1:128 shake-256s:5:256', ''),
    ('fn-dsa', 'FN-DSA', 'signature', 'post-quantum', 'acceptable', 'parameter-set', None, None, None, '', '', '', '512:1:128 1024:5:256', ''),
    ('hqc', 'HQC', 'kem', 'post-quantum', 'acceptable', 'parameter-set', None, None, None, '', '', '', '128:1:128 192:3:192 256:5:256', ''),
    ('lms', 'LMS', 'signature', 'post-quantum', 'acceptable', 'fixed', 128, None, None, '', '', '', '', ''),
    ('xmss', 'XMSS', 'signature', 'post-quantum', 'acceptable', 'fixed', 128, None, None, '', '', '', '', ''),
    ('frodokem', 'FrodoKEM', 'kem', 'post-quantum', 'acceptable', 'fixed', 192, None, None, '', '', '', '', ''),
    ('classic-mceliece', 'Classic McEliece', 'kem', 'post-quantum', 'acceptable', 'fixed', 256, None, None, '', '', '', '', ''),
    ('x25519-mlkem768', 'X25519MLKEM768', 'combiner', 'post-quantum', 'acceptable', 'fixed', 192, None, None, '', '', '', '', ''),
    ('secp256r1-mlkem768', 'SecP256r1MLKEM768', 'combiner', 'post-quantum', 'acceptable', 'fixed', 192, None, None, '', '', '', '', ''),
    ('secp384r1-mlkem1024', 'SecP384r1MLKEM1024', 'combiner', 'post-quantum', 'acceptable', 'fixed', 256, None, None, '', '', '', '', ''),
    ('sntrup761-x25519', 'sntrup761x25519', 'combiner', 'post-quantum', 'acceptable', 'fixed', 128, None, None, '', '', '', '', ''),
    ('aes', 'AES', 'block-cipher', 'grover', 'acceptable', 'key-bits', None, None, None, '128,192,256', 'ecb', '', '', 'encryption=aes-256-gcm'),
    ('chacha20', 'ChaCha20', 'stream-cipher', 'grover', 'acceptable', 'fixed', 256, None, None, '256', '', '', '', ''),
    ('chacha20-poly1305', 'ChaCha20-Poly1305', 'ae', 'grover', 'acceptable', 'fixed', 256, None, None, '256', '', '', '', ''),
    ('3des', '3DES', 'block-cipher', 'grover', 'disallowed', 'fixed', 112, None, None, '168', '', '', '', 'encryption=aes-256-gcm'),
    ('des', 'DES', 'block-cipher', 'grover', 'broken', 'fixed', 56, None, None, '56', '', '', '', 'encryption=aes-256-gcm'),
    ('rc4', 'RC4', 'stream-cipher', 'grover', 'broken', 'key-bits', None, None, None, '', '', '', '', 'encryption=aes-256-gcm'),
    ('rc2', 'RC2', 'block-cipher', 'grover', 'broken', 'key-bits', None, None, None, '', '', '', '', 'encryption=aes-256-gcm'),
    ('blowfish', 'Blowfish', 'block-cipher', 'grover', 'legacy', 'key-bits', None, None, None, '', '', '', '', 'encryption=aes-256-gcm'),
    ('idea', 'IDEA', 'block-cipher', 'grover', 'legacy', 'fixed', 128, None, None, '', '', '', '', 'encryption=aes-256-gcm'),
    ('cast5', 'CAST5', 'block-cipher', 'grover', 'legacy', 'key-bits', None, None, None, '', '', '', '', 'encryption=aes-256-gcm'),
    ('camellia', 'Camellia', 'block-cipher', 'grover', 'acceptable', 'key-bits', None, None, None, '128,192,256', '', '', '', ''),
    ('aria', 'ARIA', 'block-cipher', 'grover', 'acceptable', 'key-bits', None, None, None, '128,192,256', '', '', '', ''),
    ('sm4', 'SM4', 'block-cipher', 'grover', 'acceptable', 'fixed', 128, None, None, '128', '', '', '', ''),
    ('twofish', 'Twofish', 'block-cipher', 'grover', 'acceptable', 'key-bits', None, None, None, '128,192,256', '', '', '', ''),
    ('seed', 'SEED', 'block-cipher', 'grover', 'legacy', 'fixed', 128, None, None, '', '', '', '', ''),
    ('md5', 'MD5', 'hash', 'grover', 'broken', 'fixed', 18, 128, None, '', '', '', '', 'digest=sha-384'),
    ('md4', 'MD4', 'hash', 'grover', 'broken', 'fixed', 2, 128, None, '', '', '', '', 'digest=sha-384'),
    ('sha-1', 'SHA-1', 'hash', 'grover', 'broken', 'fixed', 63, 160, None, '', '', '', '', 'digest=sha-384'),
    ('sha-224', 'SHA-224', 'hash', 'grover', 'acceptable', 'hash-output', None, 224, None, '', '', '', '', 'digest=sha-384'),
    ('sha-256', 'SHA-256', 'hash', 'grover', 'acceptable', 'hash-output', None, 256, None, '', '', '', '', ''),
    ('sha-384', 'SHA-384', 'hash', 'grover', 'acceptable', 'hash-output', None, 384, None, '', '', '', '', ''),
    ('sha-512', 'SHA-512', 'hash', 'grover', 'acceptable', 'hash-output', None, 512, None, '', '', '', '', ''),
    ('sha-512-256', 'SHA-512/256', 'hash', 'grover', 'acceptable', 'hash-output', None, 256, None, '', '', '', '', ''),
    ('sha3-256', 'SHA3-256', 'hash', 'grover', 'acceptable', 'hash-output', None, 256, None, '', '', '', '', ''),
    ('sha3-384', 'SHA3-384', 'hash', 'grover', 'acceptable', 'hash-output', None, 384, None, '', '', '', '', ''),
    ('sha3-512', 'SHA3-512', 'hash', 'grover', 'acceptable', 'hash-output', None, 512, None, '', '', '', '', ''),
    ('shake128', 'SHAKE128', 'xof', 'grover', 'acceptable', 'fixed', 128, None, None, '', '', '', '', ''),
    ('shake256', 'SHAKE256', 'xof', 'grover', 'acceptable', 'fixed', 256, None, None, '', '', '', '', ''),
    ('blake2b', 'BLAKE2b', 'hash', 'grover', 'acceptable', 'hash-output', None, 512, None, '', '', '', '', ''),
    ('blake2s', 'BLAKE2s', 'hash', 'grover', 'acceptable', 'hash-output', None, 256, None, '', '', '', '', ''),
    ('blake3', 'BLAKE3', 'hash', 'grover', 'acceptable', 'hash-output', None, 256, None, '', '', '', '', ''),
    ('sm3', 'SM3', 'hash', 'grover', 'acceptable', 'hash-output', None, 256, None, '', '', '', '', ''),
    ('ripemd160', 'RIPEMD-160', 'hash', 'grover', 'legacy', 'hash-output', None, 160, None, '', '', '', '', 'digest=sha-384'),
    ('hmac', 'HMAC', 'mac', 'grover', 'acceptable', 'digest', None, None, None, '', '', '', '', ''),
    ('cmac', 'CMAC', 'mac', 'grover', 'acceptable', 'key-bits', None, None, None, '', '', '', '', ''),
    ('gmac', 'GMAC', 'mac', 'grover', 'acceptable', 'key-bits', None, None, None, '', '', '', '', ''),
    ('poly1305', 'Poly1305', 'mac', 'grover', 'acceptable', 'fixed', 128, None, None, '', '', '', '', ''),
    ('kmac', 'KMAC', 'mac', 'grover', 'acceptable', 'fixed', 256, None, None, '', '', '', '', ''),
    ('pbkdf2', 'PBKDF2', 'kdf', 'grover', 'acceptable', 'digest', None, None, None, '', '', '', '', ''),
    ('hkdf', 'HKDF', 'kdf', 'grover', 'acceptable', 'digest', None, None, None, '', '', '', '', ''),
    ('scrypt', 'scrypt', 'kdf', 'grover', 'acceptable', 'fixed', 128, None, None, '', '', '', '', ''),
    ('argon2', 'Argon2', 'kdf', 'grover', 'acceptable', 'fixed', 128, None, None, '', '', '', '', ''),
    ('bcrypt', 'bcrypt', 'kdf', 'grover', 'acceptable', 'fixed', 128, None, None, '', '', '', '', ''),
    ('ctr-drbg', 'CTR_DRBG', 'drbg', 'grover', 'acceptable', 'key-bits', None, None, None, '', '', '', '', ''),
    ('hash-drbg', 'Hash_DRBG', 'drbg', 'grover', 'acceptable', 'digest', None, None, None, '', '', '', '', ''),
    ('dual-ec-drbg', 'Dual_EC_DRBG', 'drbg', 'shor', 'broken', 'fixed', 0, None, None, '', '', '', '', ''),
]

# Spellings of each algorithm; id and name are spellings too.
ALIASES = {
    'rsa': 'rsa, rsaencryption, rsassa, rsaes, rsa-oaep, rsassa-pss, rsa-pss, rsassa-pkcs1-v1_5, rsaes-pkcs1-v1_5',
    'dh': 'dh, dhe, edh, diffie-hellman, ffdhe, ffdhe2048, ffdhe3072, ffdhe4096, ffdhe6144, ffdhe8192, dhkeyagreement',
    'dsa': 'dsa, dss',
    'ecdsa': 'ecdsa, ec, ecpublickey, id-ecpublickey, ecdsa-sha2',
    'ecdh': 'ecdh, ecdhe, ecdh-es, ecmqv',
    'x25519': 'x25519, curve25519, curve25519-sha256, curve25519-sha256@libssh.org',
    'x448': 'x448, curve448',
    'ed25519': 'ed25519, eddsa, ssh-ed25519, pureeddsa',
    'ed448': 'ed448, ssh-ed448',
    'elgamal': 'elgamal',
    'sm2': 'sm2',
    'ml-kem': 'ml-kem, mlkem, kyber, crystals-kyber',
    'ml-dsa': 'ml-dsa, mldsa, dilithium, crystals-dilithium',
    'slh-dsa': 'slh-dsa, slhdsa, sphincs+, sphincsplus, sphincs',
    'fn-dsa': 'fn-dsa, fndsa, falcon',
    'hqc': 'hqc',
    'lms': 'lms, hss, hss-lms',
    'xmss': 'xmss, xmssmt, xmss^mt',
    'frodokem': 'frodokem, frodo, frodokem-976, frodokem-640, frodokem-1344',
    'classic-mceliece': 'classic-mceliece, mceliece, mceliece348864, mceliece6960119',
    'x25519-mlkem768': 'x25519mlkem768, x25519-mlkem768, x25519_mlkem768, x25519kyber768, x25519kyber768draft00, mlkem768x25519, mlkem768x25519-sha256',
    'secp256r1-mlkem768': 'secp256r1mlkem768, secp256r1-mlkem768, p256mlkem768, p256_mlkem768',
    'secp384r1-mlkem1024': 'secp384r1mlkem1024, secp384r1-mlkem1024, p384mlkem1024, p384_mlkem1024',
    'sntrup761-x25519': 'sntrup761x25519, sntrup761x25519-sha512, sntrup761x25519-sha512@openssh.com',
    'aes': 'aes, rijndael',
    'chacha20': 'chacha20, chacha',
    'chacha20-poly1305': 'chacha20-poly1305, chacha20poly1305, chacha20_poly1305, chacha20-poly1305@openssh.com, xchacha20-poly1305, xchacha20poly1305',
    '3des': '3des, tdea, tripledes, desede, des-ede3, des-ede, des3, 3des-cbc, des_ede3',
    'des': 'des, des-cbc, des-ecb',
    'rc4': 'rc4, arcfour, arc4, arcfour128, arcfour256',
    'rc2': 'rc2',
    'blowfish': 'blowfish, bf, bf-cbc',
    'idea': 'idea',
    'cast5': 'cast5, cast, cast128, cast-128',
    'camellia': 'camellia',
    'aria': 'aria',
    'sm4': 'sm4',
    'twofish': 'twofish',
    'seed': 'seed',
    'md5': 'md5',
    'md4': 'md4',
    'sha-1': 'sha-1, sha1, sha',
    'sha-224': 'sha-224, sha224',
    'sha-256': 'sha-256, sha256, sha2, sha-2',
    'sha-384': 'sha-384, sha384',
    'sha-512': 'sha-512, sha512',
    'sha-512-256': 'sha-512/256, sha512/256, sha-512-256, sha512_256',
    'sha3-256': 'sha3-256, sha3_256, sha3256',
    'sha3-384': 'sha3-384, sha3_384',
    'sha3-512': 'sha3-512, sha3_512',
    'shake128': 'shake128, shake-128',
    'shake256': 'shake256, shake-256',
    'blake2b': 'blake2b, blake2b512, blake2b-512',
    'blake2s': 'blake2s, blake2s256, blake2s-256',
    'blake3': 'blake3',
    'sm3': 'sm3',
    'ripemd160': 'ripemd160, ripemd-160, rmd160',
    'hmac': 'hmac',
    'cmac': 'cmac, aes-cmac, aescmac',
    'gmac': 'gmac, aes-gmac',
    'poly1305': 'poly1305',
    'kmac': 'kmac, kmac128, kmac256',
    'pbkdf2': 'pbkdf2, pbkdf2withhmacsha1, pbkdf2withhmacsha256, pbkdf2withhmacsha512',
    'hkdf': 'hkdf',
    'scrypt': 'scrypt',
    'argon2': 'argon2, argon2id, argon2i, argon2d',
    'bcrypt': 'bcrypt',
    'ctr-drbg': 'ctr-drbg, ctr_drbg, ctrdrbg',
    'hash-drbg': 'hash-drbg, hash_drbg, hashdrbg, hmac-drbg, hmac_drbg, hmacdrbg',
    'dual-ec-drbg': 'dual-ec-drbg, dual_ec_drbg, dualecdrbg',
}

# Curve, strength, classical status, spellings.
CURVES = [
    ('P-192', 96, 'disallowed', 'p-192, p192, secp192r1, prime192v1, nistp192'),
    ('P-224', 112, 'acceptable', 'p-224, p224, secp224r1, nistp224'),
    ('P-256', 128, 'acceptable', 'p-256, p256, secp256r1, prime256v1, nistp256, ecdsa-sha2-nistp256, ecdh-sha2-nistp256'),
    ('P-384', 192, 'acceptable', 'p-384, p384, secp384r1, nistp384, ecdsa-sha2-nistp384, ecdh-sha2-nistp384'),
    ('P-521', 256, 'acceptable', 'p-521, p521, secp521r1, nistp521, ecdsa-sha2-nistp521, ecdh-sha2-nistp521'),
    ('secp256k1', 128, 'acceptable', 'secp256k1, k-256, k256, p256k1, secg-p256k1'),
    ('brainpoolP256r1', 128, 'acceptable', 'brainpoolp256r1, brainpool256r1, bp256'),
    ('brainpoolP384r1', 192, 'acceptable', 'brainpoolp384r1, brainpool384r1, bp384'),
    ('brainpoolP512r1', 256, 'acceptable', 'brainpoolp512r1, brainpool512r1, bp512'),
    ('curve25519', 128, 'acceptable', 'curve25519, 25519'),
    ('curve448', 224, 'acceptable', 'curve448, 448, goldilocks'),
    ('SM2', 128, 'acceptable', 'sm2, sm2p256v1'),
]

# Order, class, years of secrecy, criticality, terms.
DATA_CLASSES = [
    (0, 'classified', 50.0, 'critical', 'classified topsecret confidential defence defense military intel intelligence sigint cabinet diplomatic nuclear'),
    (1, 'identity', 25.0, 'critical', 'aadhaar aadhar uid passport biometric fingerprint iris kyc ssn voter epic pan_card dob birthdate nationalid citizen'),
    (2, 'health', 20.0, 'critical', 'health patient medical diagnosis clinical prescription ehr emr abha hospital treatment genome dna'),
    (3, 'financial', 10.0, 'critical', 'card pan cvv cvc iban ifsc account payment payments pay upi vpa transaction txn salary invoice bank wallet ledger loan credit debit tax gst'),
    (4, 'credential', 5.0, 'high', 'password passwd pwd credential credentials secret_key apikey token jwt otp pin privatekey private auth login session cookie oauth saml'),
    (5, 'personal', 10.0, 'high', 'email phone mobile address customer user profile name contact location gps'),
    (6, 'public', 0.0, 'low', 'public checksum etag cache fixture example sample demo test mock'),
]

# Library, first version that is ready for post-quantum algorithms ('any', 'never', 'unknown').
LIBRARIES = [
    ("OpenSSL", "3.5.0"),
    ("BoringSSL", "any"),
    ("LibreSSL", "4.1.0"),
    ("wolfSSL", "5.6.0"),
    ("Mbed TLS", "never"),
    ("GnuTLS", "3.8.9"),
    ("libsodium", "never"),
    ("liboqs", "0.10.0"),
    ("Windows CNG", "unknown"),
]

ALGORITHM_SCHEMA = (
    "alg_ord int, alg_id string, alg_name string, alg_primitive string, quantum string, classical string, security string, fixed_strength int, "
    "output_bits int, min_key_bits int, key_sizes string, weak_modes string, alg_curve string, sets string, replacements string"
)


def algorithm_rows() -> list[tuple]:
    return [(i, *r) for i, r in enumerate(ALGORITHMS)]
