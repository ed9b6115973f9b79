"""The rule catalogue: which calls use cryptography, and where a call says which.

Rules are data. The built-in ones stand below as text, an organisation's own come as TOML; both
are checked as a whole. For matching they become a keyed table and a list of expressions (see
operators.rules), so that a call meets only rules for the last part of its name.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from postura.knowledge import ALGORITHMS

KINDS = ("algorithm", "refine", "assign", "cipher-list", "group-list", "protocol-version")
GRAMMARS = ("name", "jca-cipher", "group", "curve", "mode", "digest", "int", "padding", "version", "list")
PARAMETERS = ("key-bits", "parameter-set", "curve", "mode", "padding", "digest")
PLACES = ("arg", "keyword", "property", "capture", "value")
LANGUAGES = {"java": "java", "c": "c", "python": "python", "go": "go", "js": "javascript", "rust": "rust", "csharp": "csharp"}
#: Languages that another one's rules hold for as well.
FAMILIES = {"cpp": ("c",), "typescript": ("javascript",)}
ROLES = {"function": ("keygen", "digest", "tag"), "primitive": ("signature", "pke", "key-agree"), "kind": KINDS}

# A rule a line. Its id, which begins with its language; its API style, kind,
# function and primitive; the calls, by the end of their dotted names, any receiver as *, a
# property that is assigned as .Name=, or a regular expression between slashes; its algorithm,
# fixed (=) or read from somewhere by a grammar, less prefixes and without suffixes; parameters.
TABLE = r"""
java.jca.cipher ¦ provider ¦ Cipher.getInstance ¦ arg 0 as jca-cipher
java.jca.message-digest ¦ provider digest ¦ MessageDigest.getInstance ¦ arg 0 as name
java.jca.signature ¦ provider signature ¦ Signature.getInstance ¦ arg 0 as name
java.jca.key-pair-generator ¦ provider keygen ¦ KeyPairGenerator.getInstance ¦ arg 0 as name
java.jca.key-generator ¦ provider keygen ¦ KeyGenerator.getInstance ¦ arg 0 as name
java.jca.key-agreement ¦ provider key-agree ¦ KeyAgreement.getInstance ¦ arg 0 as name
java.jca.key-factory ¦ provider ¦ KeyFactory.getInstance ¦ arg 0 as name
java.jca.mac ¦ provider tag ¦ Mac.getInstance ¦ arg 0 as name
java.jca.secret-key-factory ¦ provider ¦ SecretKeyFactory.getInstance ¦ arg 0 as name
java.jca.kem ¦ provider ¦ KEM.getInstance ¦ arg 0 as name
java.jca.secret-key-spec ¦ provider ¦ SecretKeySpec ¦ arg 1 as name
java.jca.rsa-keygen-spec ¦ provider ¦ RSAKeyGenParameterSpec ¦ =rsa ¦ key-bits arg 0 as int
java.jca.initialize ¦ provider refine ¦ *.initialize *.init ¦  ¦ key-bits arg 0 as int; curve arg 0 as curve
java.jsse.ssl-context ¦ protocol protocol-version ¦ SSLContext.getInstance ¦ arg 0 as version
java.jsse.enabled-protocols ¦ protocol protocol-version ¦ *.setEnabledProtocols ¦ arg 0 as version
java.jsse.enabled-cipher-suites ¦ protocol cipher-list ¦ *.setEnabledCipherSuites ¦ arg 0 as list
java.bouncycastle.engine ¦ primitive ¦ /(?:^|\.)(?P<name>AES|DES|DESede|Blowfish|RC4|RC2|Twofish|Camellia|ARIA|SM4|Serpent|CAST5|IDEA|SEED|ChaCha|ChaCha7539|RSA|ElGamal)(?:Fast)?Engine$/ ¦ capture name as name
java.bouncycastle.digest ¦ primitive digest ¦ /(?:^|\.)(?P<name>MD5|MD4|SHA1|SHA224|SHA256|SHA384|SHA512|SHA3|SM3|RIPEMD160|Blake2b|Blake2s|Blake3|Keccak)Digest$/ ¦ capture name as name
java.bouncycastle.pqc ¦ primitive ¦ /(?:^|\.)(?P<name>MLKEM|MLDSA|SLHDSA|Falcon|Kyber|Dilithium|SPHINCSPlus)(?:KeyPairGenerator|Signer|KEMGenerator|KEMExtractor)$/ ¦ capture name as name
c.openssl.evp-cipher ¦ provider ¦ /^EVP_(?P<name>(?:aes|aria|camellia|sm4|des|bf|cast5|rc2|rc4|idea|seed|chacha20)(?:_[a-z0-9]+)*)$/ ¦ capture name as name
c.openssl.evp-digest ¦ provider digest ¦ /^EVP_(?P<name>md4|md5|sha1|sha224|sha256|sha384|sha512|sha512_224|sha512_256|sha3_224|sha3_256|sha3_384|sha3_512|shake128|shake256|sm3|ripemd160|blake2b512|blake2s256)$/ ¦ capture name as name
c.openssl.by-name ¦ provider ¦ EVP_get_cipherbyname EVP_get_digestbyname ¦ arg 0 as name
c.openssl3.fetch ¦ provider ¦ EVP_CIPHER_fetch EVP_MD_fetch EVP_MAC_fetch EVP_KDF_fetch EVP_SIGNATURE_fetch EVP_KEM_fetch EVP_KEYEXCH_fetch EVP_ASYM_CIPHER_fetch ¦ arg 1 as name
c.openssl3.pkey-from-name ¦ provider keygen ¦ EVP_PKEY_CTX_new_from_name EVP_PKEY_Q_keygen ¦ arg 2 as name ¦ key-bits arg 3 as int; curve arg 3 as curve
c.openssl.pkey-ctx-id ¦ provider ¦ EVP_PKEY_CTX_new_id ¦ arg 0 as name less EVP_PKEY_
c.openssl.pkey-keygen-bits ¦ provider refine ¦ EVP_PKEY_CTX_set_rsa_keygen_bits EVP_PKEY_CTX_set_dsa_paramgen_bits EVP_PKEY_CTX_set_dh_paramgen_prime_len ¦  ¦ key-bits arg 1 as int
c.openssl.pkey-curve ¦ provider refine ¦ EVP_PKEY_CTX_set_ec_paramgen_curve_nid ¦  ¦ curve arg 1 as curve less NID_X9_62_|NID_
c.openssl.rsa-generate ¦ primitive keygen ¦ RSA_generate_key ¦ =rsa ¦ key-bits arg 0 as int
c.openssl.rsa-generate-ex ¦ primitive keygen ¦ RSA_generate_key_ex RSA_generate_multi_prime_key ¦ =rsa ¦ key-bits arg 1 as int
c.openssl.rsa-primitive ¦ primitive ¦ RSA_new RSA_public_encrypt RSA_private_decrypt RSA_private_encrypt RSA_public_decrypt RSA_sign RSA_verify RSA_padding_add_PKCS1_type_2 ¦ =rsa
c.openssl.dsa ¦ primitive ¦ DSA_generate_parameters_ex ¦ =dsa ¦ key-bits arg 1 as int
c.openssl.dsa-primitive ¦ primitive ¦ DSA_new DSA_sign DSA_verify DSA_do_sign DSA_do_verify ¦ =dsa
c.openssl.dh ¦ primitive ¦ DH_generate_parameters_ex ¦ =dh ¦ key-bits arg 1 as int
c.openssl.dh-primitive ¦ primitive ¦ DH_new DH_generate_key DH_compute_key DH_get_2048_256 DH_get_1024_160 ¦ =dh
c.openssl.ec-key-curve ¦ primitive ¦ EC_KEY_new_by_curve_name EC_GROUP_new_by_curve_name ¦ =ecdsa ¦ curve arg 0 as curve less NID_X9_62_|NID_
c.openssl.ecdsa ¦ primitive signature ¦ ECDSA_sign ECDSA_verify ECDSA_do_sign ECDSA_do_verify ¦ =ecdsa
c.openssl.ecdh ¦ primitive ¦ ECDH_compute_key ¦ =ecdh
c.openssl.aes-lowlevel ¦ primitive ¦ AES_set_encrypt_key AES_set_decrypt_key ¦ =aes ¦ key-bits arg 1 as int
c.openssl.aes-lowlevel-mode ¦ primitive ¦ /^AES_(?P<mode>ecb|cbc|cfb128|cfb8|cfb1|ofb128|ctr128|ige|wrap|unwrap)_(?:encrypt|key)$/ ¦ =aes ¦ mode capture mode as mode
c.openssl.des-lowlevel ¦ primitive ¦ /^DES_(?:set_key|set_key_checked|set_key_unchecked|ecb_encrypt|ncbc_encrypt|cbc_encrypt|key_sched)$/ ¦ =des
c.openssl.3des-lowlevel ¦ primitive ¦ /^DES_ede3_(?:cbc_encrypt|ecb_encrypt|cfb64_encrypt|ofb64_encrypt)$/ ¦ =3des
c.openssl.digest-lowlevel ¦ primitive digest ¦ /^(?P<name>MD4|MD5|SHA1|SHA224|SHA256|SHA384|SHA512|RIPEMD160)(?:_Init|_Update|_Final)?$/ ¦ capture name as name
c.openssl.stream-lowlevel ¦ primitive ¦ /^(?P<name>RC4|BF|RC2|CAST|IDEA)_(?:set_key|encrypt|ecb_encrypt|cbc_encrypt)$/ ¦ capture name as name
c.openssl.hmac-init ¦ primitive ¦ HMAC_Init_ex ¦ =hmac ¦ digest arg 3 as digest less EVP_
c.openssl.hmac-oneshot ¦ primitive ¦ HMAC ¦ =hmac ¦ digest arg 0 as digest less EVP_
c.openssl.pbkdf2 ¦ primitive ¦ PKCS5_PBKDF2_HMAC ¦ =pbkdf2 ¦ digest arg 5 as digest less EVP_
c.openssl.pbkdf2-sha1 ¦ primitive ¦ PKCS5_PBKDF2_HMAC_SHA1 ¦ =pbkdf2 ¦ digest is sha-1
c.openssl.ssl-method ¦ protocol protocol-version ¦ /^(?P<version>SSLv2|SSLv3|TLSv1|TLSv1_1|TLSv1_2|DTLSv1|DTLSv1_2)_(?:client_|server_)?method$/ ¦ capture version as version
c.openssl.proto-version ¦ protocol protocol-version ¦ SSL_CTX_set_min_proto_version SSL_set_min_proto_version SSL_CTX_set_max_proto_version ¦ arg 1 as version
c.openssl.cipher-list ¦ protocol cipher-list ¦ SSL_CTX_set_cipher_list SSL_set_cipher_list SSL_CTX_set_ciphersuites SSL_set_ciphersuites ¦ arg 1 as list
c.openssl.groups ¦ protocol group-list ¦ SSL_CTX_set1_groups_list SSL_set1_groups_list SSL_CTX_set1_curves_list SSL_set1_curves_list ¦ arg 1 as list
c.sodium.box ¦ primitive ¦ /^crypto_(?:box|kx|scalarmult)(?:_[a-z0-9]+)*$/ ¦ =x25519
c.sodium.sign ¦ primitive ¦ /^crypto_sign(?:_[a-z0-9]+)*$/ ¦ =ed25519
c.sodium.aes-gcm ¦ primitive ¦ /^crypto_aead_aes256gcm_[a-z_]+$/ ¦ =aes ¦ key-bits is 256; mode is gcm
c.sodium.chacha ¦ primitive ¦ /^crypto_aead_x?chacha20poly1305_(?:ietf_)?[a-z_]+$/ ¦ =chacha20-poly1305
c.sodium.generichash ¦ primitive ¦ /^crypto_generichash(?:_[a-z0-9]+)*$/ ¦ =blake2b
c.sodium.pwhash ¦ primitive ¦ /^crypto_pwhash(?:_str)?(?:_verify)?$/ ¦ =argon2
c.mbedtls.aes ¦ primitive ¦ mbedtls_aes_setkey_enc mbedtls_aes_setkey_dec ¦ =aes ¦ key-bits arg 2 as int
c.mbedtls.rsa-gen ¦ primitive keygen ¦ mbedtls_rsa_gen_key ¦ =rsa ¦ key-bits arg 3 as int
c.mbedtls.ecp ¦ primitive ¦ mbedtls_ecp_group_load ¦ =ecdsa ¦ curve arg 1 as curve less MBEDTLS_ECP_DP_
c.mbedtls.digest ¦ primitive digest ¦ /^mbedtls_(?P<name>md5|sha1|sha256|sha512)(?:_ret|_starts|_update|_finish)?$/ ¦ capture name as name
c.cng.provider ¦ provider ¦ BCryptOpenAlgorithmProvider ¦ arg 1 as name less BCRYPT_ without _ALGORITHM
python.hashlib.named ¦ primitive digest ¦ /^hashlib\.(?P<name>md5|sha1|sha224|sha256|sha384|sha512|sha3_224|sha3_256|sha3_384|sha3_512|shake_128|shake_256|blake2b|blake2s)$/ ¦ capture name as name
python.hashlib.new ¦ provider digest ¦ hashlib.new ¦ arg 0 as name
python.hashlib.pbkdf2 ¦ provider ¦ hashlib.pbkdf2_hmac ¦ =pbkdf2 ¦ digest arg 0 as digest
python.hmac ¦ provider ¦ hmac.new hmac.digest ¦ =hmac ¦ digest arg 2 as digest; digest keyword digestmod as digest
python.cryptography.rsa-generate ¦ primitive keygen ¦ rsa.generate_private_key ¦ =rsa ¦ key-bits keyword key_size as int; key-bits arg 1 as int
python.cryptography.dsa-generate ¦ primitive ¦ dsa.generate_private_key ¦ =dsa ¦ key-bits keyword key_size as int; key-bits arg 0 as int
python.cryptography.dh-generate ¦ primitive ¦ dh.generate_parameters ¦ =dh ¦ key-bits keyword key_size as int; key-bits arg 1 as int
python.cryptography.ec-generate ¦ primitive keygen ¦ ec.generate_private_key ec.derive_private_key ¦ =ecdsa ¦ curve arg 0 as curve; curve keyword curve as curve; curve arg 1 as curve
python.cryptography.ecdh ¦ primitive ¦ ec.ECDH ¦ =ecdh
python.cryptography.ed25519 ¦ primitive ¦ /(?:^|\.)(?P<name>Ed25519|Ed448|X25519|X448)PrivateKey\.(?:generate|from_private_bytes)$/ ¦ capture name as name
python.cryptography.cipher ¦ provider ¦ Cipher ¦ arg 0 as name less algorithms. ¦ mode arg 1 as mode less modes.
python.cryptography.aead ¦ primitive ¦ /(?:^|\.)(?P<name>AESGCM|AESGCMSIV|AESCCM|AESOCB3|AESSIV|ChaCha20Poly1305)$/ ¦ capture name as name
python.cryptography.hashes ¦ primitive digest ¦ /^hashes\.(?P<name>MD5|SHA1|SHA224|SHA256|SHA384|SHA512|SHA512_256|SHA3_256|SHA3_384|SHA3_512|SHAKE128|SHAKE256|BLAKE2b|BLAKE2s|SM3)$/ ¦ capture name as name
python.cryptography.pbkdf2 ¦ primitive ¦ PBKDF2HMAC ¦ =pbkdf2 ¦ digest keyword algorithm as digest less hashes.
python.cryptography.hkdf ¦ primitive ¦ HKDF HKDFExpand ¦ =hkdf ¦ digest keyword algorithm as digest less hashes.
python.cryptography.fernet ¦ primitive ¦ Fernet MultiFernet ¦ =aes hmac ¦ key-bits is 128; mode is cbc; digest is sha-256
python.pycryptodome.new ¦ primitive ¦ /(?:^|\.)(?P<name>AES|DES|DES3|ARC4|ARC2|Blowfish|CAST|ChaCha20|ChaCha20_Poly1305|Salsa20)\.new$/ ¦ capture name as name ¦ mode arg 1 as mode less AES.MODE_|DES.MODE_|DES3.MODE_|Blowfish.MODE_|MODE_
python.pycryptodome.hash ¦ primitive digest ¦ /(?:^|\.)(?P<name>MD5|MD4|SHA1|SHA224|SHA256|SHA384|SHA512|SHA3_256|SHA3_512|RIPEMD160|BLAKE2b|BLAKE2s)\.new$/ ¦ capture name as name
python.pycryptodome.rsa ¦ primitive ¦ RSA.generate ¦ =rsa ¦ key-bits arg 0 as int
python.pycryptodome.ecc ¦ primitive ¦ ECC.generate ¦ =ecdsa ¦ curve keyword curve as curve
python.jwt ¦ protocol ¦ jwt.encode jwt.decode ¦ keyword algorithm as name
python.jwt.algorithms ¦ protocol ¦ jwt.decode ¦ keyword algorithms as name
python.ssl.context ¦ protocol protocol-version ¦ ssl.SSLContext ssl.wrap_socket ¦ arg 0 as version
python.ssl.ciphers ¦ protocol cipher-list ¦ *.set_ciphers ¦ arg 0 as list
go.hash ¦ primitive digest ¦ /^(?P<name>md5|sha1|sha256|sha512|sha3)\.(?:New|Sum|Sum256|Sum224|Sum512|New224|New256|New384|New512|Sum384|New512_256)$/ ¦ capture name as name
go.aes ¦ primitive ¦ aes.NewCipher ¦ =aes
go.des ¦ primitive ¦ des.NewCipher ¦ =des
go.3des ¦ primitive ¦ des.NewTripleDESCipher ¦ =3des
go.rc4 ¦ primitive ¦ rc4.NewCipher ¦ =rc4
go.cipher-mode ¦ primitive refine ¦ /^cipher\.New(?P<mode>GCM|CBCEncrypter|CBCDecrypter|CTR|OFB|CFBEncrypter|CFBDecrypter|GCMWithNonceSize|GCMWithTagSize)$/ ¦  ¦ mode capture mode as mode without Encrypter|Decrypter|WithNonceSize|WithTagSize
go.rsa-generate ¦ primitive keygen ¦ rsa.GenerateKey rsa.GenerateMultiPrimeKey ¦ =rsa ¦ key-bits arg 1 as int
go.rsa-sign ¦ primitive signature ¦ rsa.SignPKCS1v15 rsa.VerifyPKCS1v15 rsa.SignPSS rsa.VerifyPSS ¦ =rsa ¦ digest arg 2 as digest; digest arg 1 as digest
go.rsa-encrypt ¦ primitive pke ¦ rsa.EncryptPKCS1v15 rsa.DecryptPKCS1v15 rsa.EncryptOAEP rsa.DecryptOAEP ¦ =rsa
go.ecdsa ¦ primitive ¦ ecdsa.GenerateKey ¦ =ecdsa ¦ curve arg 0 as curve less elliptic.
go.ecdsa-sign ¦ primitive ¦ ecdsa.Sign ecdsa.Verify ecdsa.SignASN1 ecdsa.VerifyASN1 ¦ =ecdsa
go.ecdh ¦ primitive ¦ /^ecdh\.(?P<curve>P256|P384|P521|X25519)$/ ¦ capture curve as group
go.ed25519 ¦ primitive ¦ ed25519.GenerateKey ed25519.Sign ed25519.Verify ed25519.NewKeyFromSeed ¦ =ed25519
go.mlkem ¦ primitive ¦ /^mlkem\.(?:GenerateKey|NewDecapsulationKey|NewEncapsulationKey)(?P<set>768|1024)$/ ¦ =ml-kem ¦ parameter-set capture set as list
go.hmac ¦ primitive ¦ hmac.New ¦ =hmac ¦ digest arg 0 as digest
go.pbkdf2 ¦ primitive ¦ pbkdf2.Key ¦ =pbkdf2 ¦ digest arg 4 as digest; digest arg 0 as digest
js.node.hash ¦ provider digest ¦ crypto.createHash createHash ¦ arg 0 as name
js.node.hmac ¦ provider ¦ crypto.createHmac createHmac ¦ =hmac ¦ digest arg 0 as digest
js.node.cipher ¦ provider ¦ crypto.createCipheriv crypto.createDecipheriv createCipheriv createDecipheriv crypto.createCipher crypto.createDecipher ¦ arg 0 as name
js.node.keypair ¦ provider keygen ¦ crypto.generateKeyPairSync crypto.generateKeyPair generateKeyPairSync generateKeyPair ¦ arg 0 as name ¦ key-bits arg 1 property modulusLength as int; curve arg 1 property namedCurve as curve
js.node.sign ¦ provider signature ¦ crypto.createSign crypto.createVerify createSign createVerify ¦ arg 0 as name
js.node.ecdh ¦ provider ¦ crypto.createECDH createECDH ¦ arg 0 as group
js.node.dh ¦ provider ¦ crypto.createDiffieHellman crypto.getDiffieHellman ¦ =dh ¦ key-bits arg 0 as int
js.node.pbkdf2 ¦ provider ¦ crypto.pbkdf2 crypto.pbkdf2Sync pbkdf2 pbkdf2Sync ¦ =pbkdf2 ¦ digest arg 4 as digest
js.node.hkdf ¦ provider ¦ crypto.hkdf crypto.hkdfSync ¦ =hkdf ¦ digest arg 0 as digest
js.node.scrypt ¦ provider ¦ crypto.scrypt crypto.scryptSync ¦ =scrypt
js.webcrypto.algorithm-object ¦ provider ¦ subtle.generateKey subtle.importKey subtle.encrypt subtle.decrypt subtle.sign subtle.verify subtle.deriveKey subtle.deriveBits subtle.wrapKey subtle.unwrapKey ¦ property name as name ¦ key-bits property modulusLength as int; key-bits property length as int; curve property namedCurve as curve; digest property hash as digest
js.webcrypto.digest ¦ provider digest ¦ subtle.digest ¦ arg 0 as name
js.jsonwebtoken ¦ protocol ¦ jwt.sign jwt.verify jsonwebtoken.sign jsonwebtoken.verify ¦ property algorithm as name
js.jsonwebtoken.algorithms ¦ protocol ¦ jwt.verify jsonwebtoken.verify ¦ property algorithms as name
js.cryptojs ¦ primitive ¦ /^CryptoJS\.(?P<name>AES|DES|TripleDES|RC4|Rabbit|MD5|SHA1|SHA224|SHA256|SHA384|SHA512|SHA3|RIPEMD160|HmacMD5|HmacSHA1|HmacSHA256|HmacSHA512|PBKDF2)(?:\.encrypt|\.decrypt)?$/ ¦ capture name as name
js.node.tls-options ¦ protocol cipher-list ¦ tls.createServer tls.connect https.createServer tls.createSecureContext ¦ property ciphers as list
js.node.tls-min-version ¦ protocol protocol-version ¦ tls.createServer tls.connect https.createServer tls.createSecureContext ¦ property minVersion as version
js.forge.rsa ¦ primitive ¦ rsa.generateKeyPair ¦ =rsa ¦ key-bits property bits as int; key-bits arg 0 as int
rust.rustcrypto.aead ¦ primitive ¦ /(?:^|\.)(?P<name>Aes128Gcm|Aes256Gcm|Aes128GcmSiv|Aes256GcmSiv|Aes128Ccm|Aes256Ccm|ChaCha20Poly1305|XChaCha20Poly1305)\.(?:new|new_from_slice|generate_key)$/ ¦ capture name as name
rust.rustcrypto.hash ¦ primitive digest ¦ /(?:^|\.)(?P<name>Md5|Sha1|Sha224|Sha256|Sha384|Sha512|Sha3_256|Sha3_384|Sha3_512|Blake2b512|Blake2s256|Ripemd160|Sm3)\.(?:new|digest|new_with_prefix)$/ ¦ capture name as name
rust.rustcrypto.md5-compute ¦ primitive ¦ md5.compute ¦ =md5
rust.rustcrypto.rsa ¦ primitive keygen ¦ RsaPrivateKey.new ¦ =rsa ¦ key-bits arg 1 as int
rust.rustcrypto.pqc ¦ primitive ¦ /(?:^|\.)(?P<name>MlKem512|MlKem768|MlKem1024|MlDsa44|MlDsa65|MlDsa87)\.[a-z_]+$/ ¦ capture name as name
rust.openssl.symm ¦ provider ¦ /(?:^|\.)Cipher\.(?P<name>aes_128_[a-z0-9]+|aes_192_[a-z0-9]+|aes_256_[a-z0-9]+|des_[a-z0-9_]+|bf_[a-z0-9]+|rc4|chacha20|chacha20_poly1305)$/ ¦ capture name as name
rust.openssl.digest ¦ provider digest ¦ /(?:^|\.)MessageDigest\.(?P<name>md5|sha1|sha224|sha256|sha384|sha512|sha3_256|sha3_512|sm3)$/ ¦ capture name as name
rust.openssl.rsa ¦ primitive ¦ Rsa.generate ¦ =rsa ¦ key-bits arg 0 as int
rust.ring.algorithm-constant ¦ provider ¦ UnboundKey.new digest.digest hmac.Key.new Key.new agreement.EphemeralPrivateKey.generate EphemeralPrivateKey.generate signature.EcdsaKeyPair.from_pkcs8 ¦ arg 0 as name less aead.|digest.|hmac.|agreement.|signature.
csharp.create ¦ provider ¦ /(?:^|\.)(?P<name>Aes|AesGcm|AesCcm|ChaCha20Poly1305|DES|TripleDES|RC2|Rijndael|RSA|DSA|ECDsa|ECDiffieHellman|MD5|SHA1|SHA256|SHA384|SHA512|SHA3_256|SHA3_384|SHA3_512|HMACSHA1|HMACSHA256|HMACSHA384|HMACSHA512|HMACMD5)\.(?:Create|HashData|TryHashData)$/ ¦ capture name as name ¦ key-bits arg 0 as int; curve arg 0 as curve less ECCurve.NamedCurves.
csharp.constructor ¦ primitive ¦ /(?:^|\.)(?P<name>AesGcm|AesCcm|ChaCha20Poly1305|HMACSHA1|HMACSHA256|HMACSHA384|HMACSHA512|HMACMD5|RSACryptoServiceProvider|DSACryptoServiceProvider|TripleDESCryptoServiceProvider|DESCryptoServiceProvider|RC2CryptoServiceProvider|MD5CryptoServiceProvider|SHA1CryptoServiceProvider|SHA1Managed|SHA256Managed|RijndaelManaged|AesManaged|AesCryptoServiceProvider)$/ ¦ capture name as name without CryptoServiceProvider|Managed ¦ key-bits arg 0 as int
csharp.rfc2898 ¦ primitive ¦ Rfc2898DeriveBytes Rfc2898DeriveBytes.Pbkdf2 ¦ =pbkdf2 ¦ digest is sha-1; digest arg 3 as digest less HashAlgorithmName.; digest arg 4 as digest less HashAlgorithmName.
csharp.pqc ¦ provider ¦ MLKem.GenerateKey MLDsa.GenerateKey SlhDsa.GenerateKey ¦ arg 0 as name less MLKemAlgorithm.|MLDsaAlgorithm.|SlhDsaAlgorithm.
csharp.cipher-mode ¦ provider assign ¦ .Mode= ¦  ¦ mode value as mode less CipherMode.
csharp.key-size ¦ provider assign ¦ .KeySize= ¦  ¦ key-bits value as int
"""

# Modules whose import alone is weak evidence of an algorithm.
IMPORTS = [
    ("go.import.md5", "go", "crypto/md5", "md5"), ("go.import.sha1", "go", "crypto/sha1", "sha-1"), ("go.import.des", "go", "crypto/des", "des"), ("go.import.rc4", "go", "crypto/rc4", "rc4"),
    ("go.import.dsa", "go", "crypto/dsa", "dsa"), ("go.import.mlkem", "go", "crypto/mlkem", "ml-kem"), ("python.import.pycryptodome-des", "python", "Crypto/Cipher/DES Cryptodome/Cipher/DES", "des"),
    ("python.import.pycryptodome-arc4", "python", "Crypto/Cipher/ARC4 Cryptodome/Cipher/ARC4", "rc4"), ("python.import.pycryptodome-md5", "python", "Crypto/Hash/MD5 Cryptodome/Hash/MD5", "md5"),
    ("c.import.openssl-md5", "c", "openssl/md5.h", "md5"), ("c.import.openssl-des", "c", "openssl/des.h", "des"), ("c.import.openssl-rc4", "c", "openssl/rc4.h", "rc4"),
]


@dataclass(frozen=True)
class Source:
    """Where a value is read from, and how: places are tried as one, an argument's property needs both."""

    places: tuple[tuple[str, str], ...]
    grammar: str
    less: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    languages: tuple[str, ...]
    style: str
    kind: str = "algorithm"
    callees: tuple[str, ...] = ()
    regex: str | None = None
    properties: tuple[str, ...] = ()
    algorithms: tuple[str, ...] = ()
    source: Source | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    parameters: tuple[tuple[str, Source], ...] = ()
    function: str | None = None
    primitive: str | None = None


def source_of(text: str) -> Source:
    """arg 0 as name; arg 1 property bits as int; capture name as name less EVP_ without Managed."""
    where, _, how = text.partition(" as ")
    words, places = iter(where.split()), []
    for w in words:
        places.append((w, next(words) if w != "value" else ""))
    grammar, *more = how.split()
    stripped = dict(zip(more[::2], (tuple(m.split("|")) for m in more[1::2]), strict=True))
    return Source(tuple(places), grammar, stripped.get("less", ()), stripped.get("without", ()))


def parsed(line: str) -> Rule:
    rule_id, role, calls, algorithm, parameters = (part.strip() for part in (line + " ¦" * 4).split("¦")[:5])
    style, *others = role.split()
    said = {name: next((w for w in others if w in values), None) for name, values in ROLES.items()}
    regex = calls[1:-1] if calls.startswith("/") else None
    names = () if regex else tuple(calls.split())
    fixed, read = [], []
    for p in filter(None, parameters.split("; ")):
        name, _, rest = p.partition(" ")
        fixed.append((name, rest[3:])) if rest.startswith("is ") else read.append((name, source_of(rest)))
    return Rule(
        rule_id, (LANGUAGES[rule_id.split(".")[0]],), style, said["kind"] or "algorithm", tuple(n for n in names if not n.endswith("=")), regex, tuple(n[1:-1] for n in names if n.endswith("=")),
        tuple(algorithm[1:].split()) if algorithm.startswith("=") else (), None if algorithm[:1] in ("=", "") else source_of(algorithm), tuple(fixed), tuple(read), said["function"], said["primitive"],
    )


def checked(rules: Iterable[Rule]) -> list[Rule]:
    """The rules, if they make sense as a whole."""
    rules, known, seen = list(rules), {a[0] for a in ALGORITHMS}, set()
    for r in rules:
        sources = [s for s in (r.source, *(s for _, s in r.parameters)) if s]
        wrong = (
            r.id in seen and "is there twice" or not r.languages and "names no language" or r.kind not in KINDS and f"has the unknown kind {r.kind}"
            or not (r.callees or r.regex or r.properties) and "matches no call" or next((f"names the unknown algorithm {a}" for a in r.algorithms if a not in known), "")
            or next((f"uses the unknown grammar {s.grammar}" for s in sources if s.grammar not in GRAMMARS), "") or next((f"sets the unknown parameter {p}" for p, _ in (*r.fixed, *r.parameters) if p not in PARAMETERS), "")
            or next((f"reads from the unknown place {k}" for s in sources for k, _ in s.places if k not in PLACES), "")
        )
        if wrong:
            raise ValueError(f"rule {r.id} {wrong}")
        if r.regex:
            groups = re.compile(r.regex).groupindex
            if lost := [v for s in sources for k, v in s.places if k == "capture" and v not in groups]:
                raise ValueError(f"rule {r.id} has no group {lost[0]}")
        seen.add(r.id)
    return rules


def from_toml(text: str) -> list[Rule]:
    """Rules of [[rule]] tables: id, languages, style, kind, callee, callee_regex, property, algorithm(s), from, params, param, function, primitive."""

    def source(given: dict) -> Source:
        places = tuple((k, "" if k == "value" else str(given[k])) for k in PLACES if k in given)
        return Source(places, given.get("grammar", "list"), tuple(given.get("strip_prefix", ())), tuple(given.get("strip_suffix", ())))

    spelled = {"keyBits": "key-bits", "parameterSet": "parameter-set"}
    known = {"id", "languages", "style", "kind", "callee", "callee_regex", "property", "algorithm", "algorithms", "from", "params", "param", "function", "primitive", "version", "receiver_arg", "protocol"}
    found = []
    for given in tomllib.loads(text).get("rule", []):
        if unknown := set(given) - known:
            raise ValueError(f"rule {given.get('id')} has unknown fields: {', '.join(sorted(unknown))}")
        alone = [given["algorithm"]] if "algorithm" in given else []
        found.append(Rule(
            given["id"], tuple(given["languages"]), given["style"], given.get("kind", "algorithm"), tuple(given.get("callee", ())), given.get("callee_regex"), tuple(given.get("property", ())), (*alone, *given.get("algorithms", ())),
            source(given["from"]) if "from" in given else None, tuple((spelled.get(k, k), str(v)) for k, v in given.get("params", {}).items()), tuple((p["name"], source(p)) for p in given.get("param", ())), given.get("function"), given.get("primitive"),
        ))
    return checked(found)


@lru_cache(maxsize=1)
def catalogue() -> tuple[Rule, ...]:
    return tuple(checked(parsed(line) for line in TABLE.strip().splitlines()))
