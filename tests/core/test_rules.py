"""The rule catalogue, an organisation's own rules, and the grammars of values."""

import re

import pytest

from postura import rules as R
from postura.functions import names
from postura.operators import rules

OWN = """
[[rule]]
id = "acme.seal"
languages = ["python", "c"]
callee = ["vault.seal", "*.lock"]
style = "provider"
algorithm = "aes"
params = { keyBits = 256 }
param = [{ name = "mode", keyword = "mode", grammar = "mode" }, { name = "mode", arg = 1, grammar = "mode", strip_prefix = ["M_"] }]

[[rule]]
id = "acme.hash"
languages = ["python"]
callee_regex = '^acme_(?P<name>sha256|md5)$'
style = "primitive"
from = { capture = "name", grammar = "name" }
"""


def test_the_built_in_catalogue_is_whole():
    found = R.catalogue()
    assert len(found) == 135 and len({r.id for r in found}) == 135 and {r.kind for r in found} == set(R.KINDS)


@pytest.mark.parametrize("change, says", [
    (("acme.hash", "acme.seal"), "twice"), (('"aes"', '"eas"'), "unknown algorithm eas"), (('"mode", keyword', '"tone", keyword'), "unknown parameter tone"), (('grammar = "mode" }, {', 'grammar = "mood" }, {'), "unknown grammar mood"),
    (('callee = ["vault.seal", "*.lock"]', ""), "matches no call"), (('capture = "name"', 'capture = "nane"'), "no group nane"), (('style = "primitive"', 'style = "primitive"\nkind = "odd"'), "unknown kind odd"), (('style = "primitive"', 'style = "primitive"\ncolour = "red"'), "unknown fields: colour"),
])
def test_rules_are_checked_as_a_whole(change, says):
    assert len(R.from_toml(OWN)) == 2
    with pytest.raises(ValueError, match=says):
        R.from_toml(OWN.replace(*change))


def test_own_rules_match_and_read_values(spark):
    own = R.from_toml(OWN)
    rows = [
        (1, "python", "acme.vault.seal", ["k"], {"mode": "GCM"}), (2, "cpp", "vault.seal", ["k", "M_CBC"], {}), (3, "python", "x.lock", ["k", "nonsense"], {}), (4, "python", "lock", [], {}), (5, "python", "acme_md5", [], {}),
        (6, "c", "acme_md5", [], {}), (7, None, "x.lock", [], {}), (8, "python", None, [], {}), (9, "python", "...", [], {}), (10, "python", "vault..seal", [], {}), (11, "python", "unvault.seal", [], {}),
    ]
    calls = spark.createDataFrame(rows, "id long, language string, callee string, args array<string>, keywords map<string,string>")
    got = {r.id: (r.rule_id, r.alg_id, r.key_bits, r.mode) for r in rules.found(rules.matched(calls, own), "id", own).collect()}
    assert got == {1: ("acme.seal", "aes", 256, "gcm"), 2: ("acme.seal", "aes", 256, "cbc"), 3: ("acme.seal", "aes", 256, None), 5: ("acme.hash", "md5", None, None), 10: ("acme.seal", "aes", 256, None)}


@pytest.mark.parametrize("pattern, text", [(r"^EVP_(a|b)$", "EVP_"), (r"(?:^|\.)(?P<n>A|B)Engine$", "Engine"), (r"^(a|b)$", ""), (r"^x\.y[a-z]+zz$", "x.y")])
def test_the_text_that_an_expression_needs(pattern, text):
    assert rules.needed(pattern) == text


def test_every_expression_matches_only_what_holds_its_text():
    for r in R.catalogue():
        if r.regex:
            assert "(?P<" not in rules.needed(r.regex) and re.compile(r.regex)


def test_assignments_and_imports(spark):
    rows = spark.createDataFrame([(1, "csharp", "Mode", "CipherMode.ECB"), (2, "csharp", "KeySize", "256"), (3, "java", "Mode", "CipherMode.ECB"), (4, "csharp", "Padding", "x")], "id long, language string, property string, value string")
    assert {r.id: (r.rule_id, r.key_bits, r.mode) for r in rules.found(rules.assigned(rows), "id").collect()} == {1: ("csharp.cipher-mode", None, "ecb"), 2: ("csharp.key-size", 256, None)}
    given = [("go", '"crypto/md5"'), ("python", "Cryptodome.Hash.MD5"), ("python", "Crypto/Cipher/DES3"), ("c", "<openssl/rc4.h>"), ("cpp", '"openssl/des.h"'), ("go", "mycrypto/md5"), ("java", "crypto/md5")]
    found = {(r.language, r.module): r.alg_id for r in rules.imported(spark.createDataFrame(given, "language string, module string")).collect()}
    assert found == {("go", '"crypto/md5"'): "md5", ("python", "Cryptodome.Hash.MD5"): "md5", ("c", "<openssl/rc4.h>"): "rc4", ("cpp", '"openssl/des.h"'): "des"}


@pytest.mark.parametrize("text, alg, fields", [
    ("RSA_2048", "rsa", {"key_bits": 2048}), ("ECC_NIST_P256", "ecdsa", {"curve": "P-256"}), ("ECC_SECG_P256K1", "ecdsa", {"curve": "secp256k1"}), ("SYMMETRIC_DEFAULT", "aes", {"key_bits": 256, "mode": "gcm"}), ("HMAC_384", "hmac", {"digest": "sha-384"}),
    ("ML_DSA_65", "ml-dsa", {"parameter_set": "65"}), ("PQ_SIGN_ML_DSA_65", "ml-dsa", {"parameter_set": "65"}), ("RSA_SIGN_PSS_2048_SHA256", "rsa", {"key_bits": 2048, "padding": "pss", "digest": "sha-256"}), ("RSA_DECRYPT_OAEP_4096_SHA1", "rsa", {"key_bits": 4096, "padding": "oaep", "digest": "sha-1"}),
    ("EC_prime256v1", "ecdsa", {"curve": "P-256"}), ("RSA-HSM", "rsa", {"key_bits": None}), ("SM2", "sm2", {}), ("PQ_SIGN_SLH_DSA_SHA2_128S", "slh-dsa", {"parameter_set": "sha2-128s"}), ("EC_SIGN_ED25519", "ed25519", {}), ("banana", None, {}), ("ML", None, {}), (None, None, {}),
])
def test_key_specifications(text, alg, fields):
    found = names.key_spec(text)
    assert (found and found["alg_id"]) == alg and all(found[k] == v for k, v in fields.items())


@pytest.mark.parametrize("text, policy", [
    ("ELBSecurityPolicy-2016-08", ("1.0", False)), ("ELBSecurityPolicy-TLS13-1-2-2021-06", ("1.2", False)), ("ELBSecurityPolicy-TLS-1-2-Ext-2018-06", ("1.2", False)), ("TLSv1.2_2021", ("1.2", False)), ("TLS_1_2", ("1.2", False)), ("TLSv1_2016", ("1.0", False)),
    ("ELBSecurityPolicy-FS-1-2-2019-08", ("1.2", False)), ("ELBSecurityPolicy-TLS13-1-3-PQ-2025-09", ("1.3", True)), ("TLSv1", ("1.0", False)), ("none", None), (None, None),
])
def test_managed_policies(text, policy):
    assert names.tls_policy(text) == policy


@pytest.mark.parametrize("grammar, text, said", [
    ("int", "0x800", {"key_bits": 2048}), ("int", "2_048", {"key_bits": 2048}), ("int", "7", None), ("int", "70000", None), ("int", "two", None), ("mode", "CFB128", {"mode": "cfb"}), ("mode", "gcm_siv", {"mode": "gcm-siv"}), ("mode", "odd", None), ("curve", "secp384r1", {"curve": "P-384"}),
    ("digest", "SHA-256", {"digest": "sha-256"}), ("digest", "aes", None), ("padding", "RSA_PKCS1_PADDING", {"padding": "pkcs1v15"}), ("version", "TLSv1_2", {"version": "1.2"}), ("name", " ", None),
])
def test_grammars(grammar, text, said):
    assert names.value(grammar, text) == said


@pytest.mark.parametrize("text, alg, fields", [("AES", "aes", {"mode": "ecb", "padding": "pkcs5"}), ("AES_256/GCM/NoPadding", "aes", {"key_bits": 256, "mode": "gcm", "padding": "none"}), ("RSA", "rsa", {"mode": None}), ("RSA/ECB/PKCS1Padding", "rsa", {"mode": None, "padding": "pkcs1v15"}), ("AES/Odd/NoPadding", None, {})])
def test_ciphers_by_transformation(text, alg, fields):
    found = names.jca_cipher(text)
    assert (found and found["alg_id"]) == alg and all(found[k] == v for k, v in fields.items())


@pytest.mark.parametrize("text, alg, fields", [("ffdhe3072", "dh", {"key_bits": 3072, "parameter_set": "ffdhe3072"}), ("secp256r1", "ecdh", {"curve": "P-256"}), ("x448", "x448", {}), ("X25519MLKEM768", "x25519-mlkem768", {}), ("aes", None, {})])
def test_groups(text, alg, fields):
    found = names.group(text)
    assert (found and found["alg_id"]) == alg and all(found[k] == v for k, v in fields.items())
