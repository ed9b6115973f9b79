"""Terraform and references to keys held elsewhere."""

import random

from postura.sources import custody, terraform

PLAN = '''# top {
resource "aws_kms_key" "a" { # note }
  customer_master_key_spec = "RSA_2048"
  tags = {
    owner = "me#1" # x
    "quoted" = "}{"
  }
}
variable "x" {
  default = "y"
}
}
resource "azurerm_key_vault_key" "z" {
  key_type = "EC-HSM"
  curve = "prime256v1"
  rotation_policy {
    automatic {
      time = "P30D"
    }
    after = "P1D"
  }
  key_opts = ["sign", "verify"]
}
resource "tls_private_key" "r" {
  algorithm = "RSA"
  rsa_bits = 4096
}
resource "aws_lb_listener" "l" {
  protocol = "HTTPS"
  ssl_policy = "ELBSecurityPolicy-TLS13-1-2-Res-PQ-2025-09"
}
resource "google_kms_crypto_key" "g" {
  purpose = "MAC"
  protection_level = "hsm"
}
resource "aws_kms_key" "open" {
  key_spec = "ECC_NIST_P384"
  key_usage = "SIGN_VERIFY"'''


def plan(spark, *texts):
    return spark.createDataFrame([(f"{i}.tf", t) for i, t in enumerate(texts)], "path string, text string")


def test_attributes_know_their_blocks(spark):
    got = {(r.kind, r.name, r.attribute): (r.value, r.line) for r in terraform.attributes(plan(spark, PLAN)).collect()}
    z = ("azurerm_key_vault_key", "z")
    assert got[("aws_kms_key", "a", "tags.owner")] == ("me#1", 5) and got[("aws_kms_key", "a", "tags.quoted")] == ("}{", 6)
    assert got[(*z, "rotation_policy.automatic.time")] == ("P30D", 18) and got[(*z, "rotation_policy.after")] == ("P1D", 20) and got[(*z, "key_opts")][1] == 22
    assert not any("default" in k[2] for k in got) and len(got) == 16


def test_what_resources_declare(spark):
    found = {(r.token, r.alg_id, r.key_bits, r.curve, r.version, r.listener) for r in terraform.findings(terraform.resources(terraform.attributes(plan(spark, PLAN)))).collect()}
    assert found == {
        ("aws_kms_key.customer_master_key_spec", "rsa", 2048, None, None, False), ("azurerm_key_vault_key.key_type", "ecdsa", None, "P-256", None, False), ("tls_private_key.algorithm", "rsa", 4096, None, None, False),
        ("aws_lb_listener.protocol", None, None, None, None, True), ("aws_lb_listener.ssl_policy", None, None, None, "1.2", False), ("aws_lb_listener.ssl_policy", "x25519-mlkem768", None, None, None, False), ("aws_kms_key.key_spec", "ecdsa", None, "P-384", None, False),
    }
    keys = {r.name: (r.custody, r.material, r.usage, r.alg_id) for r in terraform.keys(terraform.resources(terraform.attributes(plan(spark, PLAN)))).collect()}
    assert keys == {"a": ("cloud-kms", "private-key", None, "rsa"), "z": ("cloud-hsm", "private-key", "sign", "ecdsa"), "g": ("cloud-hsm", "private-key", None, None), "open": ("cloud-kms", "private-key", "sign", "ecdsa")}


def test_round_trip_of_nested_blocks(spark):
    """Random trees of blocks, written out and read again."""
    texts, want = [], set()
    for seed in range(12):
        r, lines = random.Random(seed), []

        def block(path, depth, name):
            for k in range(r.randrange(1, 4)):
                if depth < 5 and r.random() < 0.5:
                    inner = f"b{r.randrange(3)}"
                    lines.append("  " * depth + inner + r.choice([" {", " = {", ' "label" {']))
                    block((*path, inner), depth + 1, name)
                    lines.append("  " * depth + "}")
                else:
                    lines.append("  " * depth + f'k{k} = "v{r.randrange(99)}"')
                    want.add((f"{seed}.tf", name, ".".join((*path, f"k{k}")), lines[-1].split('"')[1], len(lines)))

        for n in range(3):
            kind = r.choice(["resource", "resource", "data"])
            lines.append(f'{kind} "t" "n{n}" {{')
            before = set(want)
            block((), 1, f"n{n}")
            lines.append("}")
            if kind == "data":
                want = before
        texts.append("\n".join(lines))
    got = {(r.path, r.name, r.attribute, r.value, r.line) for r in terraform.attributes(plan(spark, *texts)).collect()}
    assert got == want


def test_odd_texts_give_nothing(spark):
    files = spark.createDataFrame([("a", None), ("b", ""), ("c", "}}}{"), ("d", "x = 1"), ("e", 'resource "a"')], "path string, text string")
    assert terraform.attributes(files).count() == 0 and custody.references(files).count() == 0


def test_references_never_keep_a_pin(spark):
    text = "\n".join([
        'ssl_certificate_key "engine:pkcs11:pkcs11:token=prod-ca;object=tls;type=private?pin-value=123456";', "key = pkcs11:model=SoftHSM%20v2;token=dev;id=%01", "SSLCertificateFile pkcs11:token=x;object=c;type=cert", "engine pkcs11:",
        "ssl_certificate_key engine:tpm2tss:/etc/nginx/tls.tss;", "  # handle:0x81000002", "key handle:0x81000001; handle:0x80000001 handle:0x810000011", "  key-store-type: PKCS11", "  trust-store-type: PKCS11",
        'seal "awskms" {', '  region = "x"', '  kms_key_id = "alias/v"', "}", 'seal "pkcs11" {', "}", 'kms_key_id = "no"', 'seal "shamir" {',
    ])
    files = [("a.conf", text), ("etc/crypttab", "# c tpm2-device=auto\nroot UUID=abc none tpm2-device=auto,discard\nhome UUID=def - pkcs11-uri=auto\nswap /dev/sdb none luks"), ("fstab", "root UUID=abc none tpm2-device=auto")]
    rows = custody.references(spark.createDataFrame(files, "path string, text string")).collect()
    assert not any("123456" in f or "pin-value" in f for r in rows for f in (r.token, r.key, r.detail))
    assert {(r.path, r.line, r.custody, r.material, r.detail) for r in rows} == {
        ("a.conf", 1, "pkcs11-token", "private-key", 'PKCS#11 token "prod-ca", object "tls"'), ("a.conf", 2, "pkcs11-token", "key", 'PKCS#11 token "dev", id \x01 (SoftHSM: a software token)'), ("a.conf", 5, "tpm", "private-key", "OpenSSL tpm2tss engine key /etc/nginx/tls.tss"),
        ("a.conf", 7, "tpm", "private-key", "TPM2 persistent key handle 0x81000001"), ("a.conf", 8, "pkcs11-token", "private-key", "Java PKCS#11 keystore (key-store-type)"), ("a.conf", 10, "cloud-kms", "secret-key", 'Vault seal key "alias/v" in AWS KMS'),
        ("a.conf", 14, "pkcs11-token", "secret-key", "Vault seal key in a PKCS#11 HSM"), ("etc/crypttab", 2, "tpm", "secret-key", "LUKS volume key for root sealed to the TPM2"), ("etc/crypttab", 3, "pkcs11-token", "secret-key", "LUKS volume key for home unlocked by a PKCS#11 token"),
    }


def test_seals_are_labelled_without_a_join(spark, capsys):
    seal = lambda kind, *lines: "\n".join([f'seal "{kind}" {{', *lines])
    far = ["  x = 1"] * 29
    texts = {
        "a": seal("awskms", "# }", '  # key_name = "no"', ' kms_key_id = "k1"', ' key_name = "k2"', "}"), "b": seal("pkcs11", "  }", 'key_label = "late"'), "c": seal("shamir", 'key_label = "no"'),
        "d": seal("ocikms", *far, 'key_name = "thirtieth"'), "e": seal("ocikms", *far, "x = 2", 'key_name = "beyond"'), "f": seal("awskms", seal("pkcs11", 'key_label = "both"')),
    }
    found = custody.references(spark.createDataFrame([*texts.items(), ("g", None)], "path string, text string"))
    got = sorted((r.path, r.line, r.key) for r in found.collect())
    assert got == [
        ("a", 1, "vault-seal:awskms:k1"), ("b", 1, "vault-seal:pkcs11:"), ("d", 1, "vault-seal:ocikms:thirtieth"), ("e", 1, "vault-seal:ocikms:"),
        ("f", 1, "vault-seal:awskms:both"), ("f", 2, "vault-seal:pkcs11:both"),
    ]
    found.explain()
    assert "Join" not in capsys.readouterr().out
