"""Queries of configuration: Terraform, keys held elsewhere, and what keys set.

The texts are put together from the tables' numbers; the oracles work out from the same numbers
what such a text has to give, and read no text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postura import estate
from postura.estate import pick
from postura.functions import settings
from postura.plans import sql
from postura.plans.registry import query
from postura.plans.rules import drawn, drawn_sql
from postura.sources import custody, terraform

K = "CAST(c_custkey AS STRING)"
SPEC = pick("RSA_2048,ECC_NIST_P384,SYMMETRIC_DEFAULT,HMAC_512,PQ_SIGN_ML_DSA_65", "(c_custkey % 5)")
TYPE = pick("RSA,EC,RSA-HSM,EC-HSM,oct", "(c_nationkey % 5)")
BITS = pick("2048,3072,4096", "(c_custkey % 3)")
CURVE = pick("P-256,P-384,secp521r1", "(c_custkey % 3)")
POLICY = pick("ELBSecurityPolicy-2016-08,ELBSecurityPolicy-TLS13-1-2-2021-06,ELBSecurityPolicy-TLS13-1-3-PQ-2025-09,TLSv1_2016,any", "(c_nationkey % 5)")
LISTENS = pick("HTTPS,HTTP,TLS", "(c_custkey % 3)")
LINES = [
    "'# estate'", f"concat('resource \"aws_kms_key\" \"k', {K}, '\" {{ # key')", f"concat('  customer_master_key_spec = \"', {SPEC}, '\" # {{')", "'  tags = {'", "concat('    owner = \"team#', CAST(c_custkey % 7 AS STRING), '\"')", "'  }'", "'}'",
    "'variable \"v\" {'", "'  default = \"x\"'", "'}'", f"concat('resource \"azurerm_key_vault_key\" \"z', {K}, '\" {{')", f"concat('  key_type = \"', {TYPE}, '\"')", f"concat('  key_size = ', {BITS})", f"concat('  curve = \"', {CURVE}, '\"')",
    "'  rotation_policy {'", "'    automatic {'", "concat('      time_before_expiry = \"P', CAST(c_custkey % 90 AS STRING), 'D\"')", "'    }'", "'  }'", "'}'",
    f"concat('resource \"aws_lb_listener\" \"l', {K}, '\" {{')", f"concat('  protocol = \"', {LISTENS}, '\"')", f"concat('  ssl_policy = \"', {POLICY}, '\"')", "'}'",
]
PATH = f"concat('infra/', {K}, '.tf')"
#: Kind, name, first line, attribute with path, its value and line.
ATTRIBUTES = [
    ("aws_kms_key", "k", 2, "customer_master_key_spec", SPEC, 3), ("aws_kms_key", "k", 2, "tags.owner", "concat('team#', CAST(c_custkey % 7 AS STRING))", 5), ("azurerm_key_vault_key", "z", 11, "key_type", TYPE, 12), ("azurerm_key_vault_key", "z", 11, "key_size", BITS, 13),
    ("azurerm_key_vault_key", "z", 11, "curve", CURVE, 14), ("azurerm_key_vault_key", "z", 11, "rotation_policy.automatic.time_before_expiry", "concat('P', CAST(c_custkey % 90 AS STRING), 'D')", 17), ("aws_lb_listener", "l", 21, "protocol", LISTENS, 22), ("aws_lb_listener", "l", 21, "ssl_policy", POLICY, 23),
]


def texts(spark, d, lines=LINES, path=PATH):
    text = F.expr("concat_ws(chr(10), " + ", ".join(lines) + ")")
    return estate.read(spark, d, "customer").select(F.expr(path).alias("path"), text.alias("text"))


@query(" UNION ALL ".join(f"SELECT {PATH} AS path, '{kind}' AS kind, concat('{n}', {K}) AS name, CAST({first} AS BIGINT) AS resource_line, '{a}' AS attribute, {v} AS value, CAST({line} AS BIGINT) AS line FROM customer" for kind, n, first, a, v, line in ATTRIBUTES))
def terraform_attributes(spark, d):
    """Attributes of resources, with the blocks that they stand in."""
    return terraform.attributes(texts(spark, d)).drop("key")


# specification: algorithm, bits, set, curve, mode, digest; policy: least version and whether hybrid
SPECS = [("RSA_2048", "rsa", 2048, None, None, None, None), ("ECC_NIST_P384", "ecdsa", None, None, "P-384", None, None), ("SYMMETRIC_DEFAULT", "aes", 256, None, None, "gcm", None), ("HMAC_512", "hmac", None, None, None, None, "sha-512"), ("PQ_SIGN_ML_DSA_65", "ml-dsa", None, "65", None, None, None)]
POLICIES = [("ELBSecurityPolicy-2016-08", "1.0", False), ("ELBSecurityPolicy-TLS13-1-2-2021-06", "1.2", False), ("ELBSecurityPolicy-TLS13-1-3-PQ-2025-09", "1.3", True), ("TLSv1_2016", "1.0", False)]
KNOWN = f"""WITH specs(spec, alg_id, key_bits, parameter_set, curve, mode, digest) AS (VALUES {sql.values(SPECS)}), policies(policy, version, hybrid) AS (VALUES {sql.values(POLICIES)}),
c AS (SELECT {K} AS k, {SPEC} AS spec, {TYPE} AS type, {BITS} AS bits, CASE {CURVE} WHEN 'secp521r1' THEN 'P-521' ELSE {CURVE} END AS curve, {POLICY} AS policy, {LISTENS} AS protocol FROM customer)"""


@query(f"""{KNOWN}, f AS (
SELECT 'aws_kms_key' AS kind, 'customer_master_key_spec' AS attribute, alg_id, key_bits, parameter_set, s.curve, mode, digest, NULL AS version, false AS listener FROM c JOIN specs s USING (spec)
UNION ALL SELECT 'azurerm_key_vault_key', 'key_type', CASE WHEN type LIKE 'RSA%' THEN 'rsa' ELSE 'ecdsa' END, CASE WHEN type LIKE 'RSA%' THEN CAST(bits AS INT) END, NULL, CASE WHEN type LIKE 'EC%' THEN curve END, NULL, NULL, NULL, false FROM c WHERE type <> 'oct'
UNION ALL SELECT 'aws_lb_listener', 'ssl_policy', NULL, NULL, NULL, NULL, NULL, NULL, version, false FROM c JOIN policies USING (policy)
UNION ALL SELECT 'aws_lb_listener', 'ssl_policy', 'x25519-mlkem768', NULL, NULL, NULL, NULL, NULL, NULL, false FROM c JOIN policies USING (policy) WHERE hybrid
UNION ALL SELECT 'aws_lb_listener', 'protocol', NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM c WHERE protocol <> 'HTTP')
SELECT 'config.terraform.' || kind AS rule_id, kind || '.' || attribute AS token, alg_id, key_bits, parameter_set, curve, mode, digest, version, listener, count(*) AS places FROM f GROUP BY ALL""")
def terraform_findings(spark, d):
    found = terraform.findings(terraform.resources(terraform.attributes(texts(spark, d))))
    return found.groupBy("rule_id", "token", "alg_id", "key_bits", "parameter_set", "curve", "mode", "digest", "version", "listener").agg(F.count("*").alias("places"))


@query(f"""{KNOWN}
SELECT 'aws_kms_key.k' || k AS name, 'cloud-kms' AS custody, CASE WHEN alg_id IN ('aes', 'hmac') THEN 'secret-key' ELSE 'private-key' END AS material, alg_id, key_bits, s.curve, 'AWS KMS key aws_kms_key.k' || k AS detail FROM c JOIN specs s USING (spec)
UNION ALL SELECT 'azurerm_key_vault_key.z' || k, CASE WHEN type LIKE '%-HSM' THEN 'cloud-hsm' ELSE 'cloud-kms' END, 'private-key', CASE WHEN type LIKE 'RSA%' THEN 'rsa' WHEN type LIKE 'EC%' THEN 'ecdsa' END, CASE WHEN type LIKE 'RSA%' THEN CAST(bits AS INT) END,
  CASE WHEN type LIKE 'EC%' THEN curve END, 'Azure Key Vault key azurerm_key_vault_key.z' || k FROM c""")
def terraform_keys(spark, d):
    """Keys that cloud services hold, with their custody."""
    found = terraform.keys(terraform.resources(terraform.attributes(texts(spark, d))))
    return found.select(F.concat_ws(".", "kind", "name").alias("name"), "custody", "material", "alg_id", "key_bits", "curve", "detail")


REFERENCES = [
    f"concat('ssl_certificate_key \"engine:pkcs11:pkcs11:token=t', {K}, '%20x;object=o;type=', {pick('private,public,cert', '(c_custkey % 3)')}, '?pin-value=1\";')", "'# handle:0x81000009'", f"concat('key handle:0x8100', lpad({K}, 4, '0'), ';')",
    f"concat('key-store-type: ', {pick('PKCS11,JKS', '(c_custkey % 2)')})", f"concat('seal \"', {pick('awskms,pkcs11,shamir', '(c_nationkey % 3)')}, '\" {{')", "'  region = \"eu\"'", f"concat('  kms_key_id = \"v', {K}, '\"')", "'}'", "'key_name = \"late\"'",
]
CONF = f"concat('etc/', {K}, '.conf')"


@query(f"""WITH c AS (SELECT {CONF} AS path, {K} AS k, c_custkey % 3 AS t, c_custkey % 2 AS s, c_nationkey % 3 AS v, c_custkey FROM customer)
SELECT path, 1::BIGINT AS line, 'config.custody.pkcs11-uri' AS rule_id, 'pkcs11-token' AS custody, CASE t WHEN 0 THEN 'private-key' ELSE 'public-key' END AS material, 'PKCS#11 token "t' || k || ' x", object "o"' AS detail,
  'pkcs11:token=t' || k || '%20x;object=o;type=' || CASE t WHEN 0 THEN 'private' ELSE 'public' END AS key FROM c WHERE t < 2
UNION ALL SELECT path, 3, 'config.custody.tpm-handle', 'tpm', 'private-key', 'TPM2 persistent key handle 0x8100' || lpad(k, 4, '0'), 'tpm-handle:0x8100' || lpad(k, 4, '0') FROM c
UNION ALL SELECT path, 4, 'config.custody.java-pkcs11-keystore', 'pkcs11-token', 'private-key', 'Java PKCS#11 keystore (key-store-type)', 'java-pkcs11-keystore' FROM c WHERE s = 0
UNION ALL SELECT path, 5, 'config.custody.vault-seal', CASE v WHEN 0 THEN 'cloud-kms' ELSE 'pkcs11-token' END, 'secret-key', 'Vault seal key "v' || k || '" in ' || CASE v WHEN 0 THEN 'AWS KMS' ELSE 'a PKCS#11 HSM' END, 'vault-seal:' || CASE v WHEN 0 THEN 'awskms' ELSE 'pkcs11' END || ':v' || k FROM c WHERE v < 2""")
def custody_references(spark, d):
    """Keys that configuration refers to, but that are held elsewhere; a PIN is never kept."""
    return custody.references(texts(spark, d, REFERENCES, CONF)).drop("token")


# a key, and what it sets
SETTINGS = [
    ("KexAlgorithms", "ssh"), ("HostKeyAlgorithms", "ssh"), ("PubkeyAcceptedKeyTypes", "ssh"), ("MACs", "ssh"), ("CASignatureAlgorithms", "ssh"), ("ssl_policy", "tls-policy"), ("security_policy", "tls-policy"), ("minimum_protocol_version", "tls-policy"), ("tlsPolicyName", "tls-policy"),
    ("customer_master_key_spec", "key-spec"), ("key_spec", "key-spec"), ("key_algorithm", "key-spec"), ("version_template_algorithm", "key-spec"), ("ssl_protocols", "protocols"), ("server.ssl.enabled-protocols", "protocols"), ("protocols", "protocols"), ("min_protocol", "protocols"),
    ("tls_version", "protocols"), ("MinVersion", "protocols"), ("tls_max_version", "protocols"), ("protocol", None), ("cipher_list", "ciphers"), ("ssl_ciphers", "ciphers"), ("Ciphers", "ciphers"), ("ssl_ecdh_curve", "groups"), ("jdk.tls.namedGroups", "groups"), ("groups", "groups"),
    ("tls_groups", "groups"), ("working_groups", None), ("jwt.alg", "algorithm"), ("algo", "algorithm"), ("signing_algorithm", "algorithm"), ("password_hash", "algorithm"), ("hash_count", None), ("default_digest", "algorithm"), ("signature", "algorithm"), ("sigAlgName", "algorithm"),
    ("key_type", "algorithm"), ("pbe_kdf", "algorithm"), ("mac", "algorithm"), ("macro", None), ("disk_encryption", "algorithm"), ("timeout", None), ("port", None), ("cipher.algorithm.timeout", None), ("server.TLS.version", "protocols"), ("https.api.version", "protocols"), ("app.version", None),
]


@query(drawn_sql([(i, *s) for i, s in enumerate(SETTINGS)], "i, k, setting", len(SETTINGS)) + " SELECT k, setting, count(*) AS uses FROM li JOIN e USING (i) GROUP BY ALL")
def key_setting(spark, d):
    """What configuration keys set, by the first rule that their last part meets."""
    rows = drawn(spark, d, [(i, s[0]) for i, s in enumerate(SETTINGS)], "i int, k string")
    return rows.groupBy("k").agg(F.count("*").alias("uses")).select("k", settings.of_path(F.col("k")).alias("setting"), "uses")
