"""Scores of findings that are no bare algorithm: certificates, protocol settings, key material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura.policy import DEFAULT, Policy

#: Groups and key exchanges that withstand quantum attack.
POST_QUANTUM_GROUPS = ["X25519MLKEM768", "SecP256r1MLKEM768", "SecP384r1MLKEM1024", "mlkem768x25519-sha256", "sntrup761x25519-sha512", "MLKEM768", "MLKEM1024"]


def certificate_status(rows: DataFrame, policy: Policy = DEFAULT) -> Column:
    """0 to 3: the worse of key and signature; expired ones are disallowed, leaves of over two years legacy."""
    expired = F.when(F.col("not_after_year") < policy.assessment_year, 2).otherwise(0)
    long = F.when((F.col("not_after_year") - F.col("not_before_year") > 2) & ~F.col("is_ca"), 1).otherwise(0)
    return F.greatest("key_status", "signature_status", expired, long)


def certificate_lifetime(policy: Policy = DEFAULT) -> Column:
    """Years that a certificate stays trusted."""
    return F.greatest(F.col("not_after_year") - policy.assessment_year, F.lit(0)).cast("double")


# What the parts of a suite's name stand for.
EXCHANGES = {"RSA": "rsa", "DHE": "dh", "DH": "dh", "EDH": "dh", "ADH": "dh", "ECDHE": "ecdh", "ECDH": "ecdh", "AECDH": "ecdh"}
SIGNERS = {"RSA": "rsa", "ECDSA": "ecdsa", "DSS": "dsa"}
CIPHERS = {"AES": "aes", "3DES": "3des", "DES": "des", "DES40": "des", "RC4": "rc4", "RC2": "rc2", "CHACHA20": "chacha20-poly1305", "CAMELLIA": "camellia", "ARIA": "aria", "SEED": "seed", "IDEA": "idea"}
HASHES = {"SHA": "sha-1", "SHA1": "sha-1", "SHA224": "sha-224", "SHA256": "sha-256", "SHA384": "sha-384", "SHA512": "sha-512", "MD5": "md5"}


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def suite_parts(suite: Column) -> Column:
    """A suite's key_exchange, authentication, cipher, bits, mode, digest and weaknesses.

    Names are of the kind TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256, TLS_AES_128_GCM_SHA256 (no
    exchange) or ECDHE-RSA-AES128-GCM-SHA256. Weaknesses are those of the suite's structure
    (export grade, no authentication, no encryption); weak ciphers and digests count by
    themselves.
    """
    name = F.upper(F.trim(suite))
    iana = F.rlike(name, F.lit("^(TLS|SSL)_"))
    exchange, rest = F.regexp_extract(name, "^(?:TLS|SSL)_(.+)_WITH_", 1), F.regexp_replace(name, "^(?:TLS|SSL)_(?:.+_WITH_)?", "")
    # the other spelling: exchange and signer in front, if any, then the cipher
    dashed = r"^(?:EXP(?:1024)?-)?((?:ECDHE|DHE|EDH|ECDH|DH|ADH|AECDH|PSK|RSA(?=-PSK))?(?:-?(?:RSA|ECDSA|DSS|PSK)(?=-))?)-?"
    exchange = F.regexp_replace(F.when(iana, exchange).otherwise(F.replace(F.regexp_extract(name, dashed, 1), F.lit("-"), F.lit("_"))), "_EXPORT(?:1024)?", "")
    rest = F.when(iana, rest).otherwise(F.replace(F.regexp_replace(F.regexp_replace(name, dashed, ""), "DES-CBC3", "3DES-CBC"), F.lit("-"), F.lit("_")))
    kinds = F.split(exchange, "_")
    modern = iana & ~F.contains(name, F.lit("_WITH_"))
    first = F.when(~iana & (exchange == ""), F.lit("RSA")).otherwise(F.get(kinds, 0))
    signer = F.when(first.isin("ADH", "AECDH"), None).when(F.size(kinds) > 1, F.get(kinds, 1)).when(first == "RSA", "RSA")
    cipher = F.regexp_extract(rest, "^([0-9]?[A-Z]+(?:(?:20|40|4|2)(?=_|$))?)", 1)
    bits = F.regexp_extract(rest, "^[A-Z0-9]+?_?(128|192|256|40|56)(?:_|$)", 1)
    mode = F.lower(F.regexp_extract(rest, "_(GCM|CCM|CBC|CFB|OFB|ECB)(?:_|$)", 1))
    block = looked_up(CIPHERS, cipher).isin("aes", "camellia", "aria", "seed", "idea", "des", "3des")
    weak = F.array(
        F.when(F.rlike(name, F.lit("(?:_ANON_|^ADH-|^AECDH-)")), "anonymous"), F.when(F.rlike(name, F.lit("(?:_EXPORT|^EXP(?:1024)?-)")), "export"), F.when(F.rlike(rest, F.lit("^NULL(?:_|$)")), "null"),
    )
    return F.struct(
        F.when(~modern, looked_up(EXCHANGES, first)).alias("key_exchange"), F.when(~modern, looked_up(SIGNERS, signer)).alias("authentication"), looked_up(CIPHERS, cipher).alias("cipher"),
        F.coalesce(bits.try_cast("int"), F.when(cipher == "RC4", 128)).alias("bits"), F.when(mode != "", mode).when(block, "cbc").alias("mode"),
        looked_up(HASHES, F.regexp_extract(rest, "_([A-Z0-9]+)$", 1)).alias("digest"), F.array_join(F.array_sort(F.array_compact(weak)), ",").alias("weaknesses"),
    )


def weak_suite(suite: Column) -> Column:
    """Whether a suite is weak by its structure."""
    return suite_parts(suite)["weaknesses"] != ""


def protocol_status(kind: Column, version: Column, suites: Column) -> Column:
    """0 to 3: SSL and suites weak by their structure are broken, TLS 1.0 and 1.1 disallowed."""
    return (
        F.when(F.startswith(version, F.lit("ssl")) | F.exists(suites, weak_suite), 3)
        .when(version.isin("1.0", "1.1") & (kind != "ssh"), 2).otherwise(0)
    )


def protocol_breakability(names: Column) -> Column:
    """0 if any group or suite offers a post-quantum key exchange, else 1."""
    return F.when(F.arrays_overlap(names, F.array(*map(F.lit, POST_QUANTUM_GROUPS))), 0.0).otherwise(1.0)


def protocol_advice(kind: Column, version: Column, qb: Column) -> Column:
    """The action for a protocol's settings."""
    return (
        F.when(kind == "ssh", "enable").when(F.startswith(version, F.lit("ssl")) | version.isin("1.0", "1.1"), "upgrade")
        .when(qb == 0, "retain").otherwise("enable")
    )


def material_status(algorithm_status: Column, kind: Column, encrypted: Column, custody: Column) -> Column:
    """0 to 3: a private key that lies open is disallowed unless hardware or a service keeps it."""
    return F.greatest(algorithm_status, F.when((kind == "private-key") & ~encrypted & custody.isNull(), 2).otherwise(0))


def material_advice(kind: Column, encrypted: Column, custody: Column, has_algorithm: Column, qb: Column, broken: Column) -> Column:
    """The action for key material: custody first, then keys that lie open, then the algorithm."""
    kept = F.when(~has_algorithm, "review").when((qb <= 0.2) & ~broken, "retain").otherwise("replace")
    return F.when(custody.isNotNull(), kept).when((kind == "private-key") & ~encrypted, "rotate").when(~has_algorithm, "review").otherwise(kept)
