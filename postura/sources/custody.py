"""References to keys that are held elsewhere: tokens, trusted modules, key stores, sealed volumes and vaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The longest part of a reference that is kept, and the providers of a vault's seal.
KEPT = 64
SEALS = {"pkcs11": ("pkcs11-token", "a PKCS#11 HSM"), "awskms": ("cloud-kms", "AWS KMS"), "gcpckms": ("cloud-kms", "Google Cloud KMS"), "azurekeyvault": ("cloud-kms", "Azure Key Vault"), "ocikms": ("cloud-kms", "OCI KMS"), "alicloudkms": ("cloud-kms", "Alibaba Cloud KMS")}
SEAL_LABELS = ["key_label", "kms_key_id", "key_name", "crypto_key"]
#: Lines after a seal's first one in which its label is looked for.
SEAL_LINES = 30
LINE_END = r"\r?\n"
COLUMNS = ["path", "line", "rule_id", "custody", "material", "detail", "token", "key"]


def clipped(c: Column) -> Column:
    return F.left(c, F.lit(KEPT))


def decoded(c: Column) -> Column:
    """Percent escapes resolved; a text with broken ones stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def row(rows: DataFrame, rule: str, custody: Column | str, material: Column | str, detail: Column, token: Column, key: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("path", "line", lit(rule).alias("rule_id"), lit(custody).alias("custody"), lit(material).alias("material"), detail.alias("detail"), clipped(token).alias("token"), key.alias("key"))


def tokens(lines: DataFrame) -> DataFrame:
    """pkcs11: references with attributes; those to certificates and data are none. What follows a ?, such as a PIN, is not kept."""
    uri = r"pkcs11:(?=([A-Za-z0-9%;=._~-]*))"
    rows = lines.where(F.contains("text", F.lit("pkcs11:"))).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(uri), F.lit(1))).alias("uri"))
    pairs = F.transform(F.filter(F.split("uri", ";"), lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(F.lower(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    rows = rows.withColumn("pairs", pairs).where(F.size("pairs") > 0)
    get = lambda name: F.try_element_at(F.filter("pairs", lambda p: p["k"] == name), F.lit(-1))["v"]
    material = F.when(get("type").isNull(), "key").when(get("type") == "private", "private-key").when(get("type") == "public", "public-key").when(get("type") == "secret-key", "secret-key")
    quoted = lambda what, v: F.when(v.isNotNull(), F.concat(F.lit(f'{what} "'), clipped(v), F.lit('"')))
    parts = F.concat_ws(", ", quoted("token", get("token")), F.coalesce(quoted("object", get("object")), F.concat(F.lit("id "), clipped(get("id")))))
    software = F.exists("pairs", lambda p: p["k"].isin("token", "model", "manufacturer") & F.contains(F.lower(p["v"]), F.lit("softhsm")))
    detail = F.concat(F.lit("PKCS#11 "), F.when(parts == "", "token").otherwise(parts), F.when(software, " (SoftHSM: a software token)").otherwise(""))
    whole = F.concat(F.lit("pkcs11:"), "uri")
    return row(rows.withColumn("material", material).where("material IS NOT NULL"), "config.custody.pkcs11-uri", "pkcs11-token", F.col("material"), detail, whole, whole)


def engines(lines: DataFrame) -> DataFrame:
    found = r"""engine:(?=(tpm2tss|tpm2|tpm):([^\s"';]+))"""
    rows = lines.select("path", "line", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(found), F.lit(1)).alias("engine"), F.regexp_extract_all("text", F.lit(found), F.lit(2)).alias("payload"))).alias("e")).select("path", "line", "e.*")
    return row(rows, "config.custody.openssl-engine", "tpm", "private-key", F.concat(F.lit("OpenSSL "), "engine", F.lit(" engine key "), clipped(F.col("payload"))), F.concat_ws(":", F.lit("engine"), "engine", "payload"), F.concat(F.lit("tpm:"), "payload"))


def handles(lines: DataFrame) -> DataFrame:
    rows = lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"handle:0x(81[0-9A-Fa-f]{6})(?![0-9A-Fa-f])"), F.lit(1))).alias("h"))
    return row(rows, "config.custody.tpm-handle", "tpm", "private-key", F.concat(F.lit("TPM2 persistent key handle 0x"), "h"), F.concat(F.lit("handle:0x"), "h"), F.concat(F.lit("tpm-handle:0x"), F.lower("h")))


def keystores(lines: DataFrame) -> DataFrame:
    pair = lambda i: F.when(F.contains("text", F.lit("=")), F.regexp_extract("text", "^([^=]*)=(.*)$", i)).otherwise(F.regexp_extract("text", "^([^:]*):(.*)$", i))
    rows = lines.select("path", "line", F.regexp_replace(F.trim(pair(1)), "^[\"']+|[\"']+$", "").alias("name"), F.regexp_replace(F.trim(pair(2)), "^[\"',]+|[\"',]+$", "").alias("value"))
    bare = F.lower(F.regexp_replace("name", "[-_.]", ""))
    rows = rows.where(F.contains(bare, F.lit("keystoretype")) & ~F.contains(bare, F.lit("trust")) & (F.lower("value") == "pkcs11"))
    return row(rows, "config.custody.java-pkcs11-keystore", "pkcs11-token", "private-key", F.concat(F.lit("Java PKCS#11 keystore ("), clipped(F.col("name")), F.lit(")")), F.concat_ws("=", "name", "value"), F.lit("java-pkcs11-keystore"))


def volumes(lines: DataFrame) -> DataFrame:
    """Entries of crypttab that a trusted module or a token unlocks."""
    fields = F.split(F.trim("text"), r"\s+")
    rows = lines.where(F.rlike("path", F.lit("(^|/)crypttab$"))).select("path", "line", F.get(fields, F.lit(0)).alias("name"), F.explode(F.split(F.get(fields, F.lit(3)), ",")).alias("option"))
    sealed = F.startswith("option", F.lit("tpm2-device="))
    rows = rows.where(sealed | F.startswith("option", F.lit("pkcs11-uri=")))
    how = F.when(sealed, " sealed to the TPM2").otherwise(" unlocked by a PKCS#11 token")
    rule = F.when(sealed, "config.custody.crypttab-tpm2").otherwise("config.custody.crypttab-pkcs11")
    detail = F.concat(F.lit("LUKS volume key for "), clipped(F.col("name")), how)
    return row(rows, rule, F.when(sealed, "tpm").otherwise("pkcs11-token"), "secret-key", detail, F.concat_ws(" ", "name", F.split_part("option", F.lit("="), F.lit(1))), F.concat(F.lit("luks:"), "name"))


def seals(files: DataFrame) -> DataFrame:
    """What protects a vault's own keys; its label stands in one of the next lines, before the closing brace.

    A file's lines are at hand where it is split, so that each seal takes its next lines along and no join is made.
    """
    provider = F.create_map(*(x for k, v in SEALS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("custody"), F.lit(v[1]).alias("name")))))
    opened = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, r'^\s*seal\s*"([^"]*)"', 1).alias("kind"))), lambda s: s["kind"].isin(*SEALS))
    near = F.transform(opened, lambda s: F.struct(s["line"].cast("long").alias("line"), s["kind"].alias("kind"), F.transform(F.slice("lines", s["line"] + 1, F.lit(SEAL_LINES)), lambda x: F.trim(x)).alias("next")))
    rows = files.where(F.contains("text", F.lit("seal"))).select("path", F.split("text", LINE_END).alias("lines")).select("path", F.explode(near).alias("s")).select("path", "s.*")
    part = lambda x, i: F.regexp_extract(x, "^([^=]*)=(.*)$", i)
    labels = F.filter(F.transform("next", lambda x, i: F.struct((i + 1).alias("at"), F.trim(part(x, 1)).alias("name"), x.alias("text"))), lambda s: s["name"].isin(*SEAL_LABELS))
    rows = rows.withColumn("end", F.array_position("next", "}")).withColumn("l", F.try_element_at(labels, F.lit(1)))
    value = clipped(F.regexp_replace(F.trim(part(F.col("l.text"), 2)), '^"+|"+$', ""))
    rows = rows.select("path", "line", "kind", provider[F.col("kind")].alias("p"), F.when((F.col("end") == 0) | (F.col("l.at") < F.col("end")), value).alias("label"))
    detail = F.concat(F.lit("Vault seal key "), F.coalesce(F.concat(F.lit('"'), "label", F.lit('" ')), F.lit("")), F.lit("in "), F.col("p.name"))
    return row(rows, "config.custody.vault-seal", F.col("p.custody"), "secret-key", detail, F.concat(F.lit('seal "'), "kind", F.lit('"')), F.concat_ws(":", F.lit("vault-seal"), "kind", F.coalesce("label", F.lit(""))))


def references(files: DataFrame) -> DataFrame:
    """(path, line, rule_id, custody, material, detail, token, key) of every reference in (path, text), each key once a line; comments hold none."""
    lines = files.select("path", F.posexplode(F.split("text", LINE_END)).alias("at", "text")).select("path", (F.col("at") + 1).cast("long").alias("line"), "text").where(~F.rlike("text", F.lit(r"^\s*(#|;|//)")))
    found = reduce(DataFrame.unionByName, [*(f(lines) for f in (tokens, engines, handles, keystores, volumes)), seals(files)])
    return found.groupBy("path", "line", "key").agg(F.min(F.struct("rule_id", "custody", "material", "detail", "token")).alias("r")).select("path", "line", "r.*", "key").select(COLUMNS)
