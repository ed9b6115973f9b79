"""Terraform: resources, their attributes with paths, and what these say of keys, policies and listeners."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postura.functions import names

# Attributes that name a key's algorithm, and those that name a policy or version.
KEY_ATTRIBUTES = ["customer_master_key_spec", "key_spec", "algorithm", "key_algorithm"]
POLICY_ATTRIBUTES = ["ssl_policy", "security_policy", "minimum_protocol_version", "min_tls_version", "minimum_tls_version", "tls_version"]
SERVICES = {"aws_kms_key": "AWS KMS", "google_kms_crypto_key": "Google Cloud KMS", "azurerm_key_vault_key": "Azure Key Vault"}
ALGORITHM = "struct<alg_id:string,key_bits:int,parameter_set:string,curve:string,mode:string,padding:string,digest:string,version:string,quantum:boolean>"


def uncommented(line: Column) -> Column:
    """The line up to a # that stands in no quotes."""
    return F.regexp_replace(line, r"""^((?:[^#"']|"[^"]*"|'[^']*')*)#.*$""", "$1")


def attributes(files: DataFrame) -> DataFrame:
    """(path, kind, name, resource_line, attribute, key, value, line) of every attribute line of the resources in (path, text).

    attribute is the key behind the names of the blocks that it stands in. Braces outside quotes
    are counted over a file's lines; the count does not fall below zero. What stands between an
    outermost opening brace and its end belongs to that opening, if it is a resource's. The block
    around an attribute, at each level, is the last one opened there before it.
    """
    by = W.partitionBy("path").orderBy("line")
    so_far = by.rowsBetween(W.unboundedPreceding, 0)
    rows = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("at", "raw")).select("path", (F.col("at") + 1).cast("long").alias("line"), F.trim(uncommented(F.col("raw"))).alias("t"))
    bare = F.regexp_replace("t", '"[^"]*"', "")
    step = F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, r"[^}]", ""))
    rows = rows.withColumn("step", step).withColumn("sum", F.sum("step").over(so_far))
    rows = rows.withColumn("after", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far))).withColumn("depth", F.coalesce(F.lag("after").over(by), F.lit(0)))
    opens = F.col("after") > F.col("depth")
    head = r'^resource\s+"([^"]*)"\s+"([^"]*)"'
    outer = F.when(opens & (F.col("depth") == 0), F.struct(F.nullif(F.regexp_extract("t", head, 1), F.lit("")).alias("kind"), F.regexp_extract("t", head, 2).alias("name"), F.col("line").alias("resource_line")))
    rows = rows.withColumn("o", F.last(outer, ignorenulls=True).over(so_far)).where((F.col("depth") > 0) & F.col("o.kind").isNotNull())
    label = F.regexp_extract("t", r"^\"?([A-Za-z0-9_-]+)", 1)
    assigned = r"^([^=]+?)\s*=\s*(.*)$"
    found = rows.where(F.rlike("t", F.lit(assigned)) & ~F.endswith("t", F.lit("{"))).select("path", "line", "depth", "o", F.regexp_replace(F.regexp_extract("t", assigned, 1), '"', "").alias("key"), F.regexp_replace(F.trim(F.regexp_extract("t", assigned, 2)), '^"+|"+$', "").alias("value"))
    marks = rows.where(opens).select("path", F.col("depth").alias("level"), "line", label.alias("label"))
    inside = found.where("depth > 1").select("path", "line", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("level"))
    above = marks.unionByName(inside.withColumn("label", F.lit(None).cast("string"))).withColumn("around", F.last("label", ignorenulls=True).over(W.partitionBy("path", "level").orderBy("line", F.col("label").isNull()).rowsBetween(W.unboundedPreceding, 0)))
    paths = above.where("label IS NULL").groupBy("path", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "around"))), lambda x: x["around"]), ".").alias("inside"))
    whole = F.concat_ws(".", "inside", "key")
    return found.join(paths, ["path", "line"], "left").select("path", "o.kind", "o.name", "o.resource_line", whole.alias("attribute"), "key", "value", "line")


def said(grammar: str, text: str | None) -> dict:
    if grammar == "policy":
        policy = names.tls_policy(text)
        return {"version": policy[0], "quantum": policy[1]} if policy else {"version": names.protocol_version(text), "quantum": False}
    return names.key_spec(text) or names.resolve(text) or {}


def meanings(texts: DataFrame) -> DataFrame:
    """(grammar, value, v) of distinct (grammar, value); each is read once."""

    @F.pandas_udf(ALGORITHM)
    def each(grammar: pd.Series, value: pd.Series) -> pd.DataFrame:
        fields = re.findall(r"(\w+):", ALGORITHM.removeprefix("struct<"))
        out = pd.DataFrame([said(g, t) for g, t in zip(grammar, value, strict=True)], columns=fields)
        return out.astype({"key_bits": "Int32", "quantum": "boolean"}).astype({f: object for f in fields if f not in ("key_bits", "quantum")})

    return texts.distinct().withColumn("v", each("grammar", "value"))


def curve(name: Column) -> Column:
    """A curve by any of its names; there are a few dozen."""
    table = F.create_map(*(F.lit(x) for kv in names.curves().items() for x in kv))
    return table[F.lower(F.regexp_replace(name, r"[-_ /.]", ""))]


def resources(attributes: DataFrame) -> DataFrame:
    """(path, kind, name, resource_line, given) with a resource's attributes by name: value and line; of several lines the last counts."""
    last = attributes.groupBy("path", "kind", "name", "resource_line", "key").agg(F.max(F.struct("line", "value")).alias("v"))
    return last.groupBy("path", "kind", "name", "resource_line").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("given"))


def of(name: str) -> Column:
    return F.try_element_at("given", F.lit(name))


def findings(resources: DataFrame) -> DataFrame:
    """(path, rule_id, token, line, alg_id, key_bits, parameter_set, curve, mode, padding, digest, version, listener) that resources' attributes declare.

    Key specifications, keys by type with size or curve, managed policies and least versions (a
    hybrid policy also declares its group), and balancer listeners.
    """
    one = lambda a, grammar: F.when(of(a).isNotNull(), F.struct(F.lit(a).alias("attribute"), F.lit(grammar).alias("grammar"), of(a)["value"].alias("value"), of(a)["line"].alias("line")))
    asked = [one(a, "key") for a in KEY_ATTRIBUTES] + [one(a, "policy") for a in POLICY_ATTRIBUTES]
    rows = resources.select("path", "kind", "given", F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("q")).select("path", "kind", "given", "q.*")
    rows = rows.join(meanings(rows.select("grammar", "value")), ["grammar", "value"])
    own = F.col("kind") == "tls_private_key"
    bits = F.when(own & of("rsa_bits").isNotNull(), of("rsa_bits")["value"].cast("int")).otherwise(F.col("v.key_bits"))
    elliptic = own & of("ecdsa_curve").isNotNull()
    plain = lambda f: F.when(~elliptic, F.col(f"v.{f}"))
    key = F.struct(F.when(elliptic, "ecdsa").otherwise(F.col("v.alg_id")).alias("alg_id"), F.when(~elliptic, bits).alias("key_bits"), plain("parameter_set").alias("parameter_set"), F.when(elliptic, curve(of("ecdsa_curve")["value"])).otherwise(F.col("v.curve")).alias("curve"), *(plain(f).alias(f) for f in ("mode", "padding", "digest")), F.lit(None).cast("string").alias("version"), F.lit(False).alias("listener"))
    nothing = {f: F.lit(None).cast("string") for f in ("parameter_set", "curve", "mode", "padding", "digest")}
    said_of = lambda **given: F.struct(*(given.get(f, d).alias(f) for f, d in ({"alg_id": F.lit(None).cast("string"), "key_bits": F.lit(None).cast("int")} | nothing | {"version": F.lit(None).cast("string"), "listener": F.lit(False)}).items()))
    version = F.when(F.col("v.version").isNotNull(), said_of(version=F.col("v.version")))
    hybrid = F.when(F.col("v.quantum"), said_of(alg_id=F.lit("x25519-mlkem768")))
    found = F.when(F.col("grammar") == "key", F.array(F.when(F.col("v.alg_id").isNotNull(), key))).otherwise(F.array(version, hybrid))
    named = rows.select("path", "kind", "attribute", "line", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    kind_of = F.upper(of("key_type")["value"])
    typed = resources.where(of("key_type").isNotNull()).select("path", "kind", F.lit("key_type").alias("attribute"), of("key_type")["line"].alias("line"), F.when(F.startswith(kind_of, F.lit("RSA")), said_of(alg_id=F.lit("rsa"), key_bits=of("key_size")["value"].try_cast("int"))).when(F.startswith(kind_of, F.lit("EC")), said_of(alg_id=F.lit("ecdsa"), curve=curve(of("curve")["value"]))).alias("f")).where("f IS NOT NULL")
    protocol = of("protocol")
    listens = resources.where(F.col("kind").isin("aws_lb_listener", "aws_alb_listener") & protocol["value"].isin("HTTPS", "TLS")).select("path", "kind", F.lit("protocol").alias("attribute"), protocol["line"].alias("line"), said_of(listener=F.lit(True)).alias("f"))
    every = named.unionByName(typed).unionByName(listens)
    return every.select("path", F.concat(F.lit("config.terraform."), "kind").alias("rule_id"), F.concat_ws(".", "kind", "attribute").alias("token"), "line", "f.*")


def keys(resources: DataFrame) -> DataFrame:
    """(path, kind, name, line, custody, material, usage, alg_id, key_bits, curve, detail) of keys that cloud key services hold.

    Of the attributes that name an algorithm the first that does counts, then the type with size or
    curve, then the service's default, a symmetric key.
    """
    value = lambda a: of(a)["value"]
    rows = resources.where(F.col("kind").isin(list(SERVICES)))
    asked = rows.select(F.explode(F.array(*(value(a) for a in KEY_ATTRIBUTES[:3]))).alias("value")).where("value IS NOT NULL").select(F.lit("key").alias("grammar"), "value")
    known = meanings(asked).where("v.alg_id IS NOT NULL").select("value", F.struct("v.alg_id", "v.key_bits", "v.curve").alias("v"))
    for i, a in enumerate(KEY_ATTRIBUTES[:3]):
        rows = rows.withColumn("__text", value(a)).join(known.select(F.col("value").alias("__text"), F.col("v").alias(f"v{i}")), "__text", "left").drop("__text")
    what = lambda alg, bits=None, curve=None: F.struct(F.lit(alg).alias("alg_id"), (F.lit(None).cast("int") if bits is None else bits).alias("key_bits"), (F.lit(None).cast("string") if curve is None else curve).alias("curve"))
    kind_of = F.upper(value("key_type"))
    typed = F.when(F.startswith(kind_of, F.lit("RSA")), what("rsa", value("key_size").try_cast("int"))).when(F.startswith(kind_of, F.lit("EC")), what("ecdsa", curve=curve(value("curve"))))
    default = F.when((F.col("kind") == "aws_kms_key") | (F.col("kind") == "google_kms_crypto_key") & (F.coalesce(value("purpose"), F.lit("ENCRYPT_DECRYPT")) == "ENCRYPT_DECRYPT"), what("aes", F.lit(256)))
    hardware = (
        F.when(F.col("kind") == "aws_kms_key", value("custom_key_store_id").isNotNull()).when(F.col("kind") == "google_kms_crypto_key", F.upper(value("protection_level")) == "HSM").otherwise(F.endswith(kind_of, F.lit("-HSM")))
    )
    uses = F.filter(F.transform(F.array(*(F.lower(value(a)) for a in ("key_usage", "purpose", "key_opts"))), lambda u: F.when(F.contains(u, F.lit("sign")), "sign").when(F.contains(u, F.lit("decrypt")) | F.contains(u, F.lit("unwrap")), "encrypt")), lambda u: u.isNotNull())
    service = F.create_map(*(F.lit(x) for kv in SERVICES.items() for x in kv))[F.col("kind")]
    rows = rows.withColumn("a", F.coalesce("v0", "v1", "v2", typed, default))
    symmetric = F.coalesce(F.col("a.alg_id").isin([x[0] for x in names.ALGORITHMS if x[2] in ("block-cipher", "ae", "mac")]), F.lit(False))
    return rows.select(
        "path", "kind", "name", F.col("resource_line").alias("line"), F.when(F.coalesce(hardware, F.lit(False)), "cloud-hsm").otherwise("cloud-kms").alias("custody"), F.when(symmetric, "secret-key").otherwise("private-key").alias("material"),
        F.try_element_at(uses, F.lit(1)).alias("usage"), "a.alg_id", "a.key_bits", "a.curve", F.concat(service, F.lit(" key "), "kind", F.lit("."), "name").alias("detail"),
    )
