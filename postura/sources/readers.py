"""Readers of evidence: files below a folder, configuration, packages, PEM blocks, trace and inventory documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that hold no evidence of their own.
SKIPPED = [".git", ".hg", ".svn", ".tox", ".venv", "__pycache__", "build", "dist", "target", "out", ".idea"]
DEPENDENCIES = ["node_modules", "vendor", "third_party", "site-packages", "bower_components", "Pods"]
LARGEST = 16 * 1024 * 1024


def files(spark: SparkSession, root: str, dependencies: bool = False, largest: int = LARGEST, since: str | None = None) -> DataFrame:
    """(path, size, content) below a folder; content is null for files over the limit, which are neither cut nor opened.

    The limit on size, and since (files changed from then on), are filters that reach the source:
    files that pass are read, of the others the listing alone, as no other column is asked for.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if since is not None:
        rows = rows.where(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    parts = F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), "/")
    skipped = SKIPPED + ([] if dependencies else DEPENDENCIES)
    rows = rows.where(~F.arrays_overlap(parts, F.array(*map(F.lit, skipped))))
    read = rows.where(F.col("length") <= largest).select("path", F.col("length").alias("size"), "content")
    listed = rows.where(F.col("length") > largest).select("path", F.col("length").alias("size"), F.lit(None).cast("binary").alias("content"))
    return read.unionAll(listed)


def text(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def lines(files: DataFrame, column: str = "text") -> DataFrame:
    """(path, line, text): lines of each file from 1, without comments and blank ones."""
    rows = files.select("path", F.posexplode(F.split(column, r"\r?\n")).alias("at", "raw"))
    clean = F.trim(F.regexp_replace("raw", r"(^|\s)#.*$", ""))
    return rows.select("path", (F.col("at") + 1).cast("long").alias("line"), clean.alias("text")).where("text <> ''")


def config_format(path: Column) -> Column:
    """How a configuration file is written, by its name; null if it is none."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"(package-lock\.json|yarn\.lock|cargo\.lock|poetry\.lock)$"), F.lit(None))
        .when(p.rlike(r"\.tf$"), "terraform").when(p.rlike(r"\.ya?ml$"), "yaml").when(p.rlike(r"\.json$"), "json").when(p.rlike(r"\.toml$"), "toml")
        .when(p.rlike(r"\.(properties|ini|env)$|/\.env"), "key-value").when(p.rlike(r"(nginx|httpd|apache|haproxy|openssl|sshd?_config|postgresql|redis|my|dovecot|stunnel)[^/]*(\.conf|\.cnf|\.cfg)?$"), "directives")
    )


# Directives, and what they set.
DIRECTIVES = [
    ("ssl_protocols", "versions"), ("sslprotocol", "versions"), ("minprotocol", "versions"), ("ssl_min_protocol_version", "versions"), ("tls-protocols", "versions"),
    ("ssl_ciphers", "suites"), ("sslciphersuite", "suites"), ("cipherstring", "suites"), ("ssl-default-bind-ciphers", "suites"), ("tls-ciphers", "suites"), ("ciphersuites", "suites"),
    ("ssl_ecdh_curve", "groups"), ("groups", "groups"), ("sslopensslconfcmd", "groups"), ("ssl-default-bind-curves", "groups"),
    ("kexalgorithms", "ssh"), ("ciphers", "ssh"), ("macs", "ssh"), ("hostkeyalgorithms", "ssh"),
    ("listen", "listener"), ("bind", "listener"), ("port", "listener"), ("ssl_certificate", "served"), ("sslcertificatefile", "served"), ("server_name", "host"), ("servername", "host"),
]


def directives(files: DataFrame) -> DataFrame:
    """(path, line, setting, value): values that known directives set, one row each; removals ('-X', '!X') are left out."""
    known = files.sparkSession.createDataFrame(DIRECTIVES, "directive string, setting string")
    rows = lines(files).select("path", "line", F.regexp_extract("text", r"^([A-Za-z_-]+)[\s=]+(.*?);?$", 1).alias("word"), F.regexp_extract("text", r"^([A-Za-z_-]+)[\s=]+(.*?);?$", 2).alias("rest"))
    hits = rows.join(F.broadcast(known), F.lower("word") == F.col("directive"))
    values = F.split(F.regexp_replace("rest", "[\"']", ""), r"[\s:,]+")
    return hits.select("path", "line", "setting", F.explode(values).alias("value")).where(~F.rlike("value", F.lit("^[-!]")) & (F.col("value") != ""))


def key_values(files: DataFrame) -> DataFrame:
    """(path, line, key, value) of key = value and key: value lines, keys with their sections and the keys that they are indented below.

    For flat files, sections as in INI and TOML, and block style YAML: a file's lines are
    folded once, with a stack of the keys that are open. List items keep the key above them.
    Keys with a part that begins with 'disabled' are left out. Flow style is not taken apart.
    """
    stack = "array<struct<indent:int,key:string>>"
    pairs = "array<struct<line:bigint,key:string,value:string>>"
    raw = F.transform(F.split("text", r"\r?\n"), lambda x, i: F.struct(F.regexp_replace(x, r"(^|\s)#.*$", "").alias("text"), (i + 1).cast("long").alias("line")))
    unquoted = lambda c: F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")

    def step(acc: Column, x: Column) -> Column:
        line = x["text"]
        section = F.regexp_extract(line, r"^\s*\[+\s*([^\[\]]+?)\s*\]+\s*$", 1)
        found = r"^(\s*(?:- +)?)[\"']?([A-Za-z0-9_.-]+)[\"']?\s*(?:=|:(?=\s|$))\s*(.*)$"
        indent, key, value = F.length(F.regexp_extract(line, found, 1)), F.regexp_extract(line, found, 2), unquoted(F.regexp_extract(line, found, 3))
        above = F.filter(acc["open"], lambda o: o["indent"] < indent)
        whole = F.array_join(F.concat(F.when(acc["section"] != "", F.array(acc["section"])).otherwise(F.expr("cast(array() as array<string>)")), F.transform(above, lambda o: o["key"]), F.array(key)), ".")
        nothing = F.expr(f"cast(array() as {stack})")
        opened = F.when(key == "", acc["open"]).otherwise(F.concat(above, F.array(F.struct(indent.alias("indent"), key.alias("key")))))
        pair = F.struct(x["line"].alias("line"), whole.alias("key"), value.alias("value"))
        return F.struct(
            F.when(section != "", unquoted(section)).otherwise(acc["section"]).alias("section"), F.when(section != "", nothing).otherwise(opened).alias("open"),
            F.when((section == "") & (key != "") & (value != ""), F.concat(acc["pairs"], F.array(pair))).otherwise(acc["pairs"]).alias("pairs"),
        )

    start = F.struct(F.lit("").alias("section"), F.expr(f"cast(array() as {stack})").alias("open"), F.expr(f"cast(array() as {pairs})").alias("pairs"))
    rows = files.select("path", F.explode(F.aggregate(raw, start, step, lambda acc: acc["pairs"])).alias("p")).select("path", "p.*")
    return rows.where(~F.rlike("key", F.lit(r"(?i)(^|\.)disabled")))


def json_leaves(text: str | None) -> list[dict] | None:
    """key and value of a JSON text's leaves that are not null; None if it is no object or list."""
    try:
        top = json.loads(text or "", parse_float=str, parse_int=str, parse_constant=str)
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, dict | list):
        return None
    out, todo = [], [("", top)]
    while todo:
        at, value = todo.pop()
        if isinstance(value, dict | list):
            inside = value.items() if isinstance(value, dict) else enumerate(value)
            todo += [(f"{at}.{k}" if at else str(k), v) for k, v in inside][::-1]
        elif value is not None:
            out.append({"key": at, "value": str(value).lower() if isinstance(value, bool) else value})
    return out


def json_values(files: DataFrame) -> DataFrame:
    """(path, key, value): the leaves of JSON texts, with the path of names and places from 0 that leads to them, in one pass over each text.

    A text that is no JSON, or nested deeper than the reader can go (some thousand levels), has
    no leaves; the others keep theirs.
    """

    @F.pandas_udf("array<struct<key:string,value:string>>")
    def leaves(texts: pd.Series) -> pd.Series:
        return pd.Series([json_leaves(t) for t in texts], dtype=object)

    return files.select("path", F.explode(leaves("text")).alias("e")).select("path", "e.*")


def packages(files: DataFrame) -> DataFrame:
    """(path, name, version) of installed packages, from the blocks of dpkg's status or apk's database."""
    block = F.explode(F.split("text", r"\n\s*\n")).alias("block")
    field = lambda name: F.regexp_extract("block", rf"(?m)^{name}:\s*(.*)$", 1)
    rows = files.select("path", block).select("path", "block", field("Package").alias("d"), field("P").alias("a"), field("Version").alias("dv"), field("V").alias("av"), field("Status").alias("status"))
    rows = rows.where("(d <> '' AND status LIKE '%installed%' AND status NOT LIKE '%not-installed%') OR (d = '' AND a <> '')")
    version = F.when(F.col("d") != "", F.col("dv")).otherwise(F.col("av"))
    return rows.select("path", F.when(F.col("d") != "", F.col("d")).otherwise(F.col("a")).alias("name"), F.regexp_replace(F.regexp_replace(version, r"^\d+:", ""), r"[-+~].*$", "").alias("version"))


# PEM labels, and what they hold.
LABELS = {
    "CERTIFICATE": "certificate", "PRIVATE KEY": "private-key", "RSA PRIVATE KEY": "private-key", "EC PRIVATE KEY": "private-key", "DSA PRIVATE KEY": "private-key",
    "OPENSSH PRIVATE KEY": "private-key", "ENCRYPTED PRIVATE KEY": "private-key", "PUBLIC KEY": "public-key", "RSA PUBLIC KEY": "public-key", "CERTIFICATE REQUEST": "request",
}


def pem_blocks(files: DataFrame) -> DataFrame:
    """(path, label, kind, encrypted, der, fingerprint) of every PEM block of the texts."""
    pattern = r"-----BEGIN ([A-Z0-9 ]+)-----([\s\S]*?)-----END \1-----"
    every = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("body"))
    rows = files.select("path", F.explode(every).alias("b")).select("path", "b.*")
    kinds = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    headers = F.contains("body", F.lit("Proc-Type: 4,ENCRYPTED"))
    der = F.try_to_binary(F.regexp_replace(F.regexp_replace("body", r"(?m)^[A-Za-z-]+:.*$", ""), r"\s", ""), F.lit("base64"))
    return rows.select("path", "label", kinds[F.col("label")].alias("kind"), (headers | F.startswith("label", F.lit("ENCRYPTED"))).alias("encrypted"), der.alias("der")).withColumn("fingerprint", F.sha2("der", 256))


def tlv(data: bytes, at: int = 0) -> tuple[int, int, int]:
    """(tag, start of the value, end) of the DER element at a place."""
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 128:
        size = n & 127
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    if at + n > len(data):
        raise ValueError("cut short")
    return tag, at, at + n


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while start < end:
        out.append(tlv(data, start))
        start = out[-1][2]
    return out


def oid(data: bytes) -> str:
    """Dotted form of an object identifier."""
    numbers, n = [], 0
    for b in data:
        n = n << 7 | b & 127
        if b < 128:
            numbers.append(n)
            n = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]]))


def certificate(der: bytes | None) -> dict | None:
    """Validity, key and signature algorithms, key size and serial of an X.509 certificate; None if it is none."""
    try:
        _, a, b = tlv(der)
        body, signature, _ = children(der, a, b)
        fields = children(der, *body[1:])
        fields = fields[1:] if fields[0][0] == 0xA0 else fields
        serial, _, issuer, validity, subject, key = fields[:6]
        begin, end = (der[x[1] : x[2]].decode() if x[0] == 0x18 else ("19" if der[x[1] : x[1] + 2] >= b"50" else "20") + der[x[1] : x[2]].decode() for x in children(der, *validity[1:]))
        algorithm, bits = children(der, *key[1:])
        kind = children(der, *algorithm[1:])
        size = None
        if oid(der[kind[0][1] : kind[0][2]]) == "1.2.840.113549.1.1.1":
            _, c, e = tlv(der, bits[1] + 1)
            modulus = children(der, c, e)[0]
            size = int.from_bytes(der[modulus[1] : modulus[2]], "big").bit_length()
        sign = children(der, *signature[1:])[0]
        return {
            "serial": der[serial[1] : serial[2]].hex(), "not_before": begin, "not_after": end, "key_oid": oid(der[kind[0][1] : kind[0][2]]), "key_bits": size,
            "curve_oid": oid(der[kind[1][1] : kind[1][2]]) if len(kind) > 1 and kind[1][0] == 6 else None, "signature_oid": oid(der[sign[1] : sign[2]]),
            "self_issued": der[issuer[1] : issuer[2]] == der[subject[1] : subject[2]],
        }
    except (ValueError, IndexError, TypeError, UnicodeDecodeError):
        return None


CERTIFICATE = "struct<serial:string,not_before:string,not_after:string,key_oid:string,key_bits:int,curve_oid:string,signature_oid:string,self_issued:boolean>"


def certificates(blocks: DataFrame) -> DataFrame:
    """The certificates among PEM blocks, with their fields; each distinct one is read once."""

    @F.pandas_udf(CERTIFICATE)
    def read(ders: pd.Series) -> pd.DataFrame:
        names = [x.split(":")[0] for x in CERTIFICATE[7:-1].split(",")]
        return pd.DataFrame([certificate(d) or dict.fromkeys(names) for d in ders], columns=names).astype({"key_bits": "Int32", "self_issued": "boolean"})

    own = blocks.where("kind = 'certificate'")
    known = own.select("fingerprint", "der").dropDuplicates(["fingerprint"]).select("fingerprint", read("der").alias("c"))
    return own.join(known, "fingerprint").where("c.serial IS NOT NULL").select("path", "fingerprint", "c.*")


TRACE = "struct<format:string,started:string,durationSeconds:bigint,libraries:array<string>,events:array<struct<executable:string,library:string,function:string,kind:string,value:string,count:bigint>>,ignoredSetupCalls:bigint>"


def trace_documents(files: DataFrame) -> DataFrame:
    """(path, executable, library, function, kind, value, count) of trace documents in JSON."""
    return files.select("path", F.from_json("text", TRACE).alias("t")).select("path", F.explode("t.events").alias("e")).select("path", "e.*")


INVENTORY = "struct<components:array<struct<`bom-ref`:string,name:string,type:string,properties:array<struct<name:string,value:string>>>>,dependencies:array<struct<ref:string,dependsOn:array<string>>>>"


def inventories(files: DataFrame) -> DataFrame:
    """(path, asset_id, name, component, tier) of archived inventories, as comparing needs them."""
    rows = files.select("path", F.from_json("text", INVENTORY).alias("d")).select("path", F.explode("d.components").alias("c"))
    value = lambda name: F.try_element_at(F.filter("c.properties", lambda p: p["name"] == name), F.lit(1))["value"]
    return rows.select("path", F.col("c.bom-ref").alias("asset_id"), F.col("c.name").alias("name"), value("component").alias("component"), value("tier").alias("tier"))


def reports(files: DataFrame) -> DataFrame:
    """(path, asset_id, component, tier, priority, ...) of report documents (path, text): a row of JSON a line, as sinks.documents.report writes them; other lines are left out."""
    from postura.sinks.documents import PROPERTIES

    schema = "asset_id string, " + ", ".join(f"{p} {REPORTED.get(p, 'string')}" for p in PROPERTIES)
    rows = files.select("path", F.explode(F.split("text", r"\r?\n")).alias("line")).select("path", F.from_json("line", schema).alias("r"))
    return rows.where("r.asset_id is not null").select("path", "r.*")


#: Columns of a report that are no texts.
REPORTED = {"priority": "int", "confidence": "double", "qb": "double", "agility": "int", "exposure_index": "double", "effort": "double"}
