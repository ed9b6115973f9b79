"""Keys in files beside certificates: public keys, OpenSSH lines, and key stores."""

from __future__ import annotations

import base64
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postura.sources.readers import children, oid, tlv

# Identifiers of key algorithms and curves, and of what a PKCS #12 store holds.
KEY_OIDS = {
    "1.2.840.113549.1.1.1": "rsa", "1.2.840.10040.4.1": "dsa", "1.2.840.10045.2.1": "ecdsa", "1.3.101.110": "x25519", "1.3.101.111": "x448", "1.3.101.112": "ed25519", "1.3.101.113": "ed448",
    "2.16.840.1.101.3.4.4.1": "ml-kem", "2.16.840.1.101.3.4.4.2": "ml-kem", "2.16.840.1.101.3.4.4.3": "ml-kem", "2.16.840.1.101.3.4.3.17": "ml-dsa", "2.16.840.1.101.3.4.3.18": "ml-dsa", "2.16.840.1.101.3.4.3.19": "ml-dsa",
}
CURVE_OIDS = {"1.2.840.10045.3.1.7": "P-256", "1.3.132.0.34": "P-384", "1.3.132.0.35": "P-521", "1.3.132.0.10": "secp256k1"}
SETS = {"2.16.840.1.101.3.4.4.1": "512", "2.16.840.1.101.3.4.4.2": "768", "2.16.840.1.101.3.4.4.3": "1024", "2.16.840.1.101.3.4.3.17": "44", "2.16.840.1.101.3.4.3.18": "65", "2.16.840.1.101.3.4.3.19": "87"}
BAGS = {"1.2.840.113549.1.12.10.1.1": "private-key", "1.2.840.113549.1.12.10.1.2": "private-key", "1.2.840.113549.1.12.10.1.3": "certificate", "1.2.840.113549.1.12.10.1.5": "secret-key"}
SSH_KINDS = {"ssh-rsa": "rsa", "ssh-dss": "dsa", "ssh-ed25519": "ed25519", "ssh-ed448": "ed448", "ecdsa-sha2-nistp256": "ecdsa", "ecdsa-sha2-nistp384": "ecdsa", "ecdsa-sha2-nistp521": "ecdsa"}
JKS, JCEKS = 0xFEEDFEED, 0xCECECECE
KEY = "struct<kind:string,alg_id:string,key_bits:int,parameter_set:string,curve:string,encrypted:boolean,alias:string>"
FIELDS = [f.split(":")[0] for f in KEY[7:-1].split(",")]


def key(kind: str, alg: str | None = None, bits: int | None = None, parameter_set: str | None = None, curve: str | None = None, encrypted: bool = False, alias: str | None = None) -> dict:
    return dict(zip(FIELDS, (kind, alg, bits, parameter_set, curve, encrypted, alias), strict=True))


def bits_of(data: bytes) -> int:
    return int.from_bytes(data, "big").bit_length()


def public_key(der: bytes) -> dict | None:
    """A subject's public key: algorithm, and bits or curve or set."""
    _, a, b = tlv(der)
    algorithm, string = children(der, a, b)
    parts = children(der, *algorithm[1:])
    name = oid(der[parts[0][1] : parts[0][2]])
    if name not in KEY_OIDS:
        return None
    found = key("public-key", KEY_OIDS[name], parameter_set=SETS.get(name))
    if found["alg_id"] == "rsa":
        _, c, e = tlv(der, string[1] + 1)
        modulus = children(der, c, e)[0]
        found["key_bits"] = bits_of(der[modulus[1] : modulus[2]])
    elif found["alg_id"] == "dsa" and len(parts) > 1:
        prime = children(der, *parts[1][1:])[0]
        found["key_bits"] = bits_of(der[prime[1] : prime[2]])
    elif found["alg_id"] == "ecdsa" and len(parts) > 1 and parts[1][0] == 6:
        found["curve"] = CURVE_OIDS.get(oid(der[parts[1][1] : parts[1][2]]))
    return found


def ssh_key(line: str) -> dict | None:
    """A line of a public key or of authorized_keys, options before it or not; the blob has to say the same as the line."""
    words = line.split()
    at = next((i for i, w in enumerate(words) if w in SSH_KINDS and i + 1 < len(words)), None)
    if at is None:
        return None
    blob, parts = base64.b64decode(words[at + 1], validate=True), []
    while blob:
        n = struct.unpack(">I", blob[:4])[0]
        if n > len(blob) - 4:
            return None
        parts.append(blob[4 : 4 + n])
        blob = blob[4 + n :]
    if not parts or parts[0].decode() != words[at]:
        return None
    alg = SSH_KINDS[words[at]]
    bits = bits_of(parts[2]) if alg == "rsa" else bits_of(parts[1]) if alg == "dsa" else None
    curve = {"nistp256": "P-256", "nistp384": "P-384", "nistp521": "P-521"}.get(parts[1].decode()) if alg == "ecdsa" else None
    return key("public-key", alg, bits, curve=curve, alias=" ".join(words[at + 2 :]) or None)


def java_store(data: bytes) -> list[dict] | None:
    """Entries of a Java key store: private and secret keys, which it encrypts, and trusted certificates."""
    magic, version, count = struct.unpack(">III", data[:12])
    if magic not in (JKS, JCEKS) or version not in (1, 2):
        return None
    at, out = 12, []

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("cut short")
        at += n
        return data[at - n : at]

    number = lambda: struct.unpack(">I", take(4))[0]
    text = lambda: take(struct.unpack(">H", take(2))[0]).decode("utf-8", "replace")

    def certificate() -> None:
        if version == 2:
            text()
        take(number())

    for _ in range(count):
        tag, alias = number(), text()
        take(8)  # its date
        if tag == 1:
            take(number())
            for _ in range(number()):
                certificate()
            out.append(key("private-key", encrypted=True, alias=alias))
        elif tag == 2:
            certificate()
            out.append(key("certificate", alias=alias))
        else:  # a sealed object, whose length it doesn't tell
            return [*out, key("secret-key", encrypted=True, alias=alias)]
    return out


def pkcs12(data: bytes) -> list[dict] | None:
    """What a PKCS #12 store holds: bags that stand open, and encrypted parts."""
    tag, a, b = tlv(data)
    version, content, *_ = children(data, a, b)
    if tag != 0x30 or data[version[1] : version[2]] != b"\x03":
        return None
    kind, inner = children(data, *content[1:])
    if oid(data[kind[1] : kind[2]]) != "1.2.840.113549.1.7.1":
        return [key("key-store", encrypted=True)]
    octets = children(data, *inner[1:])[0]
    out = []
    for safe in children(data, *children(data, octets[1], octets[2])[0][1:]):
        form, *rest = children(data, *safe[1:])
        if oid(data[form[1] : form[2]]) != "1.2.840.113549.1.7.1":
            out.append(key("key-store", encrypted=True))
            continue
        bags = children(data, *rest[0][1:])[0]
        for bag in children(data, *children(data, bags[1], bags[2])[0][1:]):
            name = oid(data[children(data, *bag[1:])[0][1] : children(data, *bag[1:])[0][2]])
            out.append(key(BAGS.get(name, "other"), encrypted=name.endswith("10.1.2")))
    return out


def quietly(read, data) -> list[dict]:
    """What a reader finds; nothing if the data are cut short or something else."""
    try:
        found = read(data)
    except (ValueError, IndexError, TypeError, struct.error, UnicodeDecodeError):
        return []
    return found if isinstance(found, list) else [found] if found else []


def found_in(data: bytes | None) -> list[dict]:
    """The keys of one file's bytes: a store, a public key in DER, or lines of OpenSSH."""
    if not data:
        return []
    if len(data) > 12 and struct.unpack(">I", data[:4])[0] in (JKS, JCEKS):
        return quietly(java_store, data)
    if data[0] == 0x30:
        return quietly(pkcs12, data) or quietly(public_key, data)
    lines = data.decode("utf-8", "replace").splitlines() if any(k.encode() in data for k in SSH_KINDS) else []
    return [k for line in lines if not line.lstrip().startswith("#") for k in quietly(ssh_key, line)]


def keys(files: DataFrame) -> DataFrame:
    """(path, fingerprint, kind, alg_id, key_bits, parameter_set, curve, encrypted, alias) of (path, content) and of PEM blocks' (path, der).

    Each different content is read once; a file over the readers' limit has null content and gives none.
    """
    column = "der" if "der" in files.columns else "content"

    @F.pandas_udf(f"array<{KEY}>")
    def read(contents: pd.Series) -> pd.Series:
        return pd.Series([found_in(c) for c in contents])

    rows = files.select("path", F.col(column).alias("content"), F.sha2(column, 256).alias("fingerprint")).where("content is not null")
    known = rows.dropDuplicates(["fingerprint"]).select("fingerprint", F.explode(read("content")).alias("k"))
    return rows.select("path", "fingerprint").join(known, "fingerprint").select("path", "fingerprint", "k.*")
