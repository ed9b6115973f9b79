"""Keys in files: each planted one gives kind, algorithm and bits."""

import base64
import struct

import pytest

from postura.sources import keys, readers
from postura.storage import LEFT, release, written


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 | (len(body).bit_length() + 7) // 8]) + len(body).to_bytes((len(body).bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def name(dotted):
    a, b, *rest = map(int, dotted.split("."))
    out = b""
    for n in (40 * a + b, *rest):
        part = [n & 127]
        while n := n >> 7:
            part.append(n & 127 | 128)
        out += bytes(reversed(part))
    return der(6, out)


def spki(algorithm, key, parameters=b""):
    return der(0x30, der(0x30, name(algorithm), parameters), der(3, b"\0" + key))


RSA = spki("1.2.840.113549.1.1.1", der(0x30, number((1 << 2047) + 9), number(65537)), der(5))
EC = spki("1.2.840.10045.2.1", b"\4" + bytes(96), name("1.3.132.0.34"))


def ssh(kind, *parts):
    blob = b"".join(struct.pack(">I", len(p)) + p for p in (kind.encode(), *parts))
    return f"{kind} {base64.b64encode(blob).decode()}"


def java_store(*entries):
    out = struct.pack(">III", keys.JKS, 2, len(entries))
    text = lambda s: struct.pack(">H", len(s)) + s.encode()
    certificate = text("X.509") + struct.pack(">I", 5) + b"certs"
    for tag, alias in entries:
        out += struct.pack(">I", tag) + text(alias) + bytes(8)
        out += struct.pack(">I", 3) + b"key" + struct.pack(">I", 2) + certificate * 2 if tag == 1 else certificate
    return out + bytes(20)


def pkcs12(*bags, sealed=True):
    data, cipher = "1.2.840.113549.1.7.1", "1.2.840.113549.1.7.6"
    octets = lambda x: der(0xA0, der(4, x))
    safe = der(0x30, name(data), octets(der(0x30, *(der(0x30, name(b), der(0xA0, der(4, b"x"))) for b in bags))))
    parts = [safe] + [der(0x30, name(cipher), der(0xA0, der(4, b"secret")))] * sealed
    return der(0x30, number(3), der(0x30, name(data), octets(der(0x30, *parts))))


FILES = {
    "rsa.der": (RSA, [("public-key", "rsa", 2048, None, None, False, None)]), "ec.der": (EC, [("public-key", "ecdsa", None, None, "P-384", False, None)]),
    "ed.der": (spki("1.3.101.112", bytes(32)), [("public-key", "ed25519", None, None, None, False, None)]), "pq.der": (spki("2.16.840.1.101.3.4.4.2", bytes(99)), [("public-key", "ml-kem", None, "768", None, False, None)]),
    "dsa.der": (spki("1.2.840.10040.4.1", number(5), der(0x30, number((1 << 1023) + 1), number(7), number(2))), [("public-key", "dsa", 1024, None, None, False, None)]),
    "authorized_keys": (
        ("# " + ssh("ssh-ed25519", bytes(32)) + "\n" + ssh("ssh-rsa", b"\1\0\1", ((1 << 3071) + 1).to_bytes(385, "big")) + " me@host\nno-pty,command=\"x y\" " + ssh("ecdsa-sha2-nistp256", b"nistp256", bytes(65)) + "\nssh-rsa AAAA\nssh-rsa !!\n").encode(),
        [("public-key", "rsa", 3072, None, None, False, "me@host"), ("public-key", "ecdsa", None, None, "P-256", False, None)],
    ),
    "store.jks": (java_store((1, "tls"), (2, "ca"), (3, "aes")), [("private-key", None, None, None, None, True, "tls"), ("certificate", None, None, None, None, False, "ca"), ("secret-key", None, None, None, None, True, "aes")]),
    "store.p12": (pkcs12("1.2.840.113549.1.12.10.1.2", "1.2.840.113549.1.12.10.1.3"), [("private-key", None, None, None, None, True, None), ("certificate", None, None, None, None, False, None), ("key-store", None, None, None, None, True, None)]),
}


def test_planted_keys(spark):
    rows = [(p, c) for p, (c, _) in FILES.items()] + [("again/rsa.der", RSA), ("none", None), ("empty", b""), ("junk", b"\x30\x82"), ("text", b"hello")]
    got = {}
    for r in keys.keys(spark.createDataFrame(rows, "path string, content binary")).collect():
        got.setdefault(r.path, []).append(tuple(r)[2:])
    assert got == {p: want for p, (_, want) in FILES.items()} | {"again/rsa.der": FILES["rsa.der"][1]}


@pytest.mark.parametrize("path", ["rsa.der", "store.jks", "store.p12", "authorized_keys"])
def test_what_is_cut_short_is_no_error(path):
    data = FILES[path][0]
    for n in range(0, len(data), max(1, len(data) // 60)):
        assert isinstance(keys.found_in(data[:n]), list)


def test_public_keys_in_pem(spark):
    text = "-----BEGIN PUBLIC KEY-----\n" + base64.b64encode(EC).decode() + "\n-----END PUBLIC KEY-----\n"
    blocks = readers.pem_blocks(spark.createDataFrame([("a.pem", text)], "path string, text string"))
    assert [(r.path, r.alg_id, r.curve) for r in keys.keys(blocks).collect()] == [("a.pem", "ecdsa", "P-384")]


def test_json_of_any_depth_keeps_the_other_texts(spark):
    deep = '{"a":' * 300 + "1.50" + "}" * 300
    files = spark.createDataFrame([("a", deep), ("b", "[" * 100_000), ("c", '{"x":[true,null,{"y z":"t"}],"n":10}'), ("d", "7"), ("e", None)], "path string, text string")
    got = {(r.path, r.key, r.value) for r in readers.json_values(files).collect()}
    assert got == {("a", ".".join("a" * 300), "1.50"), ("c", "x.0", "true"), ("c", "x.2.y z", "t"), ("c", "n", "10")}


def test_tables_left_behind_go(spark):
    import os

    kept = written(spark.range(5).toDF("n"), "scratch")
    path = next(p for p in LEFT if "/scratch-" in p)
    assert kept.count() == 5 and os.path.isdir(path)
    release(spark)
    assert not LEFT and not os.path.exists(path)


def test_files_over_the_limit_are_not_opened(spark, tmp_path):
    for path, size in {"a/small.conf": 40, "a/b/exact.conf": 50, "a/large.bin": 51}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * size)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "50")  # the source refuses to read a larger file
    try:
        got = {r.path.rsplit("/", 1)[1]: (r.size, r.content and len(r.content)) for r in readers.files(spark, str(tmp_path), largest=50).collect()}
        assert got == {"small.conf": (40, 40), "exact.conf": (50, 50), "large.bin": (51, None)}
        with pytest.raises(Exception, match="50"):
            readers.files(spark, str(tmp_path), largest=60).collect()
        assert readers.files(spark, str(tmp_path), largest=50, since="2099-01-01").count() == 0 and readers.files(spark, str(tmp_path), largest=50, since="1999-01-01").count() == 3
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_reports_are_read_back(spark):
    from pyspark.sql import functions as F

    from postura.sinks import documents

    values = {"component": "c", "tier": "high", "priority": 61, "liveness": "confirmed", "grade": "A", "data_class": "payment", "confidence": 0.55, "qb": 1.0, "threat": "harvest", "agility": 40, "exposure_index": 12.5, "action": "replace", "target": "ML-KEM", "effort": 2.5}
    rows = spark.createDataFrame([("a",), ("b",)], "asset_id string").withColumns({k: F.lit(v) for k, v in values.items()}).withColumn("priority", F.when(F.col("asset_id") == "a", 61).otherwise(70))
    text = "\n".join(r.json for r in documents.report(rows).collect()) + "\nnot json\n{}\n"
    back = readers.reports(spark.createDataFrame([("r.json", text), ("e", None)], "path string, text string"))
    assert [r.asset_id for r in back.orderBy(F.desc("priority")).collect()] == ["b", "a"]
    assert {k: v for k, v in back.where("asset_id = 'a'").first().asDict().items() if k in values} == values
