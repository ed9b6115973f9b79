"""Readers, names, documents and streams."""

import base64

import pytest
from pyspark.sql import functions as F

from postura.functions import names
from postura.operators import evidence
from postura.sinks import documents
from postura.sources import readers
from postura.streaming import trace


@pytest.mark.parametrize("name, alg, params", [
    ("aes-256-gcm", "aes", {"key_bits": 256, "mode": "gcm"}), ("des-ede3-cbc", "3des", {"mode": "cbc"}), ("ML-KEM-768", "ml-kem", {"parameter_set": "768"}),
    ("AES/CBC/PKCS5Padding", "aes", {"mode": "cbc", "padding": "pkcs5"}), ("ssh-rsa", "rsa", {"digest": "sha-1"}), ("diffie-hellman-group14-sha256", "dh", {"key_bits": 2048}),
    ("ES384", "ecdsa", {"curve": "P-384"}), ("SHA256withRSA/PSS", "rsa", {"digest": "sha-256", "padding": "pss"}), ("PBKDF2WithHmacSHA512", "pbkdf2", {"digest": "sha-512"}),
    ("HmacSHA256", "hmac", {"digest": "sha-256"}), ("X25519MLKEM768", "x25519-mlkem768", {}), ("sha512/256", "sha-512-256", {}), ("'RSA-2048'", "rsa", {"key_bits": 2048}),
])
def test_names(name, alg, params):
    found = names.resolve(name)
    assert found["alg_id"] == alg and {k: found[k] for k in params} == params


@pytest.mark.parametrize("name", ["AESUtil", "sha256sum", "desktop", "", None, "x" * 200, "äes", "rsa-banana"])
def test_what_is_not_wholly_explained_is_no_name(name):
    assert names.resolve(name) is None


@pytest.mark.parametrize("text, version", [("TLSv1.2 TLSv1.3", "1.3"), ("SSLv3", "ssl3.0"), ("tls1_1", "1.1"), ("dtls 1.2", "1.2"), ("none", None), (None, None)])
def test_protocol_versions(text, version):
    assert names.protocol_version(text) == version


def test_files_are_walked_and_never_cut(spark, tmp_path):
    for path, data in {"a/app.conf": b"x", "a/.git/config": b"y", "a/node_modules/m.js": b"z", "a/big.bin": b"0" * 100}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.content for r in readers.files(spark, str(tmp_path), largest=50).collect()}
    assert got == {"app.conf": bytearray(b"x"), "big.bin": None}
    assert readers.files(spark, str(tmp_path), dependencies=True).count() == 3


CONF = """# comment
server {
ssl_protocols TLSv1 TLSv1.2;
ssl_ciphers "ECDHE-RSA-AES256-GCM-SHA384:!aNULL";
listen 443;
}"""


def test_directives_and_key_values(spark):
    df = spark.createDataFrame([("gw/nginx.conf", CONF), ("e/.env", "[tls]\nkey.size = 2048 # bits\ndisabledAlgorithms=MD5\n\nmode: 'gcm'")], "path string, text string")
    got = {(r.setting, r.value, r.line) for r in readers.directives(df).collect()}
    assert {("versions", "TLSv1", 3), ("versions", "TLSv1.2", 3), ("suites", "ECDHE-RSA-AES256-GCM-SHA384", 4), ("listener", "443", 5)} <= got and not any(v.startswith("!") for _, v, _ in got)
    assert {(r.key, r.value) for r in readers.key_values(df.where("path = 'e/.env'")).collect()} == {("tls.key.size", "2048"), ("tls.mode", "gcm")}
    formats = spark.createDataFrame([("a/nginx.conf",), ("k.tf",), ("package-lock.json",), ("x.yml",), ("main.py",)], "p string").select(readers.config_format(F.col("p"))).collect()
    assert [r[0] for r in formats] == ["directives", "terraform", None, "yaml", None]


def test_packages(spark):
    dpkg = "Package: libssl3\nStatus: install ok installed\nVersion: 1:3.0.11-1~deb12u2\n\nPackage: gone\nStatus: deinstall ok not-installed\nVersion: 1"
    df = spark.createDataFrame([("d", dpkg), ("a", "P:openssl\nV:3.5.1-r0\n\nP:musl\nV:1.2")], "path string, text string")
    assert {tuple(r)[1:] for r in readers.packages(df).collect()} == {("libssl3", "3.0.11"), ("openssl", "3.5.1"), ("musl", "1.2")}


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + body


def made_certificate(bits: int = 2048) -> bytes:
    rsa = der(0x30, der(6, bytes.fromhex("2a864886f70d010101")), der(5))
    sign = der(0x30, der(6, bytes.fromhex("2a864886f70d01010b")), der(5))
    key = der(0x30, rsa, der(3, b"\0" + der(0x30, der(2, b"\0" + b"\x80" + b"\1" * (bits // 8 - 1)), der(2, b"\1\0\1"))))
    name = der(0x30, der(0x31, der(0x30, der(6, b"\x55\4\3"), der(0x0C, b"test"))))
    body = der(0x30, der(0xA0, der(2, b"\2")), der(2, b"\x0a\x0b"), sign, name, der(0x30, der(0x17, b"240101000000Z"), der(0x18, b"20340101000000Z")), name, key)
    return der(0x30, body, sign, der(3, b"\0" + b"\1" * 256))


def test_certificates(spark):
    pem = "-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(made_certificate()).decode() + "-----END CERTIFICATE-----\n"
    text = "junk\n" + pem + "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\nAAAA\n-----END RSA PRIVATE KEY-----\n" + pem.replace("CERTIFICATE", "EC PRIVATE KEY")
    blocks = readers.pem_blocks(spark.createDataFrame([("k.pem", text), ("bad.pem", "-----BEGIN CERTIFICATE-----\nAAAA\n-----END CERTIFICATE-----")], "path string, text string"))
    assert sorted((r.kind, r.encrypted) for r in blocks.collect()) == [("certificate", False), ("certificate", False), ("private-key", False), ("private-key", True)]
    (c,) = readers.certificates(blocks).collect()
    assert (c.serial, c.not_before, c.not_after, c.key_bits, c.key_oid, c.signature_oid, c.self_issued) == ("0a0b", "20240101000000Z", "20340101000000Z", 2048, "1.2.840.113549.1.1.1", "1.2.840.113549.1.1.11", True)


def test_documents_refer_to_what_is_there(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "asset_id string")
    links = spark.createDataFrame([("a", "b"), ("a", "z")], "asset_id string, depends_on string")
    assert [tuple(r) for r in documents.unresolved(nodes, links).collect()] == [("a", "z")]
    assert [r.asset_id for r in documents.repeated(nodes).collect()] == ["b"]
    assert documents.dependencies(links).first().json == '{"ref":"a","dependsOn":["b","z"]}'


def test_trace_and_inventory_documents(spark):
    doc = '{"format":"t","events":[{"executable":"e","library":"l","function":"f","kind":"call","count":3}]}'
    bom = '{"components":[{"bom-ref":"x","name":"AES","properties":[{"name":"tier","value":"high"},{"name":"component","value":"c"}]}]}'
    df = spark.createDataFrame([("t", doc), ("b", bom), ("j", "not json")], "path string, text string")
    assert [(r.function, r["count"], r.value) for r in readers.trace_documents(df.where("path <> 'b'")).collect()] == [("f", 3, None)]
    assert [(r.asset_id, r.component, r.tier) for r in readers.inventories(df.where("path <> 't'")).collect()] == [("x", "c", "high")]


LINES = """ app-7 [001] d... 1.0: call: (0x1) value="a"
 app-7 [001] d... 2.0: enter: (0x1)
 app-7 [001] d... 3.0: call: (0x1) value=b
 app-7 [001] d... 4.0: leave: (0x1 <- 0x2)
 app-7 [001] d... 5.0: leave: (0x1 <- 0x2)
 app-7 [001] d... 6.0: call: (0x1) value=c
 app-8 [001] d... 7.0: enter: (0x1)
garbage"""


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text(LINES)
    events = lambda: trace.parsed(trace.source(spark, str(folder)))
    assert {tuple(r) for r in trace.drain(trace.counts(events(), ["pid", "event"]), "n", "complete").collect()} == {(7, "call", 3), (7, "enter", 1), (7, "leave", 2), (8, "enter", 1)}
    checkpoint = str(tmp_path / "cp")
    assert {tuple(r) for r in trace.drain(trace.without_setup(events(), "enter", "leave"), "s1", checkpoint=checkpoint).collect()} == {(7, "call", 2, 1)}
    got = trace.drain(trace.bounded_distinct(events().where("event = 'call'"), "pid", "value", 2), "b").collect()
    assert {(r.value, r["count"], r.dropped) for r in got} == {("a", 1, 0), ("b", 1, 0), (None, 0, 1)}
    probes = spark.createDataFrame([("call", "libssl", "SSL_read")], "event string, library string, function string")
    assert trace.drain(trace.known(events(), probes), "k").where("function = 'SSL_read'").count() == 3
    trace.write_counts(events(), ["event"], str(tmp_path / "out"), str(tmp_path / "cp2"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_depth_in_batch_equals_the_stream(spark):
    rows = [(7, t, t, f) for t, f in enumerate(["x", "exit", "enter", "x", "enter", "exit", "x", "exit", "exit", "x"])]
    df = spark.createDataFrame(rows, "pid long, ts long, event_id long, function string").withColumn("executable", F.lit("e"))
    assert [r.depth for r in evidence.setup_depth(df, "enter", "exit").where("function = 'x'").orderBy("ts").collect()] == [0, 1, 1, 0]


def test_overlay_and_components(spark):
    rows = [("a", 1, "file"), ("a", 2, "whiteout"), ("b", 1, "file"), ("b", 1, "whiteout"), ("c", 1, "whiteout"), ("c", 2, "file"), ("d/e/f", 1, "file"), ("d", 2, "whiteout"), ("d/e/g", 2, "file")]
    rows += [("o/p", 1, "file"), ("o/p/q", 1, "file"), ("o/p/q", 3, "file"), ("o/p/r", 1, "file"), ("o/p", 2, "opaque"), ("o/pp", 1, "file")]
    e = spark.createDataFrame([("i", *r) for r in rows], "image string, path string, layer int, kind string")
    assert {(r.path, r.layer) for r in evidence.overlay(e).collect()} == {("b", 1), ("c", 2), ("d/e/g", 2), ("o/p", 1), ("o/p/q", 3), ("o/pp", 1)}
    f = spark.createDataFrame([("svc/go.mod",), ("svc/x/y.go",), ("svc/x/lib/setup.py",), ("svc/x/lib/z.py",), ("other.txt",)], "path string")
    assert {r.path: r.component for r in evidence.components(f).collect()} == {"svc/go.mod": "svc", "svc/x/y.go": "svc", "svc/x/lib/setup.py": "svc/x/lib", "svc/x/lib/z.py": "svc/x/lib", "other.txt": "."}


@pytest.mark.parametrize("line, want", [
    ("   my-app: x-12 [003] .... 17.25: p1: (0xffff) fd=3 value=\"a b\" more=1", ("my-app: x", 12, 17.25, "p1", "a b")),
    ("worker-9 ( 7) [000] 5.5: p2: (0x1 <- 0x2)", ("worker", 9, 5.5, "p2", None)),
    ("worker-9 [000] d.h. 6.0: p3: (0x1)", ("worker", 9, 6.0, "p3", None)),
    ("worker-x [000] 6.0: p3: (0x1)", None), ("worker-9 [000] now: p3: (0x1)", None), ("worker-9 6.0: p3: (0x1)", None), ("worker-9 [000] 6.0: p 3: (0x1)", None), ("worker-9 [000] 6.0: p3: value=1", None), ("", None),
])
def test_trace_lines(spark, line, want):
    got = [tuple(r) for r in trace.parsed(spark.createDataFrame([(line,)], "value string")).collect()]
    assert got == ([] if want is None else [want])


@pytest.mark.parametrize("suite, parts", [
    ("TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", ("ecdh", "rsa", "aes", 128, "gcm", "sha-256", "")), ("TLS_AES_256_GCM_SHA384", (None, None, "aes", 256, "gcm", "sha-384", "")),
    ("ECDHE-ECDSA-AES256-SHA384", ("ecdh", "ecdsa", "aes", 256, "cbc", "sha-384", "")), ("DES-CBC3-SHA", ("rsa", "rsa", "3des", None, "cbc", "sha-1", "")), ("AES128-SHA", ("rsa", "rsa", "aes", 128, "cbc", "sha-1", "")),
    ("TLS_RSA_EXPORT_WITH_RC4_40_MD5", ("rsa", "rsa", "rc4", 40, None, "md5", "export")), ("TLS_DH_anon_WITH_AES_128_CBC_SHA", ("dh", None, "aes", 128, "cbc", "sha-1", "anonymous")),
    ("ADH-AES256-SHA", ("dh", None, "aes", 256, "cbc", "sha-1", "anonymous")), ("TLS_RSA_WITH_NULL_SHA256", ("rsa", "rsa", None, None, None, "sha-256", "null")), ("RC4-MD5", ("rsa", "rsa", "rc4", 128, None, "md5", "")),
])
def test_suite_parts(spark, suite, parts):
    from postura.operators import findings

    assert tuple(spark.createDataFrame([(suite,)], "s string").select(findings.suite_parts(F.col("s")).alias("p")).first().p) == parts


def test_nested_keys(spark):
    text = {
        "a.ini": "top = 1\n[server]\nport = 8443\n; x\n[tls]\nmin=1.2",
        "b.yaml": "server:\n  tls:\n    min: 'TLSv1.2' # note\n    ciphers:\n      - name: A\n        bits: 256\n  port: 1\nurl: http://x:1/y\ndisabledThings:\n  a: 1",
        "c.json": '{"a": {"b": [1, {"c": "x"}], "d": null}, "e": true}', "d.json": "[[1], {}]", "e.json": "{broken",
    }
    df = spark.createDataFrame(list(text.items()), "path string, text string")
    got = {(r.path, r.key, r.value) for r in readers.key_values(df.where("path < 'c'")).collect()}
    assert got == {
        ("a.ini", "top", "1"), ("a.ini", "server.port", "8443"), ("a.ini", "tls.min", "1.2"), ("b.yaml", "server.tls.min", "TLSv1.2"), ("b.yaml", "server.tls.ciphers.name", "A"),
        ("b.yaml", "server.tls.ciphers.bits", "256"), ("b.yaml", "server.port", "1"), ("b.yaml", "url", "http://x:1/y"),
    }
    assert {(r.path, r.key, r.value) for r in readers.json_values(df.where("path > 'c'")).collect()} == {("c.json", "a.b.0", "1"), ("c.json", "a.b.1.c", "x"), ("c.json", "e", "true"), ("d.json", "0.0", "1")}


@pytest.mark.parametrize("text, form", [
    ('{"b":1, "a":{"z":[1,2,{"y":null,"x":true}],"é":"ü"}}', '{"a":{"z":[1,2,{"x":true,"y":null}],"é":"ü"},"b":1}'), ('{"":0,"a":2,"aa":3,"Z":4,"A":1}', '{"":0,"A":1,"Z":4,"a":2,"aa":3}'), (" [ ] ", "[]"), ("1.50", "1.5"), ('"a\\u000a\\"/é"', '"a\\n\\"/é"'),
    ("not json", None), ("", None), (None, None), ('{"a":1,"a":2}', None), ("[" * 40 + "1" + "]" * 40, "[" * 40 + "1" + "]" * 40),
])
def test_canonical_json(spark, text, form):
    from postura.functions.canonical import canonical

    assert spark.createDataFrame([(text,)], "t string").select(canonical(F.col("t"))).first()[0] == form


def test_canonical_form_does_not_depend_on_order(spark):
    import json
    import random

    from postura.functions.canonical import canonical

    def value(r, depth):
        kind = r.randrange(6 if depth else 4)
        return [r.randrange(99), f"s{r.randrange(9)}é\"", None, r.random() < 0.5, [value(r, depth - 1) for _ in range(3)] if depth else 0, {f"k{r.randrange(20)}": value(r, depth - 1) for _ in range(4)} if depth else 0][kind]

    def shuffled(r, v):
        if isinstance(v, dict):
            return {k: shuffled(r, v[k]) for k in r.sample(list(v), len(v))}
        return [shuffled(r, x) for x in v] if isinstance(v, list) else v

    values = [{"top": value(random.Random(i), 4), "x": i} for i in range(40)]
    texts = [(i, json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False), json.dumps(shuffled(random.Random(i), v), indent=1)) for i, v in enumerate(values)]
    got = spark.createDataFrame(texts, "i int, want string, t string").select("want", canonical(F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_a_chain_names_the_first_component_that_changed(spark):
    import hashlib

    def files(*texts):
        return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "path string, text string")

    bom = '{"components":[{"bom-ref":"a","n":1},{"n":2},{"bom-ref":"c","n":3}]}'
    chain = documents.chained(documents.listed(files(bom, "{}", None, "nope", '{"components":[]}', '{"components":[{"bom-ref":"a","n":1}]}')))
    rows = sorted(map(tuple, chain.collect()))
    one = hashlib.sha256(bytes(32) + b'{"bom-ref":"a","n":1}').hexdigest()
    two = hashlib.sha256(bytes.fromhex(one) + b'{"n":2}').hexdigest()
    assert [r[:3] for r in rows] == [("d0", 0, "a"), ("d0", 1, ""), ("d0", 2, "c"), ("d5", 0, "a")] and rows[0][3] == rows[3][3] == one and rows[1][3] == two
    changed = {  # the document and where it departs
        '{"components":[{"n":1.0,"bom-ref":"a"},{"n":2},{"bom-ref":"c","n":3}]}': None, '{"components":[{"bom-ref":"a","n":1},{"n":9},{"bom-ref":"c","n":3}]}': (1, "", ""), '{"components":[{"bom-ref":"a","n":1},{"n":2}]}': (2, None, "c"),
        '{"components":[{"n":2},{"bom-ref":"a","n":1},{"bom-ref":"c","n":3}]}': (0, "", "a"), '{"components":[{"bom-ref":"a","n":1},{"n":2},{"bom-ref":"c","n":3},{"bom-ref":"d"}]}': (3, "d", None),
    }
    for text, at in changed.items():
        found = [tuple(r)[1:] for r in documents.departures(documents.chained(documents.listed(files(text))), chain.where("path = 'd0'")).collect()]
        assert found == ([] if at is None else [at]), text


def test_chains_run_over_many_documents_and_batches(spark):
    import hashlib

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"p{i % 5}", i // 5, f"r{i}", f"t{i}") for i in range(200)]
        got = {(r.path, r.position): r.digest for r in documents.chained(spark.createDataFrame(rows, "path string, position int, bom_ref string, text string").repartition(6)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p in range(5):
        before = bytes(32)
        for k in range(40):
            before = hashlib.sha256(before + f"t{k * 5 + p}".encode()).digest()
            assert got[f"p{p}", k] == before.hex()
