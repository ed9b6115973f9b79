"""Queries over raw evidence, projected from the tables by the expressions that their oracles share."""

from __future__ import annotations

from pyspark.sql import functions as F

from postura import estate
from postura.operators import evidence as ev
from postura.plans import registry, sql
from postura.plans.registry import query



def columns(mapping: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in mapping.items())


def projected(df, mapping: dict[str, str]):
    return df.select(*(F.expr(e).alias(c) for c, e in mapping.items()))


TRACE = "trace AS (SELECT event_id, ts, " + ", ".join(f"{e} AS {c}" for c, e in estate.TRACE.items()) + ", CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events)"


@query(f"WITH {TRACE} SELECT executable, function, value, count(*) AS calls FROM trace GROUP BY ALL")
def trace_counts(spark, d):
    return estate.trace(spark, d).groupBy("executable", "function", "value").agg(F.count("*").alias("calls"))


@query(f"""WITH {TRACE}, a AS (SELECT *, sum(CASE function WHEN 'SSL_CTX_new' THEN 1 WHEN 'exit' THEN -1 ELSE 0 END) OVER w AS s FROM trace WINDOW w AS (PARTITION BY pid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, s - least(0, min(s) OVER w) AS now FROM a WINDOW w AS (PARTITION BY pid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY pid ORDER BY ts, event_id), 0) AS depth FROM b)
SELECT executable, function, count(*) FILTER (depth = 0) AS calls, count(*) FILTER (depth > 0) AS ignored FROM c WHERE function NOT IN ('SSL_CTX_new', 'exit') GROUP BY ALL""")
def trace_setup_filter(spark, d):
    return ev.setup_counts(estate.trace(spark, d), "SSL_CTX_new", "exit")


FILE_PATH = "concat(source, '/', lang, '/', CASE WHEN doc_id % 37 = 0 THEN 'setup.py' WHEN doc_id % 41 = 0 THEN 'lib/setup.cfg' WHEN doc_id % 43 = 0 THEN 'Makefile' WHEN doc_id % 47 = 0 THEN 'lib/Chart.yaml' ELSE concat('lib/', CAST(doc_id AS STRING), '.txt') END)"


def files(spark, d):
    return estate.read(spark, d, "documents").select(F.expr(FILE_PATH).alias("path"), "doc_id", "text", "n_chars", "source").where("path IS NOT NULL")


@query(f"""WITH f AS (SELECT DISTINCT {FILE_PATH} AS path FROM documents), r AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM f WHERE path LIKE '%/setup.py' OR path LIKE '%/setup.cfg' OR path LIKE '%/Chart.yaml')
SELECT f.path, coalesce(arg_max(root, length(root)), '.') AS component FROM f LEFT JOIN r ON starts_with(f.path, r.root || '/') WHERE f.path IS NOT NULL GROUP BY 1""")
def component_resolve(spark, d):
    return ev.components(files(spark, d).select("path").distinct()).select("path", "component")


@query("SELECT source, count(*) AS files, count(*) FILTER (n_chars <= 16384) AS read, CAST(coalesce(sum(n_chars) FILTER (n_chars <= 16384), 0) AS BIGINT) AS chars, count(*) FILTER (n_chars > 16384) AS too_large FROM documents GROUP BY 1")
def scan_stats(spark, d):
    small = F.col("n_chars") <= 16384
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return estate.read(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("files"), count(small).alias("read"), F.sum(F.when(small, F.col("n_chars")).otherwise(0)).alias("chars"), count(~small).alias("too_large")
    )


KEY = f"sha256(concat(CAST(length(coalesce({FILE_PATH}, '')) AS VARCHAR), ':', coalesce({FILE_PATH}, ''), CAST(length(coalesce(text, '')) AS VARCHAR), ':', coalesce(text, '')))"


@query(f"WITH f AS (SELECT doc_id, {KEY} AS key FROM documents WHERE {FILE_PATH} IS NOT NULL) SELECT doc_id FROM f WHERE key NOT IN (SELECT key FROM f WHERE doc_id % 3 <> 0)")
def cache_misses(spark, d):
    rows = files(spark, d).select("doc_id", ev.cache_key("path", "text").alias("key"))
    return ev.misses(rows, rows.where("doc_id % 3 <> 0")).select("doc_id")


LAYERS = {
    "image": "CAST(l_suppkey AS BIGINT)", "layer": "CAST(l_orderkey % 9 AS BIGINT)", "kind": "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'opaque' WHEN l_returnflag = 'R' THEN 'whiteout' ELSE 'file' END",
    "path": "concat('usr/lib', CASE WHEN l_returnflag = 'R' AND l_linenumber < 3 THEN '' ELSE '/' END, CASE WHEN l_returnflag = 'R' AND l_linenumber < 3 THEN CAST(l_linenumber - 1 AS STRING) ELSE CAST(l_partkey % 50 AS STRING) END, CASE WHEN l_returnflag <> 'R' AND l_linenumber > 4 THEN '/x' ELSE '' END)",
}


@query("WITH l AS (SELECT " + columns(LAYERS) + """ FROM lineitem), f AS (SELECT image, path, max(layer) AS layer FROM l WHERE kind = 'file' GROUP BY ALL)
SELECT image, path, layer FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.image = f.image AND l.kind <> 'file' AND l.layer > f.layer AND (starts_with(f.path, l.path || '/') OR l.kind = 'whiteout' AND l.path = f.path))""")
def overlay(spark, d):
    return ev.overlay(projected(estate.read(spark, d, "lineitem"), LAYERS))


LISTENER = {
    "listener_id": "CAST(s_suppkey AS BIGINT)", "component": "n_name",
    "host": "CASE WHEN s_suppkey % 2 = 0 THEN concat('a', CAST(s_suppkey % 7 AS STRING), '.n', CAST(s_nationkey AS STRING), '.example') ELSE concat('*.n', CAST(s_nationkey AS STRING), '.example') END",
}
SEEN = {"c_custkey": "c_custkey", "host": "concat('a', CAST(c_custkey % 7 AS STRING), CASE WHEN c_custkey % 11 = 0 THEN '.b' ELSE '' END, '.n', CAST(c_nationkey AS STRING), '.example')"}


@query(f"""WITH li AS (SELECT {columns(LISTENER)} FROM supplier JOIN nation ON s_nationkey = n_nationkey), f AS (SELECT host, arg_min(component, listener_id) AS component FROM li GROUP BY 1), s AS (SELECT {columns(SEEN)} FROM customer)
SELECT c_custkey, s.host, coalesce(e.component, w.component) AS listener_component FROM s LEFT JOIN f e ON s.host = e.host LEFT JOIN f w ON w.host = '*.' || regexp_extract(s.host, '^[^.]+\\.(.+)$', 1)""")
def host_attribution(spark, d):
    nation = F.broadcast(estate.read(spark, d, "nation"))
    listeners = estate.read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return ev.attributed(projected(estate.read(spark, d, "customer"), SEEN), projected(listeners, LISTENER))


KEX = "'mlkem768x25519-sha256,curve25519-sha256,ecdh-sha2-nistp256,diffie-hellman-group14-sha256,diffie-hellman-group1-sha1'"


def offered(column: str, step: int) -> str:
    """A list of some of the algorithms, in an order that depends on a number."""
    return "concat(" + ", ',', ".join(f"split_part({KEX}, ',', CAST(1 + ({column} * {step} + {i * 2}) % 5 AS INT))" for i in range(3)) + ")"


@query(f"""WITH p AS (SELECT c_custkey, s_suppkey, string_split({offered('c_custkey', 3)}, ',') AS c, string_split({offered('s_suppkey', 2)}, ',') AS s FROM customer JOIN supplier ON c_custkey % 1000 = s_suppkey)
SELECT c_custkey, s_suppkey, list_filter(c, lambda x: list_contains(s, x))[1] AS kex FROM p""")
def ssh_negotiate(spark, d):
    rows = estate.read(spark, d, "customer").join(estate.read(spark, d, "supplier"), F.expr("c_custkey % 1000") == F.col("s_suppkey"))
    lists = [F.split(F.expr(offered(c, k)), ",") for c, k in (("c_custkey", 3), ("s_suppkey", 2))]
    return rows.select("c_custkey", "s_suppkey", ev.negotiated(*lists).alias("kex"))


HANDSHAKE = {"server": "CAST(o_custkey % 40 AS BIGINT)", "version": "CASE o_orderkey % 3 WHEN 0 THEN '1.2' ELSE '1.3' END", "suite": "o_orderpriority", "place": "CAST(o_orderkey AS BIGINT)"}


@query("SELECT server, version, suite, min(place) AS first_place, count(*) AS times FROM (SELECT " + columns(HANDSHAKE) + " FROM orders) GROUP BY ALL")
def negotiated_settings(spark, d):
    return ev.distinct_settings(projected(estate.read(spark, d, "orders"), HANDSHAKE), ["server", "version", "suite"])


PROTOCOL = {"component": "l_returnflag", "path": "concat('conf/', CAST(l_orderkey AS STRING))", "version": "CASE l_linenumber % 3 WHEN 1 THEN '1.2' WHEN 2 THEN '1.3' END", "suite": "concat('suite', CAST(l_partkey % 9 AS STRING))"}


@query("WITH p AS (SELECT " + columns(PROTOCOL) + """ FROM lineitem), v AS (SELECT DISTINCT component, path, version FROM p WHERE version IS NOT NULL),
u AS (SELECT component, version, suite FROM p WHERE version IS NOT NULL UNION SELECT p.component, v.version, suite FROM p JOIN v ON p.component = v.component AND p.path = v.path WHERE p.version IS NULL
  UNION SELECT component, '?' || path, suite FROM p WHERE version IS NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.component = p.component AND v.path = p.path))
SELECT component, version, string_agg(DISTINCT suite, ',' ORDER BY suite) AS suites FROM u GROUP BY ALL""")
def protocol_attach(spark, d):
    return ev.attach_settings(projected(estate.read(spark, d, "lineitem"), PROTOCOL))


LINE = "concat(CAST(event_id AS STRING), '|', event_type)"


@query(f"""WITH l AS (SELECT user_id AS log, row_number() OVER w + CASE WHEN event_id % 211 = 0 THEN 1 ELSE 0 END AS seq, event_id, {LINE} AS line, lag({LINE}) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'forged' ELSE sha256(last) END AS prev FROM l),
c AS (SELECT *, lag(seq) OVER v AS before, lag(line) OVER v AS l2 FROM h WINDOW v AS (PARTITION BY log ORDER BY seq, event_id))
SELECT log, CAST(seq AS BIGINT) AS seq FROM c WHERE before IS NOT NULL AND NOT coalesce(seq = before + 1 AND prev = sha256(l2), false)""")
def chain_check(spark, d):
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    line = F.expr(LINE)
    seq = (F.row_number().over(order) + F.when(F.col("event_id") % 211 == 0, 1).otherwise(0)).cast("long")
    rows = estate.read(spark, d, "events").select(F.col("user_id").alias("log"), seq.alias("seq"), "event_id", line.alias("line"), F.lag(line).over(order).alias("last"))
    forged = F.when(F.col("event_id") % 97 == 0, F.lit("forged")).otherwise(F.sha2("last", 256))
    return ev.broken_links(rows.withColumn("prev", forged))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_props(spark, d):
    return estate.read(spark, d, "events").select("event_id", ev.property_of(F.col("props"), "k").alias("k"), ev.property_of(F.col("props"), "missing").alias("missing"))


VERSION = estate.LIBRARY["version"]


@query(f"WITH v AS (SELECT s_suppkey, {VERSION} AS version FROM supplier) SELECT s_suppkey, version, {sql.NUMBERS} >= [3, 5, 0] AS enough FROM v")
def library_versions(spark, d):
    from postura.engine import version_at_least

    return estate.read(spark, d, "supplier").select("s_suppkey", F.expr(VERSION).alias("version")).withColumn("enough", version_at_least(F.col("version"), "3.5.0"))


# --- names and documents

SPELLED = {
    "name": "CASE l_partkey % 9 WHEN 0 THEN 'AES-' || CAST(128 + 64 * (l_suppkey % 3) AS STRING) || '-GCM' WHEN 1 THEN 'SHA256withRSA' WHEN 2 THEN 'ecdh-sha2-nistp' || split_part('256,384,521', ',', CAST(1 + l_suppkey % 3 AS INT)) "
    "WHEN 3 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'RS' ELSE 'PS' END || split_part('256,384,512', ',', CAST(1 + l_suppkey % 3 AS INT)) WHEN 4 THEN 'ML-KEM-' || split_part('512,768,1024', ',', CAST(1 + l_suppkey % 3 AS INT)) WHEN 5 THEN 'des-ede3-cbc' "
    "WHEN 6 THEN 'RSA-' || CAST(1024 * (1 + l_suppkey % 3) AS STRING) WHEN 7 THEN 'hmac-sha2-256-etm@openssh.com' ELSE 'AESUtil' END",
}

# a name and what it says: algorithm, bits, parameter set, curve, mode, padding, digest
NAMES = [
    ("AES-128-GCM", "aes", 128, None, None, "gcm", None, None), ("AES-192-GCM", "aes", 192, None, None, "gcm", None, None), ("AES-256-GCM", "aes", 256, None, None, "gcm", None, None), ("SHA256withRSA", "rsa", None, None, None, None, None, "sha-256"),
    ("ecdh-sha2-nistp256", "ecdh", None, None, "P-256", None, None, None), ("ecdh-sha2-nistp384", "ecdh", None, None, "P-384", None, None, None), ("ecdh-sha2-nistp521", "ecdh", None, None, "P-521", None, None, None),
    ("RS256", "rsa", None, None, None, None, "pkcs1v15", "sha-256"), ("RS384", "rsa", None, None, None, None, "pkcs1v15", "sha-384"), ("RS512", "rsa", None, None, None, None, "pkcs1v15", "sha-512"),
    ("PS256", "rsa", None, None, None, None, "pss", "sha-256"), ("PS384", "rsa", None, None, None, None, "pss", "sha-384"), ("PS512", "rsa", None, None, None, None, "pss", "sha-512"),
    ("ML-KEM-512", "ml-kem", None, "512", None, None, None, None), ("ML-KEM-768", "ml-kem", None, "768", None, None, None, None), ("ML-KEM-1024", "ml-kem", None, "1024", None, None, None, None), ("des-ede3-cbc", "3des", None, None, None, "cbc", None, None),
    ("RSA-1024", "rsa", 1024, None, None, None, None, None), ("RSA-2048", "rsa", 2048, None, None, None, None, None), ("RSA-3072", "rsa", 3072, None, None, None, None, None), ("hmac-sha2-256-etm@openssh.com", "hmac", None, None, None, None, None, "sha-256"),
]
EXPECTED = f"(VALUES {sql.values(NAMES)}) e(name, alg_id, key_bits, parameter_set, curve, mode, padding, digest)"


@query(f"WITH s AS (SELECT {columns(SPELLED)} FROM lineitem) SELECT name, alg_id, key_bits, parameter_set, curve, mode, padding, digest, count(*) AS uses FROM s LEFT JOIN {EXPECTED} USING (name) GROUP BY ALL")
def names_resolve(spark, d):
    from postura.functions import names

    rows = names.resolved(projected(estate.read(spark, d, "lineitem"), SPELLED), "name")
    fields = ["alg_id", "key_bits", "parameter_set", "curve", "mode", "padding", "digest"]
    return rows.groupBy("name", *(F.col(f"algorithm.{f}").alias(f) for f in fields)).agg(F.count("*").alias("uses"))


def json_pairs(pairs: dict[str, str]) -> str:
    """The fields of a JSON object that have a value; texts here need no escapes."""
    return "concat_ws(',', " + ", ".join(f"'\"{n}\":' || {v}" for n, v in pairs.items()) + ")"


QUOTED = lambda c: f"'\"' || {c} || '\"'"
CBOM_PARAMETERS = {"primitive": QUOTED(sql.PR), "parameterSetIdentifier": QUOTED("coalesce(parameter_set, CAST(key_bits AS VARCHAR))"), "curve": QUOTED("curve"), "mode": QUOTED("mode"), "nistQuantumSecurityLevel": "CAST(level AS VARCHAR)"}
CBOM_PROPERTIES = ["component", "tier", "priority", "liveness", "grade", "data_class", "confidence", "qb", "threat", "agility", "exposure_index", "action", "target", "effort"]
CBOM_LIST = "concat_ws(',', " + ", ".join(f"'{{\"name\":\"{c}\",\"value\":\"' || CAST({c} AS VARCHAR) || '\"}}'" for c in CBOM_PROPERTIES) + ")"


@query(sql.query(f"""SELECT asset_id, '{{"type":"cryptographic-asset","bom-ref":"' || asset_id || '","name":"' || alg_name || '","cryptoProperties":{{"assetType":"algorithm","algorithmProperties":{{' || {json_pairs(CBOM_PARAMETERS)}
  || '}}}},"properties":[' || {CBOM_LIST} || ']}}' AS json FROM advised"""))
def cbom_components(spark, d):
    from postura.plans.registry import inventory
    from postura.sinks import documents

    return documents.components(inventory(spark, d))


# inventory documents, one a nation, whose components are its customers
PART = """concat('{ "name" : "n', CAST(c_custkey % 11 AS STRING), '", "bom-ref": "c', CAST(c_custkey AS STRING), '", "properties": [ {"value":"', CAST(c_custkey % 5 AS STRING), '" , "name":"tier"}, null, true ], "cryptoProperties": {"level": ', CAST(c_custkey % 6 AS STRING), ', "bits" : 2048.50} }')"""


@query("""WITH RECURSIVE c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position,
  '{"bom-ref":"c' || c_custkey || '","cryptoProperties":{"bits":2048.5,"level":' || c_custkey % 6 || '},"name":"n' || c_custkey % 11 || '","properties":[{"name":"tier","value":"' || c_custkey % 5 || '"},null,true]}' AS text FROM customer),
h(nation, position, custkey, digest) AS (SELECT c_nationkey, position, c_custkey, sha256(unhex(repeat('00', 32)) || encode(text)) FROM c WHERE position = 0
  UNION ALL SELECT c_nationkey, c.position, c.c_custkey, sha256(unhex(h.digest) || encode(c.text)) FROM h JOIN c ON c.c_nationkey = h.nation AND c.position = h.position + 1)
SELECT 'bom/' || nation AS path, CAST(position AS INT) AS position, 'c' || custkey AS bom_ref, digest FROM h""")
def component_chain(spark, d):
    """The chain of digests over each document's components, in canonical form."""
    from postura.sinks import documents

    parts = estate.read(spark, d, "customer").select("c_nationkey", F.struct("c_custkey", F.expr(PART).alias("text")).alias("p"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), ",\n")
    files = parts.groupBy("c_nationkey").agg(F.concat(F.lit('{"bomFormat": "CycloneDX", "components": ['), inner, F.lit("] }")).alias("text"))
    return documents.chained(documents.listed(files.select(F.concat(F.lit("bom/"), "c_nationkey").alias("path"), "text")))


@query(sql.query("", sql.CLASSIFIED).rstrip() + ",\n" + registry.LINKS + ",\n" + registry.GRAPH + """
SELECT component AS source, asset_id AS target, 'contains' AS kind FROM classified UNION SELECT asset_id, depends_on, 'depends-on' FROM links UNION SELECT caller, target, 'calls' FROM edges
UNION SELECT function_id, asset_id, 'uses' FROM occ WHERE function_id IS NOT NULL UNION SELECT asset_id, 'data/' || data_class || '/' || substr(sha256(data_class || '|' || asset_id), 1, 16), 'protects' FROM classified""")
def graph_edges(spark, d):
    from postura.operators import graph, normalize
    from postura.plans.registry import kinds
    from postura.sinks import documents

    fns, calls = estate.call_graph(spark, d)
    assets, found = kinds(estate.observations(spark, d))
    return documents.edges(assets, normalize.dependency_links(assets, estate.catalogue(spark)), graph.resolved_calls(calls, fns), found)


# --- certificates, protocols, key material

CERTIFICATE = {
    "o_orderkey": "o_orderkey", "key_status": "CAST(o_custkey % 4 AS INT)", "signature_status": "CAST(o_orderkey % 3 AS INT)", "not_before_year": "CAST(2018 + o_orderkey % 9 AS INT)",
    "not_after_year": "CAST(2019 + o_orderkey % 9 + o_custkey % 5 AS INT)", "is_ca": "o_custkey % 6 = 0",
}


@query(f"""WITH c AS (SELECT {columns(CERTIFICATE)} FROM orders) SELECT o_orderkey, greatest(key_status, signature_status, CASE WHEN not_after_year < 2026 THEN 2 ELSE 0 END,
CASE WHEN not_after_year - not_before_year > 2 AND NOT is_ca THEN 1 ELSE 0 END) AS status, CAST(greatest(not_after_year - 2026, 0) AS DOUBLE) AS lifetime FROM c""")
def certificate_status(spark, d):
    from postura.operators import findings

    rows = projected(estate.read(spark, d, "orders"), CERTIFICATE)
    return rows.select("o_orderkey", findings.certificate_status(rows).alias("status"), findings.certificate_lifetime().alias("lifetime"))


SETTING = {
    "kind": "CASE o_orderkey % 4 WHEN 0 THEN 'ssh' ELSE 'tls' END", "version": "split_part('ssl3.0,1.0,1.1,1.2,1.3', ',', CAST(1 + o_custkey % 5 AS INT))",
    "suite": "split_part('TLS_AES_256_GCM_SHA384,TLS_RSA_WITH_RC4_128_SHA,ECDHE-RSA-AES128-GCM-SHA256,TLS_RSA_EXPORT_WITH_DES40_CBC_SHA,DES-CBC3-SHA,TLS_DH_anon_WITH_AES_128_CBC_SHA,TLS_RSA_WITH_NULL_SHA256,EXP-RC4-MD5,ADH-AES256-SHA', ',', CAST(1 + o_orderkey % 9 AS INT))",
    "grp": "split_part('X25519,X25519MLKEM768,P-256', ',', CAST(1 + o_custkey % 3 AS INT))",
}


@query(f"""WITH p AS (SELECT o_orderkey, {columns(SETTING)} FROM orders),
q AS (SELECT *, suite LIKE '%EXPORT%' OR suite LIKE 'EXP-%' OR suite LIKE '%WITH_NULL%' OR suite LIKE '%anon%' OR suite LIKE 'ADH-%' AS weak, CASE WHEN grp = 'X25519MLKEM768' THEN 0.0 ELSE 1.0 END::DOUBLE AS qb FROM p)
SELECT o_orderkey, CASE WHEN version LIKE 'ssl%' OR weak THEN 3 WHEN version IN ('1.0', '1.1') AND kind <> 'ssh' THEN 2 ELSE 0 END AS status, qb,
CASE WHEN kind = 'ssh' THEN 'enable' WHEN version LIKE 'ssl%' OR version IN ('1.0', '1.1') THEN 'upgrade' WHEN qb = 0 THEN 'retain' ELSE 'enable' END AS action FROM q""")
def protocol_scores(spark, d):
    from postura.operators import findings

    rows = projected(estate.read(spark, d, "orders"), {"o_orderkey": "o_orderkey"} | SETTING)
    status = findings.protocol_status(F.col("kind"), F.col("version"), F.array("suite"))
    rows = rows.select("*", status.alias("status"), findings.protocol_breakability(F.array("grp", "suite")).alias("qb"))
    return rows.select("o_orderkey", "status", "qb", findings.protocol_advice(F.col("kind"), F.col("version"), F.col("qb")).alias("action"))


# a suite's name is put together from parts that the oracle knows
SUITE = {
    "x": "CAST(1 + l_partkey % 9 AS INT)", "y": "CAST(1 + l_suppkey % 8 AS INT)", "z": "CAST(1 + l_orderkey % 4 AS INT)", "dash": "l_linenumber % 2 = 0 AND l_partkey % 9 < 5",
}
IANA = "concat('TLS_', split_part('RSA,DHE_RSA,ECDHE_RSA,ECDHE_ECDSA,DHE_DSS,DH_anon,RSA_EXPORT,PSK,DHE_PSK', ',', x), '_WITH_', split_part('AES_128_GCM,AES_256_CBC,3DES_EDE_CBC,RC4_128,CHACHA20_POLY1305,NULL,CAMELLIA_256_CBC,AES_256_CCM', ',', y), '_', split_part('SHA256,SHA,MD5,SHA384', ',', z))"
DASHED = "concat(split_part(',DHE-RSA-,ECDHE-RSA-,ECDHE-ECDSA-,DHE-DSS-', ',', x), split_part('AES128-GCM,AES256,DES-CBC3,RC4,CHACHA20-POLY1305,NULL,CAMELLIA256,AES256-CCM', ',', y), '-', split_part('SHA256,SHA,MD5,SHA384', ',', z))"
OF_Y = lambda names: f"nullif(split_part('{names}', ',', y), '')"


@query(f"""WITH s AS (SELECT {columns(SUITE)} FROM lineitem), n AS (SELECT DISTINCT x, y, z, CASE WHEN dash THEN {DASHED} ELSE {IANA} END AS suite FROM s)
SELECT suite, nullif(split_part('rsa,dh,ecdh,ecdh,dh,dh,rsa,,dh', ',', x), '') AS key_exchange, nullif(split_part('rsa,rsa,rsa,ecdsa,dsa,,rsa,,', ',', x), '') AS authentication,
{OF_Y('aes,aes,3des,rc4,chacha20-poly1305,,camellia,aes')} AS cipher, CAST({OF_Y('128,256,,128,,,256,256')} AS INT) AS bits, {OF_Y('gcm,cbc,cbc,,,,cbc,ccm')} AS mode,
split_part('sha-256,sha-1,md5,sha-384', ',', z) AS digest, concat_ws(',', CASE WHEN x = 6 THEN 'anonymous' END, CASE WHEN x = 7 THEN 'export' END, CASE WHEN y = 6 THEN 'null' END) AS weaknesses FROM n""")
def suite_parts(spark, d):
    from postura.operators import findings

    rows = projected(estate.read(spark, d, "lineitem"), SUITE).select("x", "y", "z", F.when(F.col("dash"), F.expr(DASHED)).otherwise(F.expr(IANA)).alias("suite"))
    return rows.select("suite").distinct().select("suite", F.inline(F.array(findings.suite_parts(F.col("suite")))))


MATERIAL = {
    "kind": "split_part('private-key,public-key,secret-key', ',', CAST(1 + o_orderkey % 3 AS INT))", "encrypted": "o_custkey % 2 = 0", "custody": "CASE WHEN o_orderkey % 7 = 0 THEN 'cloud-kms' END",
    "algorithm_status": "CAST(o_custkey % 4 AS INT)", "qb": "CAST(CASE o_custkey % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.5 ELSE 1.0 END AS DOUBLE)", "known": "o_orderkey % 5 <> 0",
}


@query(f"""WITH m AS (SELECT o_orderkey, {columns(MATERIAL)} FROM orders), k AS (SELECT *, CASE WHEN NOT known THEN 'review' WHEN qb <= 0.2 AND algorithm_status < 3 THEN 'retain' ELSE 'replace' END AS kept FROM m)
SELECT o_orderkey, greatest(algorithm_status, CASE WHEN kind = 'private-key' AND NOT encrypted AND custody IS NULL THEN 2 ELSE 0 END) AS status,
CASE WHEN custody IS NOT NULL THEN kept WHEN kind = 'private-key' AND NOT encrypted THEN 'rotate' ELSE kept END AS action FROM k""")
def material_scores(spark, d):
    from postura.operators import findings

    rows = projected(estate.read(spark, d, "orders"), {"o_orderkey": "o_orderkey"} | MATERIAL)
    c = F.col
    status = findings.material_status(c("algorithm_status"), c("kind"), c("encrypted"), c("custody"))
    action = findings.material_advice(c("kind"), c("encrypted"), c("custody"), c("known"), c("qb"), c("algorithm_status") == 3)
    return rows.select("o_orderkey", status.alias("status"), action.alias("action"))


# --- listeners and relevance

SERVING = estate.SERVING


@query(sql.query("", sql.OCC).rstrip() + f""",
li AS (SELECT {columns(SERVING)} FROM supplier JOIN nation ON s_nationkey = n_nationkey), bp AS (SELECT path, min(listener_id) AS l FROM li GROUP BY 1), bf AS (SELECT component, served, min(listener_id) AS l FROM li GROUP BY ALL)
SELECT asset_id, coalesce(min(CASE WHEN surface IN ('config', 'cloud') THEN bp.l END), min(bf.l)) AS listener_id FROM occ LEFT JOIN bp ON occ.path = bp.path
LEFT JOIN bf ON occ.component = bf.component AND string_split(occ.path, '/')[-1] = bf.served GROUP BY 1""")
def served_listener(spark, d):
    from postura.plans.registry import occurrences

    places = occurrences(spark, d).select("asset_id", "component", "surface", "path").distinct()
    return ev.listener_for(places, estate.listeners(spark, d))


def relevance_oracle() -> str:
    from postura.plans.registry import graph_sql

    return graph_sql(""", hops AS (SELECT * FROM edges WHERE caller <> target),
bfs(function_id, depth) AS (SELECT function_id, 0 FROM fns WHERE name = 'fn3' UNION SELECT caller, depth + 1 FROM bfs JOIN hops ON function_id = target WHERE depth < 40)
SELECT function_id, CAST(min(depth) AS INT) AS depth FROM bfs GROUP BY 1""", recursive=True)


@query(relevance_oracle())
def backward_relevance(spark, d):
    """Functions that lead to those named fn3."""
    from postura.operators import graph

    fns, calls = estate.call_graph(spark, d)
    return graph.relevant(graph.resolved_calls(calls, fns), fns.where("name = 'fn3'"))
