"""Estate relations derived from the star-schema tables by integer arithmetic.

The tables hold no cryptography, so the analysis runs over this projection of them. Each
column is one expression that Spark and a SQL oracle both read, so that they share the
mapping and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postura.knowledge import ALGORITHM_SCHEMA, LIBRARIES, algorithm_rows
from postura.storage import written

SURFACES = "source,binary,container,certificate,config,cloud,runtime"
#: Names around a use; they touch every data class, and none.
IDENTIFIERS = (
    "encryptCardNumber,aadhaarHash,patientRecord,topSecretKey,jwtToken,emailAddress,publicChecksum,bufferSize,"
    "wallet_payment,passportScan,diagnosisNote,cabinetMemo,sessionCookie,phoneNumber,mockFixture,blockIndex,"
    "IFSCAccount,biometricTemplate,genomeBlob,secret_key,userProfile,upiTransaction,retryCount,customer_pan"
)
PARAMETERS = "record,cardNumber,patientId,payload,authToken,buffer"
CURVE_NAMES = "P-192,P-224,P-256,P-384,P-521,secp256k1,brainpoolP256r1,brainpoolP384r1,brainpoolP512r1,curve25519,curve448,SM2"
RULES = "java.jca.cipher,c.openssl.evp,python.hashlib.new,go.crypto.rsa,config.key.size"


def pick(values: str, index: str, sep: str = ",") -> str:
    """One of the values in the list, by an expression counted from 0."""
    return f"split_part('{values}', '{sep}', CAST(1 + {index} AS INT))"


def count_of(column: str, sep: str) -> str:
    return f"(length({column}) - length(replace({column}, '{sep}', '')) + 1)"


#: Column: expression over lineitem, part, supplier, nation and the algorithm catalogue.
OBSERVATION = {
    "obs_id": "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)",
    "order_id": "CAST(l_orderkey AS BIGINT)",
    "component": "n_name",
    "surface": pick(SURFACES, "(l_linenumber % 7)"),
    "path": "concat('svc', CAST(l_suppkey AS STRING), '/f', CAST(l_orderkey % 50 AS STRING))",
    "line": "CAST(l_linenumber AS BIGINT)",
    "rule_id": pick(RULES, "(l_partkey % 5)"),
    "kind": "CASE WHEN l_returnflag = 'R' AND l_partkey % 5 = 0 THEN 'heuristic' ELSE "
    + pick("api-call,symbol,package,parsed,declared,declared,observed", "(l_linenumber % 7)") + " END",
    "primitive": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE alg_primitive END",
    "key_bits": f"CASE WHEN key_sizes <> '' AND p_size % 3 <> 0 THEN CAST(split_part(key_sizes, ',', CAST(1 + p_size % {count_of('key_sizes', ',')} AS INT)) AS INT) END",
    "parameter_set": f"CASE WHEN sets <> '' AND p_size % 3 <> 0 THEN split_part(split_part(sets, ' ', CAST(1 + p_size % {count_of('sets', ' ')} AS INT)), ':', 1) END",
    "curve": f"CASE WHEN security = 'curve' AND p_size % 3 <> 0 THEN {pick(CURVE_NAMES, '(p_size % 12)')} END",
    "mode": f"CASE WHEN alg_primitive = 'block-cipher' AND l_suppkey % 5 < 4 THEN {pick('ecb,cbc,ctr,gcm', '(l_suppkey % 5)')} END",
    "digest": f"CASE WHEN (security = 'digest' OR alg_primitive IN ('signature', 'pke')) AND l_suppkey % 4 < 3 THEN {pick('sha-1,sha-256,sha-384', '(l_suppkey % 4)')} END",
    "function_id": "CASE WHEN l_linenumber % 7 = 0 OR l_linenumber % 7 = 1 THEN concat(n_name, '::svc', CAST(l_suppkey AS STRING), '/f', CAST(l_orderkey % 50 AS STRING), '::fn', CAST(l_partkey % 4 AS STRING)) END",
    "function_name": "CASE WHEN l_linenumber % 7 = 0 OR l_linenumber % 7 = 1 THEN concat('fn', CAST(l_partkey % 4 AS STRING)) END",
    "api_style": f"CASE WHEN l_linenumber % 7 = 0 THEN {pick('fixed,provider,protocol', '(l_partkey % 3)')} END",
    "algorithm_source": f"CASE WHEN l_linenumber % 7 = 0 THEN {pick('literal,constant,dynamic,argument', '(l_suppkey % 4)')} END",
    "identifier": f"CASE WHEN l_linenumber % 7 = 0 THEN {pick(IDENTIFIERS, '(l_partkey % 24)')} END",
    "parameter": f"CASE WHEN l_linenumber % 7 = 0 THEN {pick(PARAMETERS, '(l_partkey % 6)')} END",
    "entry_kind": "CASE WHEN l_suppkey % 5 = 0 THEN 'http-route' WHEN l_suppkey % 5 = 1 THEN 'listener' WHEN l_suppkey % 5 = 2 THEN 'main' END",
    "seen": "CAST(l_shipdate AS DATE)",
}

#: The catalogue's columns that scoring reads.
CATALOGUE = ["alg_id", "alg_name", "alg_primitive", "quantum", "classical", "security", "fixed_strength", "output_bits", "min_key_bits", "key_sizes", "weak_modes", "alg_curve", "sets", "replacements"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(algorithm_rows(), ALGORITHM_SCHEMA)


#: Lines whose observation stands in a function, told before the joins.
STANDS = "l_linenumber % 7 = 0 OR l_linenumber % 7 = 1"


def observations(spark: SparkSession, sf_dir: str, lines: str = "true") -> DataFrame:
    """E1: one row for each sighting of an algorithm, of some lines only if asked. The catalogue has 70 rows and is broadcast."""
    rows = (
        read(spark, sf_dir, "lineitem").where(lines)
        .join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(catalogue(spark)), F.expr("l_partkey % 70") == F.col("alg_ord"))
    )
    return rows.select("alg_id", *(F.expr(e).alias(c) for c, e in OBSERVATION.items()))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations that stand in a function, with what the call graph reads of them."""
    rows = observations(spark, sf_dir, STANDS).where("function_id IS NOT NULL")
    return rows.select("obs_id", "order_id", "alg_id", "component", "path", "function_id", "function_name", "entry_kind")


def functions(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """E2: the functions that observations stand in (seen: the sightings); of a function's entry points the heaviest counts."""
    from postura.operators.graph import entry_weight

    return (
        (sightings(spark, sf_dir) if seen is None else seen)
        .groupBy("function_id").agg(F.first("component").alias("component"), F.first("path").alias("path"), F.first("function_name").alias("name"), F.min(F.when(F.col("entry_kind").isNotNull(), F.struct((-entry_weight(F.col("entry_kind"))).alias("w"), "entry_kind")))["entry_kind"].alias("entry_kind"))
    )


def calls(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """E3: within an order, each function's sighting calls, by name, the function of the next one."""
    from pyspark.sql import Window as W

    rows = sightings(spark, sf_dir) if seen is None else seen
    following = F.lead("function_name").over(W.partitionBy("order_id").orderBy("obs_id", "function_id", "alg_id"))
    return rows.select(F.col("function_id").alias("caller"), "component", "path", following.alias("callee")).where("callee IS NOT NULL").distinct()


def call_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """E2 and E3 of sightings that are joined once; these and the functions are written, as each is read several times."""
    seen = written(sightings(spark, sf_dir), "sightings")
    return written(functions(spark, sf_dir, seen), "functions"), calls(spark, sf_dir, seen)


TRACE = {
    "executable": "concat('svc', CAST(user_id % 20 AS STRING))",
    "function": "CASE event_type WHEN 'signup' THEN 'SSL_CTX_new' WHEN 'error' THEN 'exit' WHEN 'click' THEN 'EVP_aes_256_gcm' WHEN 'view' THEN 'EVP_sha256' ELSE 'RSA_generate_key_ex' END",
    "pid": "CAST(user_id % 97 AS BIGINT)",
}


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4: library calls seen at run time."""
    return read(spark, sf_dir, "events").select("event_id", "ts", "event_type", *(F.expr(e).alias(c) for c, e in TRACE.items()), F.get_json_object("props", "$.k").cast("long").alias("value"))


LIBRARY = {
    "component": "n_name",
    "name": pick(",".join(n for n, _ in LIBRARIES), "(s_suppkey % 9)"),
    "version": "concat(CAST(s_suppkey % 5 AS STRING), '.', CAST(s_suppkey % 11 AS STRING), '.', CAST(s_suppkey % 3 AS STRING))",
    "path": "concat('lib/', CAST(s_suppkey AS STRING))",
}


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7: libraries by component."""
    return read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(*(F.expr(e).alias(c) for c, e in LIBRARY.items()))


SERVING = {"listener_id": "CAST(s_suppkey AS BIGINT)", "component": "n_name", "path": "concat('svc', CAST(s_suppkey AS STRING), '/f', CAST(s_suppkey % 50 AS STRING))", "served": "concat('f', CAST(s_suppkey % 17 AS STRING))"}


def listeners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8: listeners by the configuration file that sets them up and a file that they serve."""
    return read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(*(F.expr(e).alias(c) for c, e in SERVING.items()))
