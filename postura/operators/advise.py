"""What to do about an asset: recommendation, effort, roadmap and plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postura.policy import DEFAULT, Policy


def recommendation() -> Column:
    """struct(action, target), by the first rule that holds; the targets' wording is fixed."""
    p = F.coalesce("primitive", "alg_primitive")
    shor, broken, qb = F.col("quantum") == "shor", F.col("status") == 3, F.col("qb")
    say = lambda action, target: F.struct(F.lit(action).alias("action"), (target if isinstance(target, Column) else F.lit(target)).alias("target"))
    signatures = F.when(F.col("lifetime") >= 25, "87").otherwise("65")
    cipher = p.isin("block-cipher", "stream-cipher", "ae")
    first = F.split_part(F.split_part("replacements", F.lit(","), F.lit(1)), F.lit("="), F.lit(2))
    return (
        F.when(F.col("quantum") == "post-quantum", say("retain", F.when(F.col("parameter_set").isin("512", "44"), F.concat("alg_name", F.lit(" at NIST level 3 or higher"))).otherwise(F.concat("alg_name", F.lit(" (verify implementation)")))))
        .when(p.isin("key-agree", "kem", "pke") & shor, say("replace", "hybrid X25519 + ML-KEM-768 (FIPS 203)"))
        .when((p == "signature") & shor, say("replace", F.concat(F.lit("ML-DSA-"), signatures, F.lit(" (FIPS 204), or SLH-DSA for long-term roots"))))
        .when((p == "hash") & ~broken & (qb > 0.2), say("replace", "SHA-384 (or SHA3-384)"))
        .when((p == "mac") & (F.col("alg_id") == "hmac") & F.col("digest").isNull(), say("review", "the HMAC digest: SHA-256 or stronger"))
        .when((p == "xof") & ~broken & (qb > 0.2), say("replace", "SHAKE256"))
        .when((p == "kdf") & (F.col("alg_id") == "pbkdf2") & ~broken & (qb > 0.2), say("upgrade", "PBKDF2-HMAC-SHA-256 deriving 256-bit keys at ≥600,000 iterations, or Argon2id"))
        .when(p.isin("hash", "xof") & broken, say("replace", "SHA-384 (or SHA3-384)"))
        .when(p.isin("mac", "kdf") & F.col("digest").isin("sha-1", "md5"), say("upgrade", F.when(F.col("alg_id") == "pbkdf2", "Argon2id, or PBKDF2-HMAC-SHA-256 at ≥600,000 iterations").otherwise(F.concat("alg_name", F.lit("-SHA-256")))))
        .when(cipher & (F.coalesce(F.col("mode") == "ecb", F.lit(False)) | broken | (qb >= 0.5) | (F.col("status") > 0)), say("replace", "AES-256-GCM"))
        .when(cipher | ((qb <= 0.2) & ~broken), say("retain", F.col("alg_name")))
        .otherwise(say("replace", F.when(first != "", first).otherwise("an approved replacement")))
    )


def key_exchange_bytes() -> Column:
    c, modulus = F.col("curve"), F.floor(F.coalesce("key_bits", F.lit(2048)) / 8) * 2
    return (
        F.when(F.col("alg_id") == "x25519", 64).when(F.col("alg_id") == "x448", 112)
        .when(F.col("alg_id") == "ecdh", F.when(c == "P-384", 194).when(c == "P-521", 266).otherwise(130))
        .when(F.col("alg_id").isin("dh", "rsa"), modulus).otherwise(64)
    )


def signature_bytes() -> Column:
    c, modulus = F.col("curve"), F.floor(F.coalesce("key_bits", F.lit(2048)) / 8) * 2
    return (
        F.when(F.col("alg_id") == "ed25519", 96).when(F.col("alg_id") == "ed448", 171)
        .when(F.col("alg_id") == "ecdsa", F.when(c == "P-384", 201).when(c == "P-521", 272).otherwise(137))
        .when(F.col("alg_id").isin("rsa", "dsa"), modulus).otherwise(128)
    )


def advised(assessed: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Adds action, target, bytes before and after, and effort in person-weeks (null for retain)."""
    rows = assessed.withColumn("r", recommendation()).select("*", F.col("r.action").alias("action"), F.col("r.target").alias("target")).drop("r")
    p = F.coalesce("primitive", "alg_primitive")
    swapped = (F.col("quantum") == "shor") & (F.col("action") == "replace")
    exchange, signature = swapped & p.isin("key-agree", "kem", "pke"), swapped & (p == "signature")
    before = F.when(exchange, key_exchange_bytes()).when(signature, signature_bytes()).cast("long")
    # public key and ciphertext of the hybrid, or public key and signature of ML-DSA
    after = F.when(exchange, 1216 + 1120).when(signature, F.when(F.col("lifetime") >= 25, 2592 + 4627).otherwise(1952 + 3309)).cast("long")
    table = lambda d, key: F.coalesce(F.create_map(*(F.lit(x) for kv in d.items() for x in kv))[key], F.lit(1.0))
    weeks = (
        table(policy.action_weeks, F.col("action")) * F.coalesce("surface_effort", F.lit(1.0)) * (1.0 + (100 - F.col("agility")) / 100.0 * policy.agility_penalty)
        * (1.0 + policy.spread * F.ln(F.greatest(F.col("files"), F.lit(1)))) * table(policy.criticality_effort, F.col("criticality"))
    )
    effort = F.when(F.col("action") != "retain", F.greatest(F.round(weeks * 10) / 10, F.lit(0.1)))
    return rows.withColumn("before_bytes", before).withColumn("after_bytes", after).withColumn("effort", effort)


def wave() -> Column:
    urgent = F.col("tier").isin("high", "critical")
    return F.when(urgent & (F.col("agility") >= 60), 1).when(urgent, 2).when(F.col("tier") == "medium", 3).otherwise(4)


def roadmap(advised: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """What changes, by wave, priority, agility and id (sort at the sink)."""
    due = F.create_map(*(F.lit(x) for i, y in enumerate(policy.wave_due) for x in (i + 1, y)))
    rows = advised.where("action <> 'retain'").withColumn("wave", wave())
    return rows.select("wave", "asset_id", "component", "tier", "priority", "agility", F.col("y_years").alias("migration_years"), "action", "target", "effort", due[F.col("wave")].alias("due_year"))


def plan(roadmap: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Four waves, also empty ones: items, weeks, running total, engineers needed, overdue."""
    waves = roadmap.sparkSession.createDataFrame([(i + 1, policy.wave_due[i] if i < len(policy.wave_due) else None) for i in range(4)], "wave int, due_year int")
    # tenths add up exactly in any order
    sums = roadmap.groupBy("wave").agg(F.count("*").alias("items"), F.sum(F.round(F.col("effort") * 10).cast("long")).alias("tenths"))
    rows = waves.join(sums, "wave", "left").select("wave", "due_year", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("tenths", F.lit(0)).alias("tenths"))
    running = F.sum("tenths").over(W.partitionBy(F.lit(1)).orderBy("wave").rowsBetween(W.unboundedPreceding, 0))  # four rows
    year = policy.assessment_year
    available = F.when(F.col("due_year") >= year, (F.col("due_year") - year + 1) * policy.working_weeks)
    rows = rows.withColumn("cumulative", running / 10.0).withColumn("weeks_available", available)
    return rows.select(
        "wave", "items", (F.col("tenths") / 10.0).alias("person_weeks"), "due_year", "cumulative", "weeks_available",
        (F.round(F.col("cumulative") / F.col("weeks_available") * 10) / 10).alias("engineers_needed"),
        F.coalesce((F.col("due_year") < year) & (F.col("cumulative") > 0), F.lit(False)).alias("overdue"),
    )



def engineers(plan: DataFrame) -> DataFrame:
    """(engineers_needed, overdue, person_weeks): the most that any wave needs, whether one is overdue, and the weeks of all."""
    return plan.agg(F.max("engineers_needed").alias("engineers_needed"), F.max("overdue").alias("overdue"), F.max("cumulative").alias("person_weeks"))
