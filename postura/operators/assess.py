"""Scores of an asset: strength, quantum breakability, agility, urgency, priority and tier.

Everything here is a projection over one row per asset; the catalogue (70 algorithms and a
dozen curves) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postura.knowledge import CURVES
from postura.policy import DEFAULT, Policy

#: Classical statuses from best to worst.
STATUSES = ["acceptable", "legacy", "disallowed", "broken"]
TIERS = ["info", "low", "medium", "high", "critical"]


def ordinal(status: Column) -> Column:
    return sum((F.when(status == s, i).otherwise(0) for i, s in enumerate(STATUSES)), F.lit(0))


def round2(value: Column) -> Column:
    return F.round(value * 100) / 100


def curve_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s, c) for n, s, c, _ in CURVES], "curve_name string, curve_strength int, curve_status string")


def factoring_strength(bits: Column) -> Column:
    return F.when(bits < 1024, 0).when(bits < 2048, 80).when(bits < 3072, 112).when(bits < 7680, 128).when(bits < 15360, 192).when(bits >= 15360, 256)


def set_field(sets: Column, name: Column, field: int) -> Column:
    """A field of the parameter set of that name, out of "name:category:strength ..."."""
    found = F.filter(F.split(sets, " "), lambda s: F.split_part(s, F.lit(":"), F.lit(1)) == name)
    return F.when(name.isNotNull() & (F.size(found) > 0), F.split_part(F.try_element_at(found, F.lit(1)), F.lit(":"), F.lit(field))).cast("int")


def with_strength(assets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds the catalogue's columns, bits, status (0 to 3) and level."""
    spark = assets.sparkSession
    digests = catalogue.select(F.col("alg_id").alias("d_id"), F.col("output_bits").alias("d_bits"), F.col("classical").alias("d_status"))
    rows = assets.join(F.broadcast(catalogue), "alg_id").join(F.broadcast(digests), F.col("digest") == F.col("d_id"), "left")
    curve = F.coalesce("curve", F.when(F.col("alg_curve") != "", F.col("alg_curve")))
    rows = rows.join(F.broadcast(curve_table(spark)), (F.col("security") == "curve") & (curve == F.col("curve_name")), "left")
    single = F.when((F.col("key_sizes") != "") & ~F.col("key_sizes").contains(","), F.col("key_sizes").cast("int"))
    s = F.col("security")
    bits = (
        F.when(s == "fixed", F.col("fixed_strength")).when(s == "key-bits", F.coalesce("key_bits", single))
        .when(s == "integer-factoring", factoring_strength(F.col("key_bits"))).when(s == "hash-output", F.floor(F.col("output_bits") / 2).cast("int"))
        .when(s == "parameter-set", set_field(F.col("sets"), F.col("parameter_set"), 3)).when(s == "curve", F.col("curve_strength")).when(s == "digest", F.col("d_bits"))
    )
    status = F.greatest(
        ordinal(F.col("classical")),
        F.when(s == "curve", ordinal(F.col("curve_status"))).otherwise(0),
        F.when(F.col("key_bits") < F.col("min_key_bits"), 2).otherwise(0),
        F.when(F.expr("mode IS NOT NULL AND array_contains(split(weak_modes, ','), lower(mode))"), 1).otherwise(0),
        F.when(F.col("alg_primitive").isin("signature", "pke"), ordinal(F.col("d_status"))).otherwise(0),
    )
    b, out = F.col("bits"), F.coalesce("output_bits", F.lit(0))
    grover = (
        F.when((F.col("classical") == "broken") | b.isNull(), 0)
        .when(F.col("alg_primitive") == "hash", F.when(out >= 512, 5).when(out >= 384, 4).when(out >= 256, 2).otherwise(0))
        .otherwise(F.when(b >= 256, 5).when(b >= 192, 3).when(b >= 128, 1).otherwise(0))
    )
    level = F.when(F.col("quantum") == "shor", 0).when(F.col("quantum") == "post-quantum", F.coalesce(set_field(F.col("sets"), F.col("parameter_set"), 2), F.lit(1))).otherwise(grover)
    return rows.withColumn("bits", bits).withColumn("status", status).withColumn("level", level).drop("d_id", "d_bits", "d_status", "curve_name", "curve_strength", "curve_status")


def breakability() -> Column:
    out = F.coalesce("output_bits", "fixed_strength")
    return (
        F.when((F.col("status") == 3) & (F.col("quantum") != "post-quantum"), 1.0)
        .when(F.col("quantum") == "shor", 1.0).when(F.col("quantum") == "post-quantum", 0.0)
        .when(F.col("alg_primitive").isin("hash", "xof"), F.when(out >= 384, 0.1).when(out >= 256, 0.2).otherwise(0.5))
        .otherwise(F.when(F.col("bits") >= 256, 0.1).otherwise(0.5))
    )


def threat() -> Column:
    p = F.coalesce("primitive", "alg_primitive")
    return F.when(p == "signature", "forge").when(p.isin("hash", "xof", "mac", "kdf", "drbg"), "integrity").otherwise("harvest")


def agility(policy: Policy = DEFAULT) -> list[Column]:
    """The five factors' points; an asset's columns uses, configured and so on say what they rest on."""
    full = policy.provider_interface
    provider = F.when(F.col("uses") > 0, F.round(full * (F.col("via_provider") / F.col("uses"))).cast("int")).when(F.col("configured") == 1, full).otherwise(0)
    config = F.when((F.col("configured") == 1) | (F.col("dynamic") == 1), policy.config_driven).when(F.col("constant") == 1, policy.config_driven // 2).otherwise(0)
    c = policy.centralised
    central = F.when(F.col("places") <= 1, c).when(F.col("places") == 2, c * 2 // 3).when(F.col("places") <= 5, c // 3).otherwise(0)
    return [
        provider.alias("a_provider"), config.alias("a_config"), F.when(F.col("negotiated") == 1, policy.negotiation).otherwise(0).alias("a_negotiation"), central.alias("a_centralised"),
        F.when((F.col("qb") == 0) | (F.col("pqc_library") == 1), policy.pqc_ready).otherwise(0).alias("a_ready"),
    ]


def assessed(assets: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Adds every score to assets with strength, data class, exposure and pqc_library."""
    rows = assets.withColumn("qb", breakability()).withColumn("threat", threat())
    rows = rows.select("*", *agility(policy))
    score = F.least(F.col("a_provider") + F.col("a_config") + F.col("a_negotiation") + F.col("a_centralised") + F.col("a_ready"), F.lit(100))
    rows = rows.withColumn("agility", score)
    year = policy.assessment_year
    early, late = float(max(0, policy.earliest_year - year)), float(max(0, policy.latest_year - year))
    rows = rows.withColumn("y_years", round2(policy.base_years + (100 - F.col("agility")) * policy.years_per_point))
    vulnerable = F.col("qb") >= 0.5
    total = F.col("lifetime") + F.col("y_years")
    weight = F.when(F.col("liveness") == "confirmed", policy.liveness["confirmed"]).when(F.col("liveness") == "configured", policy.liveness["configured"]).otherwise(policy.liveness["capable"])
    share = F.least(F.greatest(F.col("lifetime") / policy.lifetime_cap, F.lit(0.0)), F.lit(1.0))
    rows = rows.select(
        "*", (vulnerable & (total > early)).alias("urgent"), (vulnerable & (total > late)).alias("urgent_even_if_late"), round2(total - early).alias("urgency_years"),
        round2(100.0 * F.col("exposure") * share * F.col("qb") * weight).alias("exposure_index"),
    )
    floor = F.when(F.col("status") == 3, 90.0).when(F.col("status") == 2, 70.0).when(F.col("status") == 1, 35.0).otherwise(0.0)
    p = F.greatest(F.col("exposure_index"), floor)
    p = p + F.when(F.col("urgent"), 15.0).otherwise(0.0) + F.when(F.col("urgent_even_if_late"), 10.0).otherwise(0.0)
    p = p + F.when((F.col("criticality") == "critical") & vulnerable, 5.0).otherwise(0.0)
    p = F.when((F.col("qb") == 0) & (F.col("status") == 0), F.least(p, F.lit(5.0))).otherwise(p)
    priority = F.round(F.least(F.greatest(p, F.lit(0.0)), F.lit(100.0))).cast("int")
    return rows.withColumn("priority", priority).withColumn("tier", tier(F.col("priority")))


def tier(priority: Column) -> Column:
    return F.when(priority >= 80, "critical").when(priority >= 60, "high").when(priority >= 35, "medium").when(priority >= 10, "low").otherwise("info")


def tier_ordinal(name: Column) -> Column:
    """0 for no tier, then from info to critical."""
    return sum((F.when(name == t, i + 1).otherwise(0) for i, t in enumerate(TIERS)), F.lit(0))
