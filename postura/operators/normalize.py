"""From observations to assets: identity, dependencies, grouping, liveness, evidence grade, refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMS = ["key_bits", "parameter_set", "curve", "mode", "digest"]
#: Columns that make an asset's identity.
IDENTITY = ["component", "alg_id", "primitive", *PARAMS]
OCCURRENCE = ["surface", "path", "line", "rule_id", "kind", "function_id", "function_name", "api_style", "algorithm_source", "identifier", "parameter", "entry_kind"]


def identity_key() -> Column:
    part = lambda c: F.coalesce(F.lower(F.col(c).cast("string")), F.lit(""))
    fixed = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws("|", "component", F.lit("algorithm"), "alg_id", fixed("primitive"), *map(part, PARAMS))


def asset_id() -> Column:
    return F.concat(F.lit("crypto/algorithm/"), "alg_id", F.lit("/"), F.substring(F.sha2(identity_key(), 256), 1, 16))


def layer() -> Column:
    """The evidence layer of a surface."""
    return F.when(F.col("surface") == "source", "source-code").when(F.col("surface") == "runtime", "runtime").otherwise("artifact")


def identified(observations: DataFrame) -> DataFrame:
    return observations.withColumn("asset_id", asset_id())


def expand_dependencies(observations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The observations and, for digests of algorithms that are not MAC, KDF or DRBG, one of the digest itself."""
    kinds = catalogue.select("alg_id", "alg_primitive", F.lit(True).alias("__known"))
    derives = F.col("__known") & F.col("digest").isNotNull() & ~F.coalesce("primitive", "alg_primitive").isin("mac", "kdf", "drbg")
    rows = observations.join(F.broadcast(kinds), "alg_id", "left").withColumn("__derived", F.explode(F.when(derives, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    own = lambda c: F.col(c) if c not in ("alg_id", "rule_id", "primitive", *PARAMS) else F.when(~F.col("__derived"), F.col(c))
    other = {"alg_id": F.col("digest"), "rule_id": F.concat("rule_id", F.lit("#dependency"))}
    return rows.select(*((own(c).otherwise(other[c]) if c in other else own(c)).alias(c) for c in observations.columns))


def dependency_links(observations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(asset_id, depends_on): assets and their digests' assets in the same component."""
    digest = observations.where("digest IS NOT NULL").join(F.broadcast(catalogue.select("alg_id", "alg_primitive")), "alg_id")
    digest = digest.where(~F.coalesce("primitive", "alg_primitive").isin("mac", "kdf", "drbg"))
    bare = F.concat_ws("|", "component", F.lit("algorithm"), "digest", *[F.lit("")] * 6)
    target = F.concat(F.lit("crypto/algorithm/"), "digest", F.lit("/"), F.substring(F.sha2(bare, 256), 1, 16))
    return digest.select(asset_id().alias("asset_id"), target.alias("depends_on")).distinct()


def occurrences(observations: DataFrame) -> DataFrame:
    """Distinct occurrences with their asset."""
    return identified(observations).select("asset_id", *IDENTITY, *OCCURRENCE).distinct()


def assets(occurrences: DataFrame) -> DataFrame:
    """One row for each identity: what scoring needs to know of its occurrences.

    Distinct places are counted in two steps, so that no set is held for an asset.
    """
    surface = F.col("surface")
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    usage = F.col("api_style").isNotNull()
    place = F.coalesce("function_id", "path")
    sound = F.col("kind") != "heuristic"
    effort = F.create_map(*(F.lit(x) for kv in {"source": 1.5, "binary": 2.0, "container": 1.2, "certificate": 1.0, "config": 0.6, "cloud": 0.8}.items() for x in kv))
    rule = F.col("rule_id")
    partial = [
        F.count("*").alias("n"), flag(surface == "runtime").alias("runtime"), flag(surface.isin("config", "cloud", "certificate")).alias("declared"),
        flag((surface == "source") & (F.col("kind") == "api-call")).alias("called"), flag(surface.isin("config", "cloud")).alias("configured"),
        flag(sound & (surface == "source")).alias("in_source"), flag(sound & (surface == "runtime")).alias("in_runtime"), flag(sound & ~surface.isin("source", "runtime")).alias("in_artifact"),
        count(usage).alias("uses"), count(F.col("api_style").isin("provider", "protocol")).alias("via_provider"),
        flag(F.col("algorithm_source") == "dynamic").alias("dynamic"), flag(F.col("algorithm_source") == "constant").alias("constant"),
        flag((F.col("api_style") == "protocol") | rule.contains("cipher") | rule.contains("group") | rule.contains("ssl") | rule.contains("tls") | rule.contains("ssh")).alias("negotiated"),
        F.max(effort[surface]).alias("surface_effort"),
    ]
    by_place = occurrences.groupBy("asset_id", *IDENTITY, place.alias("place"), F.when(surface != "runtime", F.col("path")).alias("file")).agg(*partial)
    sums = {"n", "uses", "via_provider"}
    names = ["n", "runtime", "declared", "called", "configured", "in_source", "in_runtime", "in_artifact", "uses", "via_provider", "dynamic", "constant", "negotiated", "surface_effort"]
    grouped = by_place.groupBy("asset_id", *IDENTITY).agg(
        *((F.sum(c) if c in sums else F.max(c)).alias(c) for c in names), F.countDistinct("place").alias("places"), F.countDistinct("file").alias("files")
    )
    layers = F.col("in_source") + F.col("in_runtime") + F.col("in_artifact")
    return grouped.select(
        "asset_id", *IDENTITY, *names, "places", "files",
        F.when(F.col("runtime") == 1, "confirmed").when((F.col("declared") == 1) | (F.col("called") == 1), "configured").otherwise("capable").alias("liveness"),
        F.element_at(F.array(*map(F.lit, "DCBA")), (layers + 1).cast("int")).alias("grade"),
    )


def refinements(assets: DataFrame) -> DataFrame:
    """(asset_id, refined_to): groups that are folded into the only maximal group that says more.

    b refines a in the same component and algorithm if a's primitive is unknown or equal,
    every parameter that a knows is b's, and their parameters differ. The join is by
    component and algorithm; rows on each side are distinct identities, not occurrences.
    """
    cols = ["asset_id", *IDENTITY]
    side = lambda s: assets.select(*(F.col(c).alias(f"{s}_{c}") for c in cols))
    a, b = side("a"), side("b")
    knows = F.col("a_primitive").isNull() | F.col("a_primitive").eqNullSafe(F.col("b_primitive"))
    differ = F.lit(False)
    for p in PARAMS:
        knows = knows & (F.col(f"a_{p}").isNull() | F.col(f"a_{p}").eqNullSafe(F.col(f"b_{p}")))
        differ = differ | ~F.col(f"a_{p}").eqNullSafe(F.col(f"b_{p}"))
    same = (F.col("a_component") == F.col("b_component")) & (F.col("a_alg_id") == F.col("b_alg_id"))
    pairs = a.join(b, same & knows & differ).select(F.col("a_asset_id").alias("asset_id"), F.col("b_asset_id").alias("target"))
    # a candidate is maximal if no other one says more than it
    refined = pairs.select(F.col("asset_id").alias("target")).distinct()
    maximal = pairs.join(refined, "target", "left_anti")
    return maximal.groupBy("asset_id").agg(F.count("*").alias("n"), F.min("target").alias("refined_to")).where("n = 1").drop("n")


def folded(occurrences: DataFrame, assets: DataFrame) -> DataFrame:
    """The occurrences with refined ones moved to their target's identity."""
    moves = refinements(assets)
    target = assets.select(F.col("asset_id").alias("refined_to"), *(F.col(c).alias(f"to_{c}") for c in IDENTITY))
    moved = occurrences.join(moves.join(target, "refined_to"), "asset_id", "left")
    pick = lambda c: F.when(F.col("refined_to").isNotNull(), F.col(f"to_{c}")).otherwise(F.col(c)).alias(c)
    return moved.select(F.coalesce("refined_to", "asset_id").alias("asset_id"), *map(pick, IDENTITY), *OCCURRENCE).distinct()
