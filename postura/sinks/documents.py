"""Documents made of the analysis: inventory components, report rows, graph, checks of references.

Each is a table of JSON lines that Spark writes in parts; a single document is the sink's
last step over them, for inventories small enough for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROPERTIES = ["component", "tier", "priority", "liveness", "grade", "data_class", "confidence", "qb", "threat", "agility", "exposure_index", "action", "target", "effort"]


def properties(names: list[str] = PROPERTIES) -> Column:
    """Name and value pairs in a fixed order; those without a value are left out."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names))
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def components(advised: DataFrame) -> DataFrame:
    """(asset_id, json): a CycloneDX component for each asset."""
    parameters = F.struct(F.coalesce("primitive", "alg_primitive").alias("primitive"), F.coalesce(F.col("parameter_set"), F.col("key_bits").cast("string")).alias("parameterSetIdentifier"), "curve", "mode", F.col("level").alias("nistQuantumSecurityLevel"))
    crypto = F.struct(F.lit("algorithm").alias("assetType"), parameters.alias("algorithmProperties"))
    doc = F.struct(F.lit("cryptographic-asset").alias("type"), F.col("asset_id").alias("bom-ref"), F.col("alg_name").alias("name"), crypto.alias("cryptoProperties"), properties().alias("properties"))
    return advised.select("asset_id", F.to_json(doc).alias("json"))


def dependencies(links: DataFrame) -> DataFrame:
    """(asset_id, json): what each asset depends on, sorted."""
    return links.groupBy("asset_id").agg(F.array_sort(F.collect_set("depends_on")).alias("d")).select("asset_id", F.to_json(F.struct(F.col("asset_id").alias("ref"), F.col("d").alias("dependsOn"))).alias("json"))


def report(advised: DataFrame) -> DataFrame:
    """Rows of the report, by priority, then id."""
    return advised.select("priority", "asset_id", F.to_json(F.struct("asset_id", *PROPERTIES)).alias("json")).orderBy(F.desc("priority"), "asset_id")


def write(documents: DataFrame, path: str) -> None:
    """One JSON line a document, in parts sorted by id."""
    documents.repartitionByRange("asset_id").sortWithinPartitions("asset_id").select("json").write.mode("overwrite").text(path)


def unresolved(components: DataFrame, links: DataFrame) -> DataFrame:
    """References to no component."""
    return links.join(components.select(F.col("asset_id").alias("depends_on")), "depends_on", "left_anti").select("asset_id", "depends_on")


def repeated(components: DataFrame) -> DataFrame:
    """Ids of more than one component."""
    return components.groupBy("asset_id").agg(F.count("*").alias("n")).where("n > 1")


def edges(assets: DataFrame, links: DataFrame, calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(source, target, kind) of the cryptography graph, each once."""
    named = lambda df, s, t, kind: df.select(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(kind).alias("kind"))
    data = assets.select("asset_id", F.concat(F.lit("data/"), "data_class", F.lit("/"), F.substring(F.sha2(F.concat_ws("|", "data_class", "asset_id"), 256), 1, 16)).alias("data"))
    parts = [named(assets, "component", "asset_id", "contains"), named(links, "asset_id", "depends_on", "depends-on"), named(calls, "caller", "target", "calls"), named(uses.where("function_id IS NOT NULL"), "function_id", "asset_id", "uses"), named(data, "asset_id", "data", "protects")]
    return reduce(DataFrame.unionByName, parts).distinct()


# --- chains over a document's components


def listed(files: DataFrame) -> DataFrame:
    """(path, position, bom_ref, text) of the components of inventory documents (path, text), in their order, as canonical JSON; other documents have none."""
    found = F.try_variant_get(F.try_parse_json("text"), "$.components", "array<variant>")
    rows = files.select("path", F.posexplode(found).alias("position", "c"))
    return rows.select("path", "position", F.coalesce(F.try_variant_get("c", "$['bom-ref']", "string"), F.lit("")).alias("bom_ref"), F.to_json("c").alias("text"))


def chained(components: DataFrame) -> DataFrame:
    """(path, position, bom_ref, digest): a digest over each component's text and the digest before it, from 32 zero bytes on; the last one stands for the document.

    components: (path, position, bom_ref, text). A chain has to be followed one by one: a
    document's components come sorted to one task, which holds the digest so far and a batch.
    """
    schema = "path string, position int, bom_ref string, digest string"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, before = None, bytes(32)
        for b in batches:
            out = []
            for here, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                before = hashlib.sha256((before if here == path else bytes(32)) + text.encode()).digest()
                path = here
                out.append(before.hex())
            yield pa.record_batch([*b.columns[:3], pa.array(out, pa.string())], ["path", "position", "bom_ref", "digest"])

    rows = components.where("path IS NOT NULL").select("path", F.col("position").cast("int").alias("position"), "bom_ref", F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("path").sortWithinPartitions("path", "position").mapInArrow(follow, schema)


def departures(chain: DataFrame, signed: DataFrame) -> DataFrame:
    """(path, position, bom_ref, signed_ref) of the first component of each document whose digest is not the signed one; either may have ended there."""
    there = signed.select("path", "position", F.col("bom_ref").alias("signed_ref"), F.col("digest").alias("signed_digest"))
    apart = chain.join(there, ["path", "position"], "full").where(~F.col("digest").eqNullSafe(F.col("signed_digest")))
    return apart.groupBy("path").agg(F.min(F.struct("position", "bom_ref", "signed_ref")).alias("a")).select("path", "a.*")
