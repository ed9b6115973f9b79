"""Which data an asset protects, from the names around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postura.knowledge import DATA_CLASSES
from postura.policy import DEFAULT, Policy

# Weight of a name by where it stands, in tenths.
WEIGHTS = {"argument": 10, "parameter": 7, "function": 6, "path": 4}


def tokenize(name: Column) -> Column:
    """Words of a name: at signs, camel case, acronyms and between digits and letters; lower case."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def candidates(name: Column) -> Column:
    """Tokens and neighbouring tokens joined."""
    t = tokenize(name)
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat(a, b)))
    return F.concat(t, F.coalesce(pairs, F.array().cast("array<string>")))


def dictionary(spark: SparkSession) -> DataFrame:
    """(token, class_idx, data_class, lifetime, criticality): terms with their tokens joined."""
    rows = sorted({(t.replace("_", ""), i, c, life, crit) for i, c, life, crit, terms in DATA_CLASSES for t in terms.split()})
    return spark.createDataFrame(rows, "token string, class_idx int, data_class string, lifetime double, criticality string")


def names(occurrences: DataFrame) -> DataFrame:
    """(asset_id, source, name) of every name around an asset, as often as it stands there."""
    found = F.array(
        F.struct(F.lit("argument").alias("source"), F.col("identifier").alias("name")),
        F.struct(F.lit("function").alias("source"), F.when(F.col("api_style").isNotNull(), F.col("function_name")).alias("name")),
        F.struct(F.lit("parameter").alias("source"), F.col("parameter").alias("name")),
        F.struct(F.lit("path").alias("source"), F.col("path").alias("name")),
    )
    return occurrences.select("asset_id", F.explode(found).alias("e")).select("asset_id", "e.*").where("name IS NOT NULL")


def evidence(occurrences: DataFrame) -> DataFrame:
    """(asset_id, source, name) of every name around an asset, each once."""
    return names(occurrences).distinct()


def terms(names: DataFrame) -> DataFrame:
    """The terms (token, class_idx, data_class, lifetime, criticality) that each different name holds."""
    return names.select("name").distinct().select("name", F.explode(candidates(F.col("name"))).alias("token")).distinct().join(F.broadcast(dictionary(names.sparkSession)), "token")


def scores(evidence: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(asset_id, class_idx, data_class, lifetime, criticality, score): tenths, each token once at its best weight.

    known: terms() of the evidence, which may be names() then, as no name is taken apart twice.
    """
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    if known is not None:
        hits = evidence.join(known, "name")
    else:
        found = evidence.select("asset_id", "source", F.explode(candidates(F.col("name"))).alias("token"))
        hits = found.join(F.broadcast(dictionary(evidence.sparkSession)), "token")
    best = hits.groupBy("asset_id", "class_idx", "data_class", "lifetime", "criticality", "token").agg(F.max(weight[F.col("source")]).alias("w"))
    return best.groupBy("asset_id", "class_idx", "data_class", "lifetime", "criticality").agg(F.sum("w").cast("long").alias("score"))


def best(scores: DataFrame) -> DataFrame:
    """One row for each classified asset: highest score, then longest secrecy, then the later class."""
    top = scores.groupBy("asset_id").agg(F.max(F.struct("score", "lifetime", "class_idx", "data_class", "criticality")).alias("t"))
    confidence = F.round(F.least(F.lit(0.35) + F.lit(0.2) * (F.col("t.score") / 10.0), F.lit(0.95)) * 100) / 100
    return top.select("asset_id", "t.data_class", F.col("t.lifetime"), "t.criticality", "t.score", confidence.alias("confidence"))


#: Matches that an explanation names, and characters of a name in it.
NAMED_MATCHES, NAME_LENGTH = 3, 64


def explained(assets: DataFrame, evidence: DataFrame, best: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(asset_id, explanation) of every asset: its class, how long it stays secret, and the first matches of its terms.

    A term counts where its weight is highest, of several names there by the least one. Matches
    come by place (argument, function, parameter, path), then by name and term.
    """
    order = ["argument", "function", "parameter", "path"]
    weight, place = (F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in (WEIGHTS, {s: i for i, s in enumerate(order)}))
    found = evidence.select("asset_id", "source", F.left("name", F.lit(NAME_LENGTH)).alias("name"), F.explode(candidates(F.col("name"))).alias("token"))
    hits = found.join(F.broadcast(dictionary(evidence.sparkSession).select("token", "data_class")), "token").join(best.select("asset_id", "data_class"), ["asset_id", "data_class"])
    first = hits.groupBy("asset_id", "token").agg(F.min(F.struct((-weight[F.col("source")]).alias("w"), place[F.col("source")].alias("place"), "name", "source")).alias("m"))
    said = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("m.place", "m.name", "token", "m.source"))), 1, NAMED_MATCHES), lambda m: F.concat(m["source"], F.lit(" `"), m["name"], F.lit("` matches term `"), m["token"], F.lit("`")))  # as many as a class has terms
    matches = first.groupBy("asset_id").agg(F.array_join(said, "; ").alias("matches"))
    years = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    rows = assets.select("asset_id").join(best.select("asset_id", "data_class", "lifetime"), "asset_id", "left").join(matches, "asset_id", "left")
    known = F.concat("data_class", F.lit(" data (secrecy "), years(F.col("lifetime")), F.lit(" years): "), "matches")
    default = F.concat(F.lit("no name around this asset identifies its data; the policy default of "), years(F.lit(policy.default_lifetime)), F.lit(" years applies"))
    return rows.select("asset_id", F.coalesce(known, default).alias("explanation"))


def classified(assets: DataFrame, best: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Assets with their data class; those without a use inherit their component's most sensitive one."""
    order = F.when(F.col("criticality") == "critical", 3).when(F.col("criticality") == "high", 2).when(F.col("criticality") == "medium", 1).otherwise(0)
    own = assets.join(best, "asset_id", "left")
    known = own.where("data_class IS NOT NULL").withColumn("rank", order)
    # on equal rank the first asset's: an order whose last part is unique
    by_component = known.groupBy("component").agg(
        F.min(F.struct((-F.col("rank")).alias("r"), (-F.col("lifetime")).alias("l"), "asset_id", "data_class", "lifetime", "criticality", "confidence")).alias("c")
    )
    inherits = F.col("data_class").isNull() & (F.col("uses") == 0) & F.col("c").isNotNull()
    pick = lambda c, default: F.when(inherits, F.col(f"c.{c}")).otherwise(F.coalesce(F.col(c), default)).alias(c)
    faded = F.round(F.col("c.confidence") * 0.8 * 100) / 100
    return own.join(by_component, "component", "left").select(
        *assets.columns, pick("data_class", F.lit("unclassified")), pick("lifetime", F.lit(policy.default_lifetime)), pick("criticality", F.lit(policy.default_criticality)),
        F.when(inherits, faded).otherwise(F.coalesce("confidence", F.lit(0.25))).alias("confidence"), inherits.alias("inherited"),
    )
