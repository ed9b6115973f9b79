"""Counts and tables over assessed assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura.operators.assess import TIERS


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def totals(assets: DataFrame) -> DataFrame:
    return assets.agg(
        F.count("*").alias("assets"), count_if(F.col("qb") >= 0.5).alias("quantum_vulnerable"), count_if(F.col("status") == 3).alias("broken"),
        count_if(F.col("urgent")).alias("urgent"), count_if(F.col("tier") == "critical").alias("critical"), count_if(F.col("tier") == "high").alias("high"),
        count_if(F.col("qb") == 0).alias("post_quantum"), count_if(F.col("liveness") == "confirmed").alias("confirmed"),
    )


def tier_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("component", "tier").agg(F.count("*").alias("assets"))


def component_risk(assets: DataFrame) -> DataFrame:
    return assets.groupBy("component").agg(
        F.count("*").alias("assets"), count_if(F.col("tier") == "critical").alias("critical"), count_if(F.col("tier") == "high").alias("high"), F.max("priority").alias("max_priority")
    )


def top_components(assets: DataFrame, n: int = 12) -> DataFrame:
    return component_risk(assets).orderBy(F.desc("max_priority"), F.desc("critical"), "component").limit(n)


def heatmap(assets: DataFrame) -> DataFrame:
    """Assets by component and tier, every tier a column."""
    rows = assets.groupBy("component").pivot("tier", TIERS).agg(F.count(F.lit(1))).na.fill(0, TIERS)
    return rows.withColumn("rank_score", 1000 * F.col("critical") + 100 * F.col("high") + 10 * F.col("medium") + F.col("low"))


def threat_split(assets: DataFrame) -> DataFrame:
    return assets.where((F.col("qb") >= 0.5) | (F.col("status") == 3)).groupBy("threat").agg(F.count("*").alias("assets"))


def fix_first(advised: DataFrame, n: int = 15) -> DataFrame:
    return advised.where("action <> 'retain'").orderBy(F.desc("priority"), "asset_id").limit(n).select("asset_id", "component", "priority", "tier", "action", "target")


def mosca_timeline(assets: DataFrame, n: int = 16) -> DataFrame:
    total = F.round((F.col("lifetime") + F.col("y_years")) * 100) / 100
    return assets.where("qb >= 0.5").select("asset_id", "lifetime", "y_years", total.alias("total")).orderBy(F.desc("total"), "asset_id").limit(n)


def inventory(
    assets: DataFrame, tier: str | None = None, threat: str | None = None, component: str | None = None, text: str | None = None, primitive: str | None = None, reachable: bool = False,
) -> DataFrame:
    """Assets that pass every given filter; text is looked for in id, component and class, and in location and target if they are there, whatever the case."""
    for name, value in (("tier", tier), ("threat", threat), ("component", component)):
        if value is not None:
            assets = assets.where(F.col(name) == value)
    if primitive is not None:
        assets = assets.where(F.coalesce("primitive", "alg_primitive") == primitive)
    if reachable:
        assets = assets.where("reachable")
    if text is not None:
        places = [c for c in ("asset_id", "component", "data_class", "location", "target") if c in assets.columns]
        assets = assets.where(F.contains(F.lower(F.concat_ws(" ", *places)), F.lit(text.strip().lower())))
    return assets


#: What an inventory can be sorted by; assets without a deadline of their own come last.
SORT_KEYS = {
    "priority": F.col, "component": F.col, "agility": F.col, "name": lambda _: F.lower("alg_name"), "index": lambda _: F.col("exposure_index"),
    "mosca": lambda _: F.when(F.col("qb") >= 0.5, F.col("urgency_years")).otherwise(-99.0),
}


def ordered(assets: DataFrame, key: str = "priority", descending: bool = True) -> DataFrame:
    """The assets by one of SORT_KEYS, equal ones by id."""
    by = SORT_KEYS[key](key)
    return assets.orderBy(by.desc() if descending else by.asc(), "asset_id")


def top_risks(assets: DataFrame, n: int = 6) -> DataFrame:
    """The assets of the highest priority."""
    return ordered(assets).limit(n).select("asset_id", "component", "priority", "tier", "threat")


def domains(assets: DataFrame) -> DataFrame:
    """(field, value): the components and primitives that there are, to choose from."""
    each = lambda field, c: assets.select(F.lit(field).alias("field"), c.alias("value")).distinct()
    return each("component", F.col("component")).unionByName(each("type", F.coalesce("primitive", "alg_primitive"))).orderBy("field", "value")


def component_sensitivity(classified: DataFrame) -> DataFrame:
    """The most sensitive class of each component's assets."""
    order = F.when(F.col("criticality") == "critical", 3).when(F.col("criticality") == "high", 2).when(F.col("criticality") == "medium", 1).otherwise(0)
    top = F.min(F.struct((-order).alias("r"), (-F.col("lifetime")).alias("l"), "asset_id", "data_class", "criticality"))
    return classified.groupBy("component").agg(top.alias("t")).select("component", "t.data_class", "t.criticality", (-F.col("t.l")).alias("lifetime"))


def waves(roadmap: DataFrame) -> DataFrame:
    return roadmap.groupBy("wave").agg(F.count("*").alias("items"), (F.sum(F.round(F.col("effort") * 10).cast("long")) / 10.0).alias("effort"), F.max("migration_years").alias("max_years"))
