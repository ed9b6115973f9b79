"""Comparing two inventories: what came, went, got worse or better."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postura.operators.assess import TIERS, tier_ordinal


def compare(baseline: DataFrame, current: DataFrame, threshold: str = "high") -> DataFrame:
    """Changes between two inventories of (asset_id, component, tier); regressions reach the threshold."""
    old = baseline.select(F.col("asset_id"), F.col("component").alias("old_component"), F.col("tier").alias("old_tier"), F.lit(1).alias("was"))
    new = current.select(F.col("asset_id"), F.col("component").alias("new_component"), F.col("tier").alias("new_tier"), F.lit(1).alias("now"))
    before, after = tier_ordinal(F.col("old_tier")), tier_ordinal(F.col("new_tier"))
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when(after > before, "worsened").when(after < before, "improved")
    )
    rows = old.join(new, "asset_id", "full_outer").withColumn("change", change).where("change IS NOT NULL")
    regression = F.col("change").isin("added", "worsened") & (after >= TIERS.index(threshold) + 1)
    return rows.select("asset_id", F.coalesce("new_component", "old_component").alias("component"), "change", "old_tier", "new_tier", regression.alias("regression"))


def ordered(changes: DataFrame) -> DataFrame:
    """Regressions first, then the highest tier, then the id."""
    return changes.orderBy(F.col("regression").desc(), tier_ordinal(F.coalesce("new_tier", "old_tier")).desc(), "asset_id")


def gate(changes: DataFrame) -> DataFrame:
    """One row: changes by kind, regressions, and whether the gate passes."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return changes.agg(
        *(count(F.col("change") == k).alias(k) for k in ("added", "worsened", "improved", "removed")),
        count(F.col("regression")).alias("regressions"), (count(F.col("regression")) == 0).alias("passes"),
    )
