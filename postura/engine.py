"""The analysis from observations to advice, as DataFrames; each step is its own operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postura.operators import advise, assess, classify, graph, normalize
from postura.policy import DEFAULT, Policy


def version_at_least(version, least: str):
    """Whether a dotted version is at least another, number by number; letters don't count."""
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    return numbers(version) >= numbers(F.lit(least))


def pqc_ready(libraries: DataFrame) -> DataFrame:
    """(component): components that link a library with post-quantum algorithms."""
    from postura.knowledge import LIBRARIES

    ready = F.lit(False)
    for name, since in LIBRARIES:
        if since == "any":
            ready = ready | (F.col("name") == name)
        elif since not in ("never", "unknown"):
            ready = ready | ((F.col("name") == name) & version_at_least(F.col("version"), since))
    return libraries.where(ready).select("component").distinct()


def inventory(occurrences: DataFrame, catalogue: DataFrame, libraries: DataFrame | None = None, exposed: DataFrame | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """Assessed and advised assets of the occurrences; those that graph.exposure() finds reachable (exposed) are confirmed."""
    assets = normalize.assets(occurrences)
    best = classify.best(classify.scores(classify.evidence(occurrences)))
    rows = classify.classified(assets, best, policy)
    ready = pqc_ready(libraries).select("component", F.lit(1).alias("pqc_library")) if libraries is not None else None
    rows = rows.join(ready, "component", "left") if ready is not None else rows.withColumn("pqc_library", F.lit(0))
    if exposed is not None:
        rows = rows.join(exposed.select("asset_id", "exposure", "reachable"), "asset_id", "left").withColumn("exposure", F.coalesce("exposure", F.lit(policy.exposure["unreached"])))
        rows = rows.withColumn("liveness", F.when(F.col("reachable"), "confirmed").otherwise(F.col("liveness")))
    else:
        rows = rows.withColumn("exposure", F.lit(policy.exposure["unreached"]))
    return advise.advised(assess.assessed(assess.with_strength(rows, catalogue), policy), policy)
