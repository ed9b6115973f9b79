"""The posture graph: typed nodes, seven kinds of edges, and what surrounds an asset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura.storage import written

#: Edges on the way from an entry point to an asset, and from an asset on.
UP, DOWN = ["exposes", "calls", "uses"], ["depends-on", "protects"]


def component_id(c: str = "component") -> Column:
    return F.concat(F.lit("component/"), F.col(c))


def data_id() -> Column:
    return F.concat(F.lit("data/"), F.col("data_class"), F.lit("/"), F.substring(F.sha2(F.concat_ws("|", "data_class", "asset_id"), 256), 1, 16))


def library_id() -> Column:
    return F.concat_ws("/", F.lit("library"), "component", "name", F.coalesce("version", F.lit("unknown")))


def nodes(assets: DataFrame, functions: DataFrame, entries: DataFrame, libraries: DataFrame) -> DataFrame:
    """(id, type, label): components, entry points, functions, assets (crypto), data and libraries, each once.

    assets: (asset_id, component, alg_id, data_class); functions: (function_id, component, name);
    entries: (function_id, entry_kind); libraries: (component, name, version).
    """
    node = lambda df, i, kind, label: df.select(i.alias("id"), F.lit(kind).alias("type"), label.alias("label"))
    owned = reduce(DataFrame.unionByName, (x.select("component") for x in (assets, functions, libraries))).distinct()
    parts = [
        node(owned, component_id(), "component", F.col("component")),
        node(entries, F.concat(F.lit("entry/"), "function_id"), "entry", F.col("entry_kind")),
        node(functions, F.col("function_id"), "function", F.col("name")),
        node(assets, F.col("asset_id"), "crypto", F.col("alg_id")),
        node(assets, data_id(), "data", F.col("data_class")),
        node(libraries.select("component", "name", "version").distinct(), library_id(), "library", F.col("name")),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["id"])


def edges(assets: DataFrame, functions: DataFrame, entries: DataFrame, libraries: DataFrame, calls: DataFrame, uses: DataFrame, links: DataFrame, serving: DataFrame | None = None) -> DataFrame:
    """(source, target, kind), each once: contains, exposes, calls, uses, protects, depends-on and links.

    calls: (caller, target); uses: (function_id, asset_id); links: (asset_id, depends_on);
    serving: (function_id, asset_id) of listeners and what they configure, present or negotiate.
    A dependency on an asset that the inventory lacks, and a use by an unknown function, make no edge.
    """
    edge = lambda df, s, t, kind: df.select(s.alias("source"), t.alias("target"), F.lit(kind).alias("kind"))
    c, known = F.col, functions.select("function_id")
    there = lambda df, col: df.join(assets.select(F.col("asset_id").alias(col)), col, "left_semi")
    used = uses if serving is None else uses.select("function_id", "asset_id").unionByName(serving.select("function_id", "asset_id"))
    parts = [
        edge(functions, component_id(), c("function_id"), "contains"), edge(assets, component_id(), c("asset_id"), "contains"),
        edge(entries, F.concat(F.lit("entry/"), "function_id"), c("function_id"), "exposes"), edge(calls.where("caller <> target"), c("caller"), c("target"), "calls"),
        edge(there(used.join(known, "function_id", "left_semi"), "asset_id"), c("function_id"), c("asset_id"), "uses"), edge(assets, c("asset_id"), data_id(), "protects"),
        edge(there(there(links, "depends_on"), "asset_id"), c("asset_id"), c("depends_on"), "depends-on"), edge(libraries, component_id(), library_id(), "links"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that lack an end among the nodes."""
    at = lambda c: nodes.select(F.col("id").alias(c))
    lost = [edges.join(at(c), c, "left_anti").select("source", "target", "kind") for c in ("source", "target")]
    return lost[0].unionByName(lost[1]).distinct()


def lineage(roots: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(asset_id, node, side, depth): what stands within so many edges of each asset.

    On side 'up' are the functions, callers and entry points that lead to it, on side 'down' what
    it depends on and protects. All roots are searched at once: the frontier is keyed by root and
    node, each level is one join with the edges, and a node counts at its least depth. Edges are
    read for each level, so they should be stored; levels are written as tables.
    """
    found = []
    for side, kinds, here, there in (("up", UP, "target", "source"), ("down", DOWN, "source", "target")):
        hops = edges.where(F.col("kind").isin(kinds)).select(F.col(here).alias("node"), F.col(there).alias("next"))
        level = roots.select("asset_id", F.col("asset_id").alias("node")).distinct()
        seen = [level]
        for depth in range(1, most + 1):
            step = level.join(hops, "node").select("asset_id", F.col("next").alias("node")).distinct()
            level = written(step.join(reduce(DataFrame.unionByName, seen), ["asset_id", "node"], "left_anti"), f"{side}-{depth}")
            seen.append(level)
            found.append(level.select("asset_id", "node", F.lit(side).alias("side"), F.lit(depth).alias("depth")))
    return reduce(DataFrame.unionByName, found)
